"""Order statistics of groups of any size against numpy and sorting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from workrisk.operators import ranks


@pytest.fixture(scope="module")
def rows():
    """One group holds nine tenths of all rows, half of them one value."""
    rng = random.Random(2)
    out = [("big", rng.choice([7.0, rng.gauss(0, 50), float(rng.randint(-3, 3))])) for _ in range(5400)]
    out += [(rng.choice("abcd"), rng.choice([None, 1e300, -1e-300, rng.random()])) for _ in range(600)]
    return out + [("null", None), (None, 5.0), ("one", 4.0), ("two", 1.0), ("two", 2.0), ("same", 3.0)] + [("same", 3.0)] * 200


@pytest.mark.parametrize("small", [3, 60, 50_000])
def test_quantiles_of_groups(spark, rows, small):
    table = spark.createDataFrame(rows, "g string, x double").repartition(6)
    wanted = {"low": (F.col("x"), 0.0), "q": (F.col("x"), 0.31), "mid": (F.col("x"), 0.5), "high": (F.col("x"), 0.975), "twice": (F.col("x") * 2, 0.5)}
    got = {r.g: r for r in ranks.quantiles(table, "g", wanted, small).collect()}
    assert set(got) == {g for g, _ in rows if g is not None}
    for g, r in got.items():
        own = [x for k, x in rows if k == g and x is not None]
        for n, q, times in (("low", 0, 1), ("q", 0.31, 1), ("mid", 0.5, 1), ("high", 0.975, 1), ("twice", 0.5, 2)):
            assert r[n] == (pytest.approx(np.quantile(own, q) * times, rel=1e-12) if own else None), (g, n)


@pytest.mark.parametrize("small", [10, 50_000])
def test_quantiles_of_whole_tables(spark, rows, small):
    table = spark.createDataFrame(rows, "g string, x double")
    got = ranks.quantiles(table, None, {"mid": (F.col("x"), 0.5), "none": (F.lit(None).cast("double"), 0.5)}, small).collect()
    assert [tuple(r) for r in got] == [(pytest.approx(np.median([x for _, x in rows if x is not None])), None)]
    assert [tuple(r) for r in ranks.quantiles(table.limit(0), None, {"mid": (F.col("x"), 0.5)}, small).collect()] == [(None,)]
    assert ranks.quantiles(table.limit(0), "g", {"mid": (F.col("x"), 0.5)}, small).count() == 0


def test_running_sums_of_a_skewed_group(spark, rows):
    counts = Counter((g, x) for g, x in rows if g is not None and x is not None)
    table = spark.createDataFrame([(g, x, n) for (g, x), n in counts.items()], "g string, x double, _n long")
    for by in ("g", None):
        got = ranks.running(table, ["x"] if by else ["x", "g"], by=by).collect()
        total = Counter()
        for (g, _), n in counts.items():
            total[g if by else None] += n
        seen = Counter()
        for r in sorted(got, key=lambda r: (r.g, r.x) if by else (r.x, r.g)):
            key = r.g if by else None
            seen[key] += r._n
            assert (r._upto, r._all) == (seen[key], total[key])
        assert len(got) == len(counts)


def test_ranks_of_one_range_are_cut_once(spark, monkeypatch):
    """Six ranks of a column begin in one range, whose values are looked at once."""
    plans, stored = [], ranks.stored
    monkeypatch.setattr(ranks, "stored", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df))
    table = spark.range(1000).select((F.col("id") * 7919 % 1000).cast("double").alias("x"))
    x = F.col("x")
    got = ranks.quantiles(table, None, {f"q{k}": (x, k / 4) for k in (1, 2, 3)}, 10).head()
    assert tuple(got) == (249.75, 499.5, 749.25)
    cut = [re.sub(r"#\d+L?", "", line) for p in plans for line in p.splitlines() if "percentile_approx(" in line]
    assert cut and all("_i, _low, _high], [" in line for line in cut), cut
    values = [line for p in plans for line in p.splitlines() if "Generate" in line]
    assert values and not any("_i:1" in line or "1 AS _i" in line or "_v1" in line for line in values), values
