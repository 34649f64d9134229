"""Attributions of the forest against all subsets of features."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from workrisk.config import RiskConfig
from workrisk.operators import multivariate


def known(tree, held, row, features, at=0):
    """The expected length of a path where only some features are known."""
    feature, cut, left, right, length = tree
    f = feature[at]
    if f < 0:
        return length[at]
    if f in features:
        return known(tree, held, row, features, left[at] if row[f] <= cut[at] else right[at])
    return sum(held[c] * known(tree, held, row, features, c) for c in (left[at], right[at])) / held[at]


def shapley(forest, row, n):
    value = lambda s: np.mean([known(t, h, row, s) for t, h in zip(forest.nodes, forest.held, strict=True)])
    out = np.zeros(n)
    for f in range(n):
        others = [g for g in range(n) if g != f]
        for size in range(n):
            for s in combinations(others, size):
                share = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                out[f] -= share * (value({*s, f}) - value(set(s)))
    return out


def test_attributions_equal_all_subsets():
    rng = np.random.default_rng(2)
    rows = np.column_stack([rng.normal(size=60), rng.integers(0, 3, 60), rng.exponential(size=60), np.zeros(60)])
    forest = multivariate.IsolationForest(7, 32, 3).fit(rows)
    some = np.vstack([rows[:6], [[9, 9, 9, 9], [-5, 1, 0, 0]]])
    for at_once in (1, 1 << 19):
        got = forest.attributions(some, at_once)
        assert got == pytest.approx(np.array([shapley(forest, r, 4) for r in some]), abs=1e-9)
    assert (got[:, 3] == 0).all()
    # they sum to the expected path less the row's
    path = lambda r: np.mean([known(t, h, r, set(range(4))) for t, h in zip(forest.nodes, forest.held, strict=True)])
    mean = np.mean([known(t, h, rows[0], set()) for t, h in zip(forest.nodes, forest.held, strict=True)])
    assert got.sum(axis=1) == pytest.approx([mean - path(r) for r in some], abs=1e-9)


def test_the_drivers_of_a_planted_outlier(spark):
    rng = np.random.default_rng(4)
    rows = [(f"w{k:03}", *(float(x) for x in rng.normal(size=4))) for k in range(300)] + [("odd", 0.1, 12.0, -0.2, 9.0)]
    table = spark.createDataFrame(rows, "work_id string, size_a double, cost_b double, share_c double, days_d double")
    config = RiskConfig(model_rows=10, trees=60)
    out = multivariate.multivariate(table, config, columns=("size_a", "cost_b", "share_c", "days_d"), drivers="names")
    odd = out.where("work_id = 'odd'").head()
    assert set(odd.names.split(", ")) == {"cost b", "days d"} and odd.signal_multivariate > 0.9
    assert out.where(F.size(F.split("names", ", ")) != 2).count() == 0
    few = multivariate.multivariate(table.limit(3), config, columns=("size_a",), drivers="names").collect()
    assert {(r.signal_multivariate, r.names) for r in few} == {(None, "")}
