"""Tiles, bounds and cells of the similarity operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from workrisk.operators import similarity as s


def far(a, b):
    x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * s.EARTH_KM * math.asin(math.sqrt(min(1, x)))


@pytest.mark.parametrize("km", [12.0, 700.0, 15_000.0])
def test_cells_hold_all_that_is_near(spark, km):
    """Anywhere, at the poles and across the date line."""
    rng = np.random.default_rng(3)
    lat = np.concatenate([rng.uniform(-90, 90, 150), rng.uniform(89.8, 90, 40), rng.uniform(-90, -89.8, 40), [90, -90, 0, 0, 0]])
    lon = np.concatenate([rng.uniform(-180, 180, 150), rng.uniform(-180, 180, 80), [0, 50, 180, -180, 179.999]])
    step = math.degrees(km / s.EARTH_KM)
    points = [(float(a), float(b)) for a, b in zip(lat, lon, strict=True)]
    points += [(float(np.clip(a + rng.uniform(-step, step), -90, 90)), float((b + rng.uniform(-step, step) / max(0.01, math.cos(math.radians(a))) + 180) % 360 - 180)) for a, b in points]
    own, near = s._cells(F.col("a"), F.col("b"), km)
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "k int, a double, b double").select("k", own.alias("own"), near.alias("near")).orderBy("k").collect()
    asked = [set(r.near) for r in rows]
    close = 0
    for i, p in enumerate(points):
        assert rows[i].own in asked[i]
        for j, q in enumerate(points):
            if i != j and far(p, q) <= km:
                close += 1
                assert rows[j].own in asked[i], (p, q)
    assert close > 100
    if km < 100:
        assert max(len(x) for k, x in enumerate(asked) if abs(points[k][0]) < 60) <= 12


@pytest.mark.parametrize("rest", [0.05, 0.5, 0.95])
def test_bounds_lose_no_best(monkeypatch, rest):
    monkeypatch.setattr(s, "REST", rest)
    monkeypatch.setattr(s, "FEW", 3)
    rng = np.random.default_rng(5)
    rows = []
    for k in range(120):
        grams = rng.choice(60, int(rng.integers(1, 14)), replace=False).astype(np.int64)
        w = rng.exponential(size=len(grams)) ** 2
        w /= np.sqrt(w @ w)
        order = np.argsort(-w)
        rows.append((k, grams[order], w[order], float(rng.uniform(20, 20.4)) if k % 7 else None, 75.0))
    rows += [(200 + k, *rows[k][1:]) for k in range(5)]  # copies tie with the first
    dense = np.zeros((len(rows), 60))
    for k, r in enumerate(rows):
        dense[k, r[1]] = r[2]
    tile = s.Tile(list(rows))
    for km in (None, 12.0):
        for i, (first, grams, w, lat, lon) in enumerate(rows):
            score = np.round(dense @ dense[i], 9)
            score[i] = -1
            if km and lat is not None:
                score[[j for j, r in enumerate(rows) if r[3] is not None and far((lat, lon), (r[3], r[4])) > km]] = -1
            got = tile.best(first, grams, w, (lat, lon), km)
            assert (got is None) == (score.max() <= 0)
            assert got is None or (got[0] == pytest.approx(score.max(), abs=1e-9) and got[1] == rows[int(score.argmax())][0])


def test_bounds_save_work():
    """Of texts that differ in few words, most posting lists are never walked."""
    rng = np.random.default_rng(1)
    common, rows = np.arange(50, dtype=np.int64), []
    for k in range(1500):
        grams = np.concatenate([common, 50 + rng.choice(4000, 30, replace=False)]).astype(np.int64)
        w = np.concatenate([np.full(50, 0.05), np.full(30, 1.0)])
        w /= np.sqrt(w @ w)
        order = np.argsort(-w, kind="stable")
        rows.append((k, grams[order], w[order], None, None))
    for k in range(0, 1500, 2):  # each has a near copy
        rows[k + 1] = (k + 1, *rows[k][1:])
    tile = s.Tile(list(rows))
    for r in rows[:200]:
        assert tile.best(r[0], r[1], r[2], None, None)[0] == 1.0
    everything = sum(int((tile.starts[1:] - tile.starts[:-1])[np.searchsorted(tile.grams, r[1])].sum()) for r in rows[:200])
    assert tile.seen < everything / 10


def test_items_without_a_place_meet_their_category(spark):
    rows = [("a", "D", "road near school", 1, "Road", 10.0, 20.0), ("b", "D", "road near school x", 1, "Road", 50.0, 60.0), ("c", "D", "road near schools", 1, "Road", None, None),
            ("d", "D", "road near school", 1, "Hall", 10.0, 20.0), ("e", "E", "road near school", 1, "Road", 10.0, 20.0), ("f", "D", "", 1, "Road", 10.0, 20.0)]
    table = spark.createDataFrame([(b, t, n, f, c, x, y) for f, b, t, n, c, x, y in rows], "block string, text string, n long, first string, category string, latitude double, longitude double")
    got = {r["first"]: (r.partner, round(r.similarity, 3) > 0) for r in s.partners_nearby(table, 12.0).collect()}
    assert got["a"] == ("c", True) and got["b"] == ("c", True) and got["c"][0] in ("a", "b")
    assert got["d"] == (None, False) and got["f"] == (None, False) and "e" not in got
