"""The best partner within reach, for items that share texts, against all pairs."""

import math
import random
from collections import Counter

import pytest

from workrisk.operators import similarity


def _brute(rows, km):
    found = {}
    for block in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == block]
        grams = {r[1]: Counter(similarity._grams(r[1])) for r in own}
        df = Counter(g for r in own for g in grams[r[1]])
        unit = {}
        for t, c in grams.items():
            w = {g: (1 + math.log(n)) * (math.log((1 + len(own)) / (1 + df[g])) + 1) for g, n in c.items()}
            size = math.sqrt(sum(x * x for x in w.values())) or 1
            unit[t] = {g: x / size for g, x in w.items()}
        for a in own:
            best = (0.0, None)
            for b in sorted(own, key=lambda r: r[3]):
                if b[3] == a[3] or b[4] != a[4]:
                    continue
                if None not in (a[5], a[6], b[5], b[6]):
                    p, q = math.radians(a[5]), math.radians(b[5])
                    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[6] - a[6]) / 2) ** 2
                    if 2 * similarity.EARTH_KM * math.asin(math.sqrt(min(1, h))) > km:
                        continue
                s = round(sum(x * unit[b[1]].get(g, 0) for g, x in unit[a[1]].items()), 9)
                if s > best[0]:
                    best = (s, b[3])
            found[a[3]] = best
    return found


@pytest.mark.parametrize(("small", "items", "tile"), [(20_000, 20_000, 2000), (0, 20_000, 2000), (20_000, 7, 5), (0, 3, 2)])
def test_shared_texts_equal_all_pairs(spark, monkeypatch, small, items, tile):
    monkeypatch.setattr(similarity, "SMALL", small)
    monkeypatch.setattr(similarity, "ITEMS", items)
    rng = random.Random(5)
    words = ["road", "drain", "school", "lot 7", "lot 8", "wall", ""]
    rows = []
    for k in range(160):
        there = rng.random() < 0.8
        rows.append((rng.choice(["A", "B"]), " ".join(rng.choices(words, k=2)).strip(), 1, f"p{k:03}", rng.choice(["x", "y"]), 10 + rng.random() * 0.4 if there else None, 20 + rng.random() * 0.4 if there else None))
    df = spark.createDataFrame(rows, "block string, text string, n long, first string, category string, latitude double, longitude double")
    got = {r["first"]: (r.similarity, r.partner) for r in similarity.partners_nearby(df, 12.0, tile).collect()}
    want = _brute(rows, 12.0)
    assert set(got) == set(want)
    for k, (s, partner) in want.items():
        assert got[k][0] == pytest.approx(s, abs=2e-9) and (got[k][1] == partner or abs(got[k][0] - s) > 0), k


def test_a_text_has_one_vector(spark, monkeypatch):
    """However many items share it."""
    seen = []
    real = similarity.vectors
    monkeypatch.setattr(similarity, "vectors", lambda items, tile: (seen.append(items.count()), real(items, tile))[1])
    rows = [("A", f"lot {k % 3}", 1, k, "x", None, None) for k in range(60)]
    df = spark.createDataFrame(rows, "block string, text string, n long, first long, category string, latitude double, longitude double")
    got = {r["first"]: r.partner for r in similarity.partners_nearby(df, 12.0).collect()}
    assert seen == [3]
    assert got == {k: (k % 3 if k >= 3 else k + 3) for k in range(60)}
