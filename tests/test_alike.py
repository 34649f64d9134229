"""The most similar other text of a block, against all pairs; what it leaves on disk
on the way."""

import math
import os
import random
import threading
from collections import Counter

import pytest

from workrisk.operators import alike, similarity


def _brute(rows):
    found = {}
    for block in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == block), key=lambda r: r[3])
        total = sum(r[2] for r in own)
        grams = {r[3]: Counter(similarity._grams(r[1])) for r in own}
        df = Counter()
        for r in own:
            for g in grams[r[3]]:
                df[g] += r[2]
        unit = {}
        for k, c in grams.items():
            w = {g: (1 + math.log(n)) * (math.log((1 + total) / (1 + df[g])) + 1) for g, n in c.items()}
            size = math.sqrt(sum(x * x for x in w.values())) or 1
            unit[k] = {g: x / size for g, x in w.items()}
        for a in own:
            best = (0.0, None)
            for b in own:
                s = round(sum(x * unit[b[3]].get(g, 0) for g, x in unit[a[3]].items()), 9) if a is not b else 0
                if s > best[0] + 1e-9:
                    best = (s, b[3])
            if best[1] is not None:
                found[block, a[3]] = best
    return found


@pytest.mark.parametrize(("tile", "letters", "at_once", "often"), [(4000, 10**7, 2, 8), (7, 10**7, 1, 8), (4000, 300, 2, 1), (9, 10**7, 3, 10**6)])
def test_equals_all_pairs(spark, monkeypatch, tile, letters, at_once, often):
    """Whatever the tiles, the rounds, and the n-grams that have a row of a matrix;
    words with copies, a text of one gram, one with none, one with its own words."""
    monkeypatch.setattr(alike, "OFTEN", often)
    monkeypatch.setattr(alike, "BATCH", 5)
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("road", "drain", "pump", "wall", "aaaaaa") for b in range(12)]
    texts = [("A", " ".join(rng.choices(words, k=rng.randint(1, 12)))) for _ in range(60)] + [("B", " ".join(rng.choices(words, k=6))) for _ in range(25)]
    texts += [("A", "x"), ("A", ""), ("B", "qqqq zzzz"), ("alone", "road1 road2")]
    rows = [(b, t, rng.randint(1, 3), k) for k, (b, t) in enumerate(dict.fromkeys(texts))]
    items = spark.createDataFrame(rows, "block string, text string, n long, first long")
    got = {(r.block, r["first"]): (r.similarity, r.partner) for r in alike.best_others(items, tile, letters, at_once).collect()}
    want = _brute(rows)
    assert set(got) == set(want)
    for k, (s, partner) in want.items():
        assert got[k][0] == pytest.approx(s, abs=2e-9) and got[k][1] == partner, k


def test_ties_go_to_the_smallest(spark):
    """Texts with the same words in another order have the same vector."""
    rows = [("A", " ".join(p), 1, k) for k, p in enumerate([("one", "two", "six"), ("two", "one", "six"), ("six", "two", "one"), ("six", "one", "two")])]
    got = {r["first"]: (r.partner, r.similarity) for r in alike.best_others(spark.createDataFrame(rows, "block string, text string, n long, first long"), 2).collect()}
    assert got == {0: (1, 1.0), 1: (0, 1.0), 2: (0, 1.0), 3: (0, 1.0)}


def _shuffled(spark):
    tops = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    total = 0
    for top in tops:
        for at, _, names in os.walk(top):
            for f in names:
                try:
                    total += os.path.getsize(os.path.join(at, f))
                except OSError:
                    pass
    return total


def test_disk_does_not_grow_with_the_tiles(spark, monkeypatch):
    """Texts travel, not vectors, and a few tiles of a block at a time."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(3000)]
    rows = [(k, "D", " ".join(rng.choices(words, k=250))) for k in range(600)]
    size = sum(len(r[2]) for r in rows)
    df = spark.createDataFrame(rows, "work_id long, district string, description_normalised string").coalesce(4)
    monkeypatch.setattr(alike, "TILE", 60, raising=False)
    monkeypatch.setattr(similarity, "TILE", 60)
    before, peak, done = _shuffled(spark), [0], threading.Event()

    def watch():
        while not done.wait(0.01):
            peak[0] = max(peak[0], _shuffled(spark) - before)

    t = threading.Thread(target=watch)
    t.start()
    try:
        assert similarity.similarity(df).count() == 600
    finally:
        done.set()
        t.join()
    assert peak[0] < 4 * size, (peak[0], size)
