"""The hash tree against a version in plain Python."""

import math
import struct
import zlib
from collections import Counter

import xxhash

from workrisk.llm import hash_tree as t


def draw(key, node, weight):
    h = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
    h = xxhash.xxh64_intdigest(node.encode(), seed=h)
    return -math.log(((h >> (64 - t.DRAW_BITS)) + 0.5) / (1 << t.DRAW_BITS)) / weight


def place(key, shards):
    rest, path = [s for s in shards if s.weight > 0], ""
    for level in ("region", "rack", "number"):
        kids = sorted({getattr(s, level) for s in rest})
        best = kids[0] if len(kids) == 1 else min(kids, key=lambda c: (draw(key, f"{path}/{c}", sum(s.weight for s in rest if getattr(s, level) == c)), c))
        rest, path = [s for s in rest if getattr(s, level) == best], f"{path}/{best}"
    return rest[0].number


def test_shards_equal_brute_force(documents, odd_texts):
    rows = [*odd_texts, *[(k, f"text {k}") for k in range(100, 900)], *[(7, "again and again")] * 300]
    shards = t.tree(8)
    got = t.shard_documents(documents(rows), shards, t.grow(shards), slices=16).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r["shard"], r.grown_shard) for r in got) == Counter(
        (i, len((x or "").encode()) + 1, zlib.crc32((x or "").encode()), "key", place(i, shards), place(i, t.grow(shards))) for i, x in rows
    )
    for s in range(8):
        slots = sorted(r.slot for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r["shard"], 8) for r in got)
    assert t.shard_documents(documents([]), shards, t.grow(shards)).count() == 0


def test_weights_move_rows_only_in_their_subtree(spark):
    shards = t.tree(8)
    heavier = [t.Shard(s.number, s.region, s.rack, 2.0 if s.number == 3 else 1.0) for s in shards]
    moved = [(place(k, shards), place(k, heavier)) for k in range(3000)]
    region = {s.number: s.region for s in shards}
    assert all(a == b or region[b] == region[3] for a, b in moved)
    counts = Counter(b for _, b in moved)
    assert abs(counts[3] / 3000 - 2 / 9) < 0.03
    assert t.grow(t.tree(9)) == t.tree(10)


def test_no_python_in_the_plan(documents):
    df = t.shard_documents(documents([(1, "x")]), t.tree(8), t.tree(9))
    plan = df._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
