"""Packing against the library's ids, exact sums and bounds on any packing."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from workrisk.llm import packing as m

JSON = P.path("byte_bpe_50k.json")
COUNTS = st.lists(st.integers(0, 6), min_size=2, max_size=41).map(lambda x: [0, *x])


def used(patterns, capacity):
    total = [0] * (capacity + 1)
    for pattern, times in patterns:
        assert times > 0 and sum(x * n for x, n in pattern.items()) <= capacity
        for x, n in pattern.items():
            total[x] += n * times
    return total


@settings(max_examples=200, deadline=None)
@given(COUNTS)
def test_plans_use_every_piece_once(counts):
    capacity = len(counts) - 1
    made = m.plan(counts)
    assert used(made, capacity) == counts
    tokens = sum(x * n for x, n in enumerate(counts))
    bound = max(-(-tokens // capacity), sum(n for x, n in enumerate(counts) if 2 * x > capacity))
    assert bound <= sum(n for _, n in made) <= min(2 * bound, sum(n for _, n in m.best_fit(counts)) + sum(counts) // 4 + 1)


@settings(max_examples=120, deadline=None)
@given(COUNTS.filter(lambda x: len(x) < 26))
def test_no_exact_filling_is_left(counts):
    capacity = len(counts) - 1
    full, left = m.exact_complements(counts)
    assert all(sum(x * n for x, n in p.items()) == capacity for p, _ in full)
    assert [a + b for a, b in zip(used(full, capacity), left, strict=True)] == counts
    there = [x for x, n in enumerate(left) if n]
    for parts in (1, 2, 3):
        for found in combinations_with_replacement(there, parts + 1):
            assert sum(found) != capacity or any(n > left[x] for x, n in Counter(found).items())


@settings(max_examples=60, deadline=None)
@given(COUNTS, st.randoms())
def test_pair_index(counts, rng):
    sums = m.Sums(counts)
    for _ in range(20):
        x = rng.randrange(1, len(counts))
        sums.change(x, rng.choice([-1, 1, 2]) if sums.counts[x] else 1)
    n = sums.counts
    want = [sum(1 for a in range(1, s // 2 + 1) if n[a] and n[s - a] > (a == s - a)) for s in range(len(counts))]
    assert sums.pairs.tolist() == want


def check(rows, got, capacity, end_id):
    library = Tokenizer.from_file(JSON)
    want = Counter()
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end_id]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for found in by_sequence.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= capacity
    return by_sequence


def test_pack_equals_brute_force(spark, documents, odd_texts):
    rng = random.Random(4)
    rows = [*odd_texts, *[(k, " ".join(rng.choice(["stone", "river", "écrit", "12", "Lamp,"]) for _ in range(rng.randint(0, 90)))) for k in range(100, 400)], *[(8, "again and again")] * 60]
    docs = documents(rows).repartition(5)
    for capacity in (64, 1024):
        packed = m.pack(docs, JSON, P.PATTERN, capacity, keep_ids=True)
        got = packed.collect()
        by_sequence = check(rows, got, capacity, m.END_ID)
        tokens = sum(r.length for r in got)
        assert len(by_sequence) <= -(-tokens // capacity) * 1.01 + 1
        whole = {r.sequence_id: r for r in m.sequences(packed).collect()}
        assert len(whole) == len(by_sequence)
        for r in got:
            own = whole[r.sequence_id]
            assert own.ids[r.offset : r.offset + r.length] == r.ids and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
    assert m.pack(documents([]), JSON, P.PATTERN).count() == 0
    one = m.pack(documents([(1, None)]), JSON, P.PATTERN).collect()
    assert [(r.doc_id, r.piece, r.length, r.offset) for r in one] == [(1, 0, 1, 0)]
