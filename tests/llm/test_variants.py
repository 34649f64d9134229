"""Spelling variants against comparing all words with each other."""

import random
import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from workrisk.llm import variants as m


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_links(counts):
    words = sorted(counts)
    return {(a, b, counts[b]) for a in words for b in words if a != b and near(a, b)}


def brute(rows, least_length=6, least_count=5, ratio=5, slip=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda x: x.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    found = defaultdict(list)
    for a, b, n in brute_links(counts):
        found[a].append((-n, b))
    form = {w: min(x)[1] for w, x in found.items() if -min(x)[0] >= ratio * counts[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, n, len(found[w]), form.get(w), counts.get(form.get(w)), root(w)) for w, n in counts.items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), unique=True, min_size=1).map(sorted), min_size=1, max_size=6), st.integers(1, 4))
def test_merge_counts_postings(lists, need):
    counts = Counter(x for found in lists for x in found)
    assert list(m.merge(lists, need)) == sorted(x for x, n in counts.items() if n >= need)


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text(alphabet="abé", min_size=3, max_size=8), min_size=2, max_size=40))
def test_whole_ranges_hold_all_links(words):
    found = set()
    for length in range(2, 9):
        for kind, sizes, last in ((m.REPLACED, {length}, length - 1), (m.INSERTED, {length, length + 1}, length)):
            own = sorted(w for w in words if len(w) in sizes)
            pairs = [frozenset((own[j], own[k])) for j, k in m.near_in_shard(own, kind, length, 0, last)]
            assert len(pairs) == len(set(pairs))
            found |= set(pairs)
    assert found == {frozenset((a, b)) for a in words for b in words if a < b and near(a, b)}


def test_links_in_shards_of_any_size(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("aabcé") for _ in range(rng.randint(5, 9))) for _ in range(1500)} | {"station"[:k] + c + "station"[k:] for k in range(8) for c in "abcdefghij"}
    counts = {w: rng.randint(5, 900) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = brute_links(counts)
    for group in (3, 100, 5000):
        got = [tuple(r) for r in m.links(table, group).collect()]
        assert len(got) == len(set(got))
        assert set(got) == want


def test_variants_equal_brute_force(spark, documents, odd_texts):
    rng = random.Random(3)
    base = ["Receive", "station", "éclairÉ", "committee", "separate", "necessary", "stations"]
    words = base + [w[:k] + w[k + 1 :] for w in base for k in range(len(w))] + [w[:3] + "x" + w[4:] for w in base]
    weights = [400] * len(base) + [30] * (len(words) - len(base))
    rows = [*odd_texts, *[(k, " ".join(rng.choices(words, weights, k=rng.randint(0, 60))) + "\n1,") for k in range(100, 260)], *[(7, "receive seperate, SEPERATE")] * 30, (None, "recieve " * 9)]
    for slip in (199, 5):
        got = m.group_variants(documents(rows), slip=slip, group=50).collect()
        assert sorted(map(tuple, got), key=lambda r: r[0]) == brute(rows, slip=slip)
    assert any(r.root not in (r.form, r.word) for r in got)
    assert m.group_variants(documents([])).count() == 0
    assert m.group_variants(documents([(1, None), (2, "")])).count() == 0
