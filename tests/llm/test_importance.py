"""Importance resampling against a version in plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from workrisk.llm import importance as m

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def found(text, longest=1):
    words = WORD.findall(re.sub("[A-Z]", lambda x: x.group().lower(), text or ""))
    return len(words), [" ".join(words[i : i + k]) for i in range(len(words)) for k in range(1, longest + 1) if i + k <= len(words)]


def brute(docs, target, buckets, longest, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in found(x, longest)[1]) for texts in ([x for _, x in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        n, fs = found(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        rows.append([doc_id, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0], r[2]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=str)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aB9 -_\x00\x7fé"), st.characters(codec="utf-8")), max_size=40), max_size=8), st.sampled_from([1, 3]), st.sampled_from([5, 1 << 20]))
def test_automaton_equals_regex_and_zlib(texts, longest, segment):
    held, m.SEGMENT = m.SEGMENT, segment
    try:
        parts = list(m.features(pa.array(["before", *texts], pa.string())[1:], 1 << 32, longest))
    finally:
        m.SEGMENT = held
    want = [found(t, longest) for t in texts]
    assert [int(x) for p in parts for x in p[0]] == [n for n, _ in want]
    assert [int(x) for p in parts for x in p[1]] == [len(f) for _, f in want]
    assert [int(x) for p in parts for x in p[2]] == [zlib.crc32(f.encode()) for _, fs in want for f in fs]


def test_words_across_segments():
    text = ("ab" * 40 + " c " + "d" * 300 + "." + "é" * 50 + " ") * 30
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    data, starts, sizes = m.words(raw, np.array([0, 200, len(raw)]), segment=16)
    want = [w for part in (raw[:200].tobytes(), raw[200:].tobytes()) for w in re.findall(rb"[0-9a-z\x80-\xff]+", part)]
    assert [data[a : a + n].tobytes() for a, n in zip(starts, sizes, strict=True)] == want
    assert m.crc32_of(data, starts, sizes).tolist() == [zlib.crc32(w) for w in want]


def test_resample_equals_brute_force(spark, documents, odd_texts):
    words = "stone river Lamp cloud green MARKET seven écrit 东京 paper".split()
    rows = [*odd_texts, *[(k, " ".join(words[(k * j + j) % 10] for j in range(k % 60))) for k in range(20, 300)], *[(9, " ".join(words * 3))] * 40]
    target = ["green paper seven", None, "", "the quick river", "green green Paper"]
    table = spark.createDataFrame([(x,) for x in target], "text string")
    for longest, percent in ((1, 10), (2, 35)):
        got = m.resample(documents(rows), table, 97, longest, percent, 20).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, target, 97, longest, percent, 20)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "text string")
    assert m.resample(documents([]), none).count() == 0
    got = m.resample(documents([(1, None), (2, "")]), none).collect()
    assert sorted((r.doc_id, r.n_features, r.weight, r["rank"]) for r in got) == [(1, 0, 0, None), (2, 0, 0, None)]
