"""Importance resampling towards a target corpus by hashed word runs.

A byte automaton over Arrow's UTF-8 buffers finds and hashes the words of many
texts at once: a table maps each byte to its lower-case form, or to 0 where it
parts words; word boundaries are the differences of that mask; CRC32 runs byte
by byte over all words simultaneously, through its table of 256 entries. Bytes
decide alone, since all bytes of characters beyond ASCII belong to words.

Two passes read the texts: one counts the features of each bucket in both
corpora, one sums a text's gains. Between them stand two numbers a bucket. The
draw adds a Gumbel key of the id to each document's weight and takes the highest
sums; their ranks are places in sorted ranges with the counts of earlier ranges
carried over, so no task sees all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workrisk.llm.common import bounded_batches, field_ddl, id_text, only, written

BUCKETS = 10_000
#: Words of the longest run that is a feature.
LONGEST = 1
#: Documents of fewer words are never drawn; the share that is drawn, in percent.
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Bytes that the automaton reads at once, at most one word more.
SEGMENT = 4 << 20
#: So few words left are finished one by one.
FEW = 16
POLYNOMIAL = 0xEDB88320


def byte_classes() -> np.ndarray:
    """Of each byte: its lower-case form if it belongs to words, else 0."""
    b = np.arange(256, dtype=np.uint8)
    upper = (b >= ord("A")) & (b <= ord("Z"))
    lowered = np.where(upper, b + 32, b).astype(np.uint8)
    inside = (lowered >= ord("0")) & (lowered <= ord("9")) | (lowered >= ord("a")) & (lowered <= ord("z")) | (b >= 0x80)
    return np.where(inside, lowered, 0).astype(np.uint8)


def crc_table() -> np.ndarray:
    """CRC32's table: each byte shifted out through the polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(POLYNOMIAL), c >> 1).astype(np.uint32)
    return c


_CLASS, _CRC = byte_classes(), crc_table()


def crc32_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC32 of data[start : start + size] for all spans (of at least one byte)."""
    # longest first, so that the spans that still go on are a prefix
    order = np.argsort(-np.minimum(sizes, 1 << 14).astype(np.int16), kind="stable")
    at, left = starts[order], sizes[order]
    going = len(at) - np.cumsum(np.bincount(np.minimum(left, 1 << 14)))
    state = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32)
    step = 0
    while step < len(going) and going[step] > FEW:
        m = going[step]
        part = state[:m]
        low = (part & np.uint32(0xFF)).astype(np.uint8) ^ data[at[:m] + step]
        state[:m] = _CRC[low] ^ (part >> np.uint32(8))
        step += 1
    state ^= np.uint32(0xFFFFFFFF)
    for k in range(going[step] if step < len(going) else 0):
        state[k] = zlib.crc32(data[at[k] + step : at[k] + left[k]], int(state[k]))
    out = np.empty_like(state)
    out[order] = state
    return out


def _cuts(data: np.ndarray, segment: int) -> Iterator[tuple[int, int]]:
    """Parts of about ``segment`` bytes that end behind a byte between words."""
    at = 0
    while at < len(data):
        end = min(len(data), at + segment)
        while end < len(data) and data[end - 1]:
            gap = np.flatnonzero(data[end : end + segment] == 0)
            end = end + int(gap[0]) + 1 if len(gap) else min(len(data), end + segment)
        yield at, end
        at = end


def words(raw: np.ndarray, offsets: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The classified bytes of the texts raw[offsets[k] : offsets[k + 1]], and the
    start and size of every word."""
    data = _CLASS[raw]
    starts, ends = [], []
    for low, high in _cuts(data, segment):
        mask = np.zeros(high - low + 2, dtype=bool)
        mask[1:-1] = data[low:high] != 0
        begins, stops = mask[1:] & ~mask[:-1], mask[:-1] & ~mask[1:]
        # a text's end parts words, too
        own = offsets[(offsets > low) & (offsets < high)] - low
        inside = own[mask[own] & mask[own + 1]]
        begins[inside] = stops[inside] = True
        starts.append(np.flatnonzero(begins) + low)
        ends.append(np.flatnonzero(stops) + low)
    if not starts:
        return data, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    begin = np.concatenate(starts)
    return data, begin, np.concatenate(ends) - begin


def features(texts: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For parts of the texts in order: the number of words and of features of
    each text, and the buckets of all features, text by text. A null has none."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset) if len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        # texts of about SEGMENT bytes, one at least
        last = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SEGMENT, side="right")) - 1)
        own = offsets[at : last + 1]
        data, starts, sizes = words(raw[own[0] : own[-1]], own - own[0])
        first = np.searchsorted(starts, own - own[0])
        n_words = np.diff(first)
        hashed = [(np.arange(len(starts)), crc32_of(data, starts, sizes))] if len(starts) else []
        if longest > 1 and len(starts):
            # words joined by one space
            place = np.cumsum(sizes + 1) - (sizes + 1)
            joined = np.full(int(place[-1] + sizes[-1]), 0x20, dtype=np.uint8)
            joined[np.arange(int(sizes.sum())) + np.repeat(place - (np.cumsum(sizes) - sizes), sizes)] = data[data != 0]
            left = np.repeat(first[1:], n_words) - np.arange(len(starts))
            for k in range(2, longest + 1):
                own_k = np.flatnonzero(left >= k)
                if len(own_k):
                    hashed.append((own_k, crc32_of(joined, place[own_k], place[own_k + k - 1] + sizes[own_k + k - 1] - place[own_k])))
        n_features = sum(np.maximum(n_words - k, 0) for k in range(longest))
        at = last
        if not hashed:
            yield n_words, n_features, np.zeros(0, dtype=np.int64)
            continue
        owner, crc = (np.concatenate(x) for x in zip(*hashed, strict=True))
        if len(hashed) > 1:
            crc = crc[np.argsort(owner, kind="stable")]
        yield n_words, n_features, crc.astype(np.int64) % buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """bucket, n (features) of each bucket that has any, over all rows of the
    column ``text``. A task gives a row a bucket."""
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, found in features(batch.column(0), buckets, longest):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = texts.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Of each bucket: 1000 times the logarithm of its share in the target over its
    share in the documents, each with one feature more, rounded down. The driver
    gets at most a row a bucket of either corpus."""
    counts = []
    for texts in (docs, target):
        own = np.zeros(buckets, dtype=np.int64)
        for row in bucket_counts(texts, buckets, longest).collect():
            own[row.bucket] = row.n
        counts.append(own)
    s, t = (c.astype(np.float64) for c in counts)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight (the sum of its features' gains) of
    every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            n_words, n_features, weights = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for some, many, found in features(batch.column(1), len(gain), longest):
                sums = np.concatenate([[0], np.cumsum(gain[found])])
                last = np.cumsum(many)
                n_words.append(some)
                n_features.append(many)
                weights.append(sums[last] - sums[last - many])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x)) for x in (n_words, n_features, weights))], ["doc_id", "n_words", "n_features", "weight"])

    return id_text(docs).mapInArrow(run, f"{field_ddl(docs, 'doc_id')}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel draw of the id in thousandths, rounded down; a null id draws as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``:
    of the rows with ``least_words`` words, ``percent`` percent (rounded down) of
    the highest scores have a rank from 1 on, ties to the smaller doc_id.

    A null or empty text has no features, weight 0 and no rank. Rows that repeat a
    doc_id are drawn one by one; where id and score tie, the one of fewer features
    comes first (a null id last). Other columns than doc_id and text (of
    ``target``: text) are not read. An empty target has no features; empty
    documents give an empty result.
    """
    gain = gains(docs, target, buckets, longest)
    score = (F.col("weight") + gumbel(F.col("doc_id"), seed)).cast("long")
    scored = written(weigh(docs, gain, longest).withColumn("score", score).withColumn("place", F.monotonically_increasing_id()), "scored")
    keys = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("place")]
    fit = scored.where(F.col("n_words") >= least_words)
    ordered = fit.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("place").withColumn("at", F.monotonically_increasing_id())
    # the upper bits of such an id are the range, the lower 33 the place in it
    placed = written(ordered.withColumn("range", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1)), "ordered")
    ranges = placed.groupBy("range").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    # one row a range here
    ranges = ranges.select("range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.floor(F.sum("rows").over(every) * percent / 100).alias("drawn"))
    rank = F.col("before") + F.col("at") + 1
    drawn = placed.join(F.broadcast(ranges), "range").withColumn("rank", F.when(rank <= F.col("drawn"), rank))
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    short = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(names).union(short.select(names))
