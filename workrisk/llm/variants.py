"""Groups of spelling variants: words one inserted, deleted or replaced code point
apart, found through positional q-gram indexes.

The index is dealt out by what near words have in common. Where the edit lies in
one half of a word, the other half is the same in both; so words of one length
(replacement), or of two neighbouring lengths (insertion), meet in shards by the
place range that holds the edit and the text around it. A pair meets in exactly
one shard: that of its first differing place. A shard of more than GROUP words is
cut again by halving its range, down to single places, where a shard holds no more
words than the alphabet has letters; so no task ever holds a large shard.

Inside a shard the bigrams that the range touches are indexed with their
positions. A word's posting lists, under the limits on position (equal, or shifted
by one) and length, are merged through a heap that skips ahead; a word that shares
as many bigrams as one edit must leave is verified.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workrisk.llm.common import LONG_TEXT, bounded_batches, discard, only, written

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: One in so many runs of a document loses a code point.
SLIP = 199
#: A form is used so many times as often as its variant, at least.
RATIO = 5
LETTERS = "A-Za-zÀ-ÿ"
#: Words of a shard that a task holds; different words that a task counts at once;
#: links of one batch.
GROUP, HELD, ROWS = 2000, 200_000, 20_000
Q = 2
REPLACED, INSERTED = 0, 1


def _runs(text: str, pattern: re.Pattern) -> Counter:
    # bytes.lower() touches A-Z alone
    lowered = text.encode().lower().decode()
    return Counter(pattern.findall(lowered) if len(text) <= LONG_TEXT else (m.group() for m in pattern.finditer(lowered)))


def slipped(run: str, start: int, slip: int = SLIP) -> str:
    """The run, or without one code point where its CRC32 says so; ``start`` is the
    CRC32 of what stands before it."""
    h = zlib.crc32(run.encode(), start)
    if h % slip:
        return run
    place = h % len(run)
    return run[:place] + run[place + 1 :]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """word, n of all words of the documents that are long and frequent enough. A
    task sends on a bounded number of counted words at a time."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        pattern = re.compile(f"[{LETTERS}]{{{least_length},}}")
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, n in _runs(text, pattern).items():
                    held[slipped(word, start, slip)] += n
                if len(held) > HELD:
                    yield rows()
        yield rows()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counted = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= least_count) & (F.char_length("word") >= least_length))


def merge(lists: list[list[int]], need: int) -> Iterator[int]:
    """The numbers that stand in ``need`` of the ascending lists or more, ascending.

    A heap holds the next number of each list. Where the smallest stands in too
    few, need - 1 lists in all can hold nothing before the next number of the
    others, and skip to it.
    """
    width = len(lists)
    heap = [found[0] * width + k for k, found in enumerate(lists)]
    heapq.heapify(heap)
    at = [0] * width
    while len(heap) >= need:
        value = heap[0] // width
        out = []
        while heap and heap[0] // width == value:
            out.append(heapq.heappop(heap) % width)
        if len(out) >= need:
            yield value
            target = value + 1
        else:
            while heap and len(out) < need - 1:
                out.append(heapq.heappop(heap) % width)
            if not heap:
                return
            target = heap[0] // width
        for k in out:
            found = lists[k]
            at[k] = place = bisect_left(found, target, at[k])
            if place < len(found):
                heapq.heappush(heap, found[place] * width + k)


def first_difference(a: str, b: str) -> int:
    for k, (x, y) in enumerate(zip(a, b)):  # noqa: B905  the longer one's end is a difference
        if x != y:
            return k
    return min(len(a), len(b))


def near_in_shard(words: list[str], kind: int, length: int, first: int, last: int) -> Iterator[tuple[int, int]]:
    """Places of the near pairs of ``words`` whose edit lies in the places first to
    last: of words of ``length`` (replacement), or of a word of ``length`` and one
    that has one code point more at that place.

    A bigram is touched by an edit at its own places only, so of the bigrams over
    the range all but Q are shared after a replacement; an insertion parts one.
    """
    places = range(max(0, first - Q + 1), min(length - Q, last if kind == REPLACED else last - 1) + 1)
    need = len(places) - (Q if kind == REPLACED else Q - 1)
    index: dict[tuple[int, str], list[int]] = {}
    shorter: list[int] = []

    def candidates(word: str) -> Iterator[int]:
        if need <= 0:
            return iter(shorter)
        found = []
        for p in places:
            grams = {word[p : p + Q]} if kind == REPLACED else {word[p : p + Q], word[p + 1 : p + 1 + Q]}
            found += [x for g in grams if (x := index.get((p, g)))]
        return merge(found, need)

    def post(k: int, word: str) -> None:
        shorter.append(k)
        for p in places if need > 0 else ():
            index.setdefault((p, word[p : p + Q]), []).append(k)

    if kind == INSERTED:
        for k, word in enumerate(words):
            if len(word) == length:
                post(k, word)
        if not shorter:
            return
    for k, word in enumerate(words):
        if kind == REPLACED:
            for j in candidates(word):
                d = first_difference(words[j], word)
                if first <= d <= last and words[j][d + 1 :] == word[d + 1 :]:
                    yield j, k
            post(k, word)
        elif len(word) > length:
            for j in candidates(word):
                d = first_difference(words[j], word)
                if first <= d <= last and words[j][d:] == word[d + 1 :]:
                    yield j, k


def _keyed(ranges: DataFrame) -> DataFrame:
    """With the shard that a word of a place range belongs to: what stands before
    and behind the range, which in the shorter word of an insertion is one less."""
    kind, length, word = F.col("kind"), F.col("length"), F.col("word")
    behind = F.col("last") + 2 - F.when((kind == INSERTED) & (F.char_length(word) == length), 1).otherwise(0)
    around = F.concat(F.substr(word, F.lit(1), F.col("first")), F.lit("|"), F.substr(word, behind))
    return ranges.withColumn("shard", F.xxhash64(kind, length, F.col("first"), F.col("last"), around))


def _halved(ranges: DataFrame) -> DataFrame:
    middle = F.shiftright(F.col("first") + F.col("last") + 1, 1)

    def part(first: Column, last: Column) -> Column:
        return F.struct("word", "n", "kind", "length", first.alias("first"), last.alias("last"))

    return ranges.select(F.explode(F.array(part(F.col("first"), middle - 1), part(middle, F.col("last")))).alias("r")).select("r.*")


def _links_of_shards(ranges: DataFrame) -> DataFrame:
    """word, near, near_n for both words of each pair that its shard holds."""
    keys = ["shard", "kind", "length", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        out: tuple[list, list, list] = ([], [], [])

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "near", "near_n"])
            for x in out:
                x.clear()
            return made

        stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for key, members in groupby(stream, key=lambda r: r[:5]):
            held = list(members)
            if len(held) < 2:
                continue
            for j, k in near_in_shard([r[5] for r in held], *key[1:]):
                for a, b in ((held[j], held[k]), (held[k], held[j])):
                    out[0].append(a[5])
                    out[1].append(b[5])
                    out[2].append(b[6])
                if len(out[0]) >= ROWS:
                    yield rows()
        yield rows()

    dealt = ranges.select(*keys, "word", "n").repartition("shard").sortWithinPartitions(*keys, "word")
    return dealt.mapInArrow(run, "word string, near string, near_n long")


def links(vocabulary: DataFrame, group: int = GROUP) -> DataFrame:
    """word, near, near_n of every two near words of ``vocabulary`` (word, n; each
    word once), in both directions, each once."""
    bounded_batches(vocabulary.sparkSession)
    size = F.char_length("word")

    def part(kind: int, length: Column, last: Column) -> Column:
        return F.struct("word", "n", F.lit(kind).alias("kind"), length.alias("length"), F.lit(0).alias("first"), last.alias("last"))

    # a replacement at one of its places; an insertion into it, or into a shorter one
    roots = F.array(part(REPLACED, size, size - 1), part(INSERTED, size, size), part(INSERTED, size - 1, size - 1))
    ranges = _halved(vocabulary.where(size > 0).select(F.explode(roots).alias("r")).select("r.*"))
    found = None
    while True:
        keyed = _keyed(ranges)
        large = keyed.groupBy("shard").agg(F.count(F.lit(1)).alias("words"), F.max(F.col("first") < F.col("last")).alias("divisible")).where((F.col("words") > group) & F.col("divisible"))
        large = written(large.select("shard"), "large_shards")
        if not large.head(1):
            discard(large)
            own = _links_of_shards(keyed)
            return found.union(own) if found is not None else own
        own = _links_of_shards(keyed.join(large, "shard", "left_anti"))
        found = found.union(own) if found is not None else own
        # a range of one place goes no further: its shard is bounded by the alphabet
        ranges = written(_halved(keyed.join(large, "shard", "left_semi").where("first < last").drop("shard")), "ranges")


def _roots(forms: DataFrame, rounds: int = 40) -> DataFrame:
    """word, root of each (word, form): the last one of the forms that follow. Each
    round doubles how far a row has followed; forms grow in use, so none returns."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = step.select("word", "root")
        now._written = step._written
        if not step.where("moved").head(1):
            return now
    raise RuntimeError("the forms did not end")


def group_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, slip: int = SLIP, group: int = GROUP) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of ``docs``.

    ``form`` is the near word in widest use (ties: the smallest in code-point
    order) where it is used ``ratio`` times as often, else null; ``root`` is where
    the forms lead, the word itself where it has none. A null or empty text has no
    words, a null doc_id counts as empty in the hash, rows that repeat count each
    time; other columns are not read; an empty table gives an empty result.
    """
    vocabulary = written(word_counts(docs, least_length, least_count, slip), "words")
    best = links(vocabulary, group).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    wide = F.col("best.less") * -1 >= ratio * F.col("n")
    own = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(wide, F.col("best.near")).alias("form"), F.when(wide, -F.col("best.less")).alias("form_n")
    )
    own = written(own, "variants")
    return own.join(_roots(own.where("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "n", "n_near", "form", "form_n", "root")
