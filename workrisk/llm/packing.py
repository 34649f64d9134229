"""Packing documents into sequences of a fixed number of tokens by exact
complements.

Only how many pieces there are of each length matters for the plan, and there are
no more lengths than a sequence has tokens. So lengths are counted by Spark, the
driver plans on the counts, and pieces of one length, which are interchangeable,
take the plan's places by their rank.

The plan takes lengths from the longest down. What a piece leaves of a sequence is
looked up in an index of the sums of one, two and three available lengths; a
combination that fills it exactly is consumed as often as its counts allow. What
is left over is packed best fit, longest first. Short pieces fill anything, so the
plan is made with several reserves of short pieces for the second step, and the
one with the fewest sequences stands.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from workrisk.llm.common import bounded_batches, field_ddl, id_text, list_array, only, written
from workrisk.llm.token_store import library_encoder

CAPACITY, END_ID = 1024, 2
#: Pieces of a smaller share of the capacity wait for the residuals: sixteenths.
RESERVES = (0, 1, 2, 3, 4, 5)
#: Rows that the places are given to at once.
ROWS = 10_000

#: How often which lengths make up a sequence.
Pattern = tuple[dict[int, int], int]


class Sums:
    """Numbers of pieces by length, and an index of the sums of two lengths that
    are there: how many pairs make each. Sums of three go through it."""

    def __init__(self, counts: list[int]):
        self.counts = np.zeros(len(counts), dtype=np.int64)
        self.pairs = np.zeros(len(counts), dtype=np.int64)
        for length in np.flatnonzero(counts).tolist():
            self.change(length, counts[length])

    def change(self, length: int, by: int) -> None:
        before = int(self.counts[length])
        now = self.counts[length] = before + by
        if (before > 0) != (now > 0):
            others = np.flatnonzero(self.counts[: len(self.counts) - length])
            self.pairs[others[others != length] + length] += 1 if now > 0 else -1
        if (before > 1) != (now > 1) and 2 * length < len(self.pairs):
            self.pairs[2 * length] += 1 if now > 1 else -1

    def two(self, total: int, most: int) -> tuple[int, int] | None:
        """Two lengths of that sum, the longer one as long as possible."""
        if total < 2 or not self.pairs[total]:
            return None
        a = np.arange(min(most, total - 1), (total + 1) // 2 - 1, -1)
        b = total - a
        found = np.flatnonzero((self.counts[a] > 0) & (self.counts[b] > (a == b)))
        return (int(a[found[0]]), int(b[found[0]])) if len(found) else None

    def filling(self, gap: int, parts: int) -> tuple[int, ...] | None:
        if parts == 1:
            return (gap,) if self.counts[gap] > 0 else None
        if parts == 2:
            return self.two(gap, gap)
        a = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
        for first in a[(self.counts[a] > 0) & (self.pairs[gap - a] > 0)].tolist() if gap > 2 else ():
            rest = self.two(gap - first, first)
            if rest and rest.count(first) < self.counts[first]:
                return (first, *rest)
        return None


def exact_complements(counts: list[int]) -> tuple[list[Pattern], list[int]]:
    """Patterns that fill sequences of len(counts) - 1 tokens, and the counts of
    the pieces that are in none. Each pattern uses up one of its lengths."""
    capacity = len(counts) - 1
    left, out = Sums(counts), []
    if counts[capacity]:
        out.append(({capacity: 1}, counts[capacity]))
        left.change(capacity, -counts[capacity])
    for length in range(capacity - 1, 0, -1):
        for parts in (1, 2, 3):
            while left.counts[length]:
                left.change(length, -1)
                found = left.filling(capacity - length, parts)
                left.change(length, 1)
                if not found:
                    break
                pattern = Counter((length, *found))
                times = min(int(left.counts[x]) // n for x, n in pattern.items())
                for x, n in pattern.items():
                    left.change(x, -times * n)
                out.append((dict(pattern), times))
    return out, left.counts.tolist()


def best_fit(counts: list[int]) -> list[Pattern]:
    """Longest pieces first, each into the fullest sequence that has room; alike
    sequences and pieces go together."""
    capacity = len(counts) - 1
    open_: dict[int, list[Pattern]] = {}
    for length in range(capacity, 0, -1):
        left = counts[length]
        while left:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                each = capacity // length
                for n, times in ((each, left // each), (left % each, 1)):
                    if n and times:
                        open_.setdefault(capacity - n * length, []).append(({length: n}, times))
                break
            pattern, times = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
            some = min(times, left)
            if times > some:
                open_.setdefault(gap, []).append((pattern, times - some))
            open_.setdefault(gap - length, []).append((pattern | {length: pattern.get(length, 0) + 1}, some))
            left -= some
    return [p for found in open_.values() for p in found]


def plan(counts: list[int], reserves: tuple[int, ...] = RESERVES) -> list[Pattern]:
    """The patterns for counts[length] pieces of each length up to the capacity."""
    capacity, best = len(counts) - 1, None
    for sixteenths in reserves:
        short = capacity * sixteenths // 16
        used = [n if length >= short else 0 for length, n in enumerate(counts)]
        full, left = exact_complements(used)
        made = full + best_fit([n + (counts[length] - used[length]) for length, n in enumerate(left)])
        if best is None or sum(n for _, n in made) < sum(n for _, n in best):
            best = made
    return best or []


def places(patterns: list[Pattern]) -> np.ndarray:
    """The plan as rows (length, first rank, first sequence, copies in a sequence,
    offset) by length and rank; a pattern's pieces lie longest first."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            rows.append((length, used[length], sequence, pattern[length], offset))
            used[length] += pattern[length] * times
            offset += length * pattern[length]
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of the pieces of every row:
    its text's ids and the end id, cut into pieces of ``capacity`` with the rest in
    front. part and nth say where a piece stands among those of its length."""
    bounded_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<i4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *(["ids"] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(library_encoder)
        encoder = library_encoder(vocabulary, pattern)
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            owner, rows, cut = [], [], []
            for row, ids in enumerate(encoder.ids_many(batch.column(1).to_pylist())):
                ids += end
                total = len(ids) // 4
                at, piece = 0, 0
                while at < total:
                    length = (total - 1) % capacity + 1 if not at else capacity
                    own = ids[4 * at : 4 * (at + length)]
                    owner.append(row)
                    rows.append((piece, at, length, zlib.crc32(own), part, seen[length]))
                    if keep_ids:
                        cut.append(own)
                    seen[length] += 1
                    at, piece = at + length, piece + 1
            if rows:
                made = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                made[0] = made[0].cast(pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *made, *([list_array(cut)] if keep_ids else [])], names)

    ddl = f"{field_ddl(docs, 'doc_id')}, piece int, start long, length long, ids_crc32 long, part long, nth long" + (", ids array<int>" if keep_ids else "")
    return id_text(docs).mapInArrow(run, ddl)


def pack(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset (and ids) of
    every piece of every row.

    A null or empty text is one piece, the end id. Rows that repeat, and rows
    without a doc_id, are packed one by one. Other columns than doc_id and text are
    not read; an empty table gives an empty result. The driver gets a row a length.
    """
    made = written(pieces(docs, vocabulary, pattern, capacity, end_id, keep_ids), "pieces")
    spark = docs.sparkSession
    counted = written(made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = [0] * (capacity + 1)
    for row in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row.length] = row.n
    # a row a pattern and length: bounded by the capacity
    table = spark.sparkContext.broadcast(places(plan(counts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    ranked = made.join(firsts, ["part", "length"]).select(*names, (F.col("first") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        by_length, first, sequence, copies, offset = table.value.T
        # one ascending key of length and rank
        width = int(first.max(initial=0)) + 1
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(by_length * width + first, length * width + np.minimum(rank, width - 1), side="right") - 1
            nth = rank - first[at]
            found = [pa.array(sequence[at] + nth // copies[at]), pa.array(offset[at] + nth % copies[at] * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), *found], [*names, "sequence_id", "offset"])

    ddl = ", ".join(f"{c} {made.schema[c].dataType.simpleString()}" for c in names)
    return ranked.mapInArrow(run, f"{ddl}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, and doc_ids and lengths of the pieces in order, of rows of
    pack() that keep their ids. A group is one sequence, of ``capacity`` tokens at
    most."""
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    both = packed.groupBy("sequence_id").agg(held.alias("held"))
    return both.select("sequence_id", F.flatten("held.ids").alias("ids"), F.col("held.doc_id").alias("doc_ids"), F.col("held.length").alias("lengths"))
