"""The most similar other text of a block, for whole texts and blocks of any size:
TF-IDF of character n-grams inside word bounds, cosine.

Only texts travel, never their vectors, which are ten times as long; a task makes
them from a list of the block's n-grams. A block is dealt into tiles; a task holds
one tile, and all texts of the block pass by it, in slices where they are many. A
round settles a few tiles of each block, and its shuffle files go before the next, so
disk grows with the texts alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workrisk.plans.storage import discard, stored

NGRAMS = (3, 5)
#: Items and characters of a tile, tiles of a block in a round; so many tiles of texts
#: pass by a tile in one task.
TILE, LETTERS, ROUND, SLICE = 4000, 12_000_000, 2, 4
#: Rows that a block's list of n-grams is cut into.
BUCKETS = 16
#: Words and n-grams that a task remembers.
WORDS, KNOWN = 200_000, 1_000_000
#: Texts that are compared at once; n-grams that one product sums.
BATCH, SUMMED = 128, 256
#: An n-gram in one of so many items of a tile has a row of its own in a matrix.
OFTEN, MATRIX = 8, 16_000_000
#: Similarities count to nine places.
ROOM = 2e-9


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches, arrays as numpy views."""
    for batch in batches:
        columns = [(c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
        for k in range(batch.num_rows):
            yield tuple(c[0][c[1][k] : c[1][k + 1]] if isinstance(c, tuple) else c[k] for c in columns)


def listed(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0), kind))


def word_grams(word: str) -> list[str]:
    p = f" {word} "
    return [p[i : i + n] for n in range(NGRAMS[0], NGRAMS[1] + 1) if n <= len(p) for i in range(len(p) - n + 1)]


class Words:
    """Texts as numbers of n-grams with counts. Numbers below ``len(table)`` are places
    in ``table`` (sorted hashes), others are given as they come."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.more: dict[int, int] = {}
        self.pool, self.used = np.zeros(1 << 16, dtype=np.int64), 0
        self.starts, self.sizes = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)
        self.tally = np.zeros(len(self.table) + 1024)

    def full(self) -> bool:
        return len(self.words) > WORDS or len(self.more) > KNOWN

    def _learn(self, texts: list[list[str]]) -> None:
        new = list(dict.fromkeys(w for t in texts for w in t if w not in self.words))
        if not new:
            return
        parts = [word_grams(w) for w in new]
        hashes = np.array([xxhash.xxh64_intdigest(g) for p in parts for g in p], dtype=np.uint64).view(np.int64)
        at = np.searchsorted(self.table, hashes)
        known = at < len(self.table)
        known[known] = self.table[at[known]] == hashes[known]
        for k in np.flatnonzero(~known).tolist():
            at[k] = self.more.setdefault(int(hashes[k]), len(self.table) + len(self.more))
        sizes = np.array([len(p) for p in parts])
        while self.used + len(at) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while len(self.words) + len(new) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        first = len(self.words)
        self.pool[self.used : self.used + len(at)] = at
        self.starts[first : first + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : first + len(new)] = sizes
        self.used += len(at)
        self.words.update(zip(new, range(first, first + len(new)), strict=True))
        while len(self.table) + len(self.more) > len(self.tally):
            self.tally = np.zeros(2 * len(self.tally))

    def count(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers, counts) of each text's n-grams, by number."""
        split = [t.split() for t in texts]
        self._learn(split)
        for text in split:
            ids, many = np.unique(np.fromiter((self.words[w] for w in text), dtype=np.int64, count=len(text)), return_counts=True)
            sizes = self.sizes[ids]
            every = np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            grams = self.pool[every]
            np.add.at(self.tally, grams, np.repeat(many, sizes).astype(float))
            own = np.unique(grams)
            tf = self.tally[own]
            self.tally[own] = 0
            yield own, tf


class Vectors:
    """Unit vectors over a block's list of n-grams; one that isn't listed is in one
    row, so it counts for the norm alone."""

    def __init__(self, table: np.ndarray, df: np.ndarray, total: int):
        self.words, self.size = Words(table), len(table)
        self.idf = np.log((1 + total) / (1 + df)) + 1
        self.alone = math.log((1 + total) / 2) + 1

    def make(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        if self.words.full():
            self.words.clear()
        out = []
        for grams, tf in self.words.count(texts):
            listed = int(np.searchsorted(grams, self.size))
            w = 1 + np.log(tf)
            w[:listed] *= self.idf[grams[:listed]]
            w[listed:] *= self.alone
            norm = max(math.sqrt(float(w @ w)), 1e-300)
            out.append((grams[:listed].astype(np.int32), w[:listed] / norm))
        return out


class Tile:
    """Vectors by n-gram: the frequent ones in a matrix, the others in lists."""

    def __init__(self, firsts: list, own: list[tuple[np.ndarray, np.ndarray]], size: int):
        order = sorted(range(len(firsts)), key=firsts.__getitem__)
        self.firsts, own = [firsts[k] for k in order], [own[k] for k in order]
        self.place = {f: k for k, f in enumerate(self.firsts)}
        self.ends = np.cumsum([0, *(len(g) for g, _ in own)])
        self.grams = np.concatenate([g for g, _ in own])
        self.weights = np.concatenate([w for _, w in own])
        many = np.bincount(self.grams, minlength=size)
        often = np.flatnonzero(many * OFTEN >= len(own))
        often = often[np.argsort(-many[often], kind="stable")][: max(1, MATRIX // len(own))]
        often = often[many[often] > 1]
        self.row = np.full(size, -1, dtype=np.int32)
        self.row[often] = np.arange(len(often))
        owner = np.repeat(np.arange(len(own), dtype=np.int32), np.diff(self.ends))
        at = self.row[self.grams]
        self.matrix = np.zeros((len(often), len(own)), dtype=np.float32)
        self.matrix[at[at >= 0], owner[at >= 0]] = self.weights[at >= 0]
        rest = np.flatnonzero(at < 0)
        rest = rest[np.argsort(self.grams[rest], kind="stable")]
        self.owner, self.weight = owner[rest], self.weights[rest]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.grams[rest], minlength=size))])
        self.exact = np.zeros(size)
        # what single precision may have lost of a sum of at most 1
        self.lost = (SUMMED + len(often) / SUMMED + 8) * 2.0**-24

    def scores(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Similarities to the tile's items, each within ``lost``."""
        asked = np.zeros((len(vectors), len(self.matrix)), dtype=np.float32)
        out = np.zeros((len(vectors), len(self.firsts)), dtype=np.float32)
        for k, (grams, w) in enumerate(vectors):
            at = self.row[grams]
            asked[k, at[at >= 0]] = w[at >= 0]
            grams, w = grams[at < 0], w[at < 0]
            many = self.starts[grams + 1] - self.starts[grams]
            every = np.repeat(self.starts[grams] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            out[k] = np.bincount(self.owner[every], self.weight[every] * np.repeat(w, many), len(self.firsts))
        for at in range(0, len(self.matrix), SUMMED):
            out += asked[:, at : at + SUMMED] @ self.matrix[at : at + SUMMED]
        return out

    def best(self, firsts: list, vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple | None]:
        """(similarity, name) of the most similar other item, the smallest name on
        ties; None where none has anything in common. All that may be best by the
        scores is summed again in double precision."""
        scores, out = self.scores(vectors), []
        for first, (grams, w), score in zip(firsts, vectors, scores, strict=True):
            if first in self.place:
                score[self.place[first]] = -1
            some = np.flatnonzero(score >= max(float(score.max()) - 2 * self.lost - ROOM, -0.5))
            if not len(some):
                out.append(None)
                continue
            self.exact[grams] = w
            found = np.zeros(len(some))
            for n in range(0, len(some), 1000):
                part = some[n : n + 1000]
                sizes = self.ends[part + 1] - self.ends[part]
                every = np.repeat(self.ends[part] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                found[n : n + 1000] = np.bincount(np.repeat(np.arange(len(part)), sizes), self.exact[self.grams[every]] * self.weights[every], len(part))
            self.exact[grams] = 0
            found = np.round(found, 9)
            top = int(found.argmax())
            out.append((float(found[top]), self.firsts[some[top]]) if found[top] > 0 else None)
        return out


def _bucket(grams: np.ndarray) -> np.ndarray:
    return ((grams.view(np.uint64) >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32)


def gram_lists(dealt: DataFrame) -> DataFrame:
    """(block, bucket, grams, df) of rows (block, part, text, n): in how many rows of
    the block an n-gram is, for those in more than one."""
    shape = "block string, bucket int, grams array<long>, df array<long>"

    def rows(found: list[tuple[str, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        block, bucket, grams, df = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(block, pa.string()), pa.array(bucket, pa.int32()), listed(list(grams), pa.int64()), listed(list(df), pa.int64())], ["block", "bucket", "grams", "df"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(np.zeros(0, dtype=np.int64)), {}

        def parts() -> Iterator[pa.RecordBatch]:
            names = np.fromiter(words.more, dtype=np.int64, count=len(words.more))
            for block, df in seen.items():
                own = np.flatnonzero(df)
                bucket = _bucket(names[own])
                yield rows([(block, b, names[own[bucket == b]], df[own[bucket == b]]) for b in np.unique(bucket).tolist()] or [(block, 0, names[:0], df[:0])])
            seen.clear()
            words.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                block, text, n = (some.column(some.schema.get_field_index(c)).to_pylist() for c in ("block", "text", "n"))
                for b, many, (grams, _) in zip(block, n, words.count(text), strict=True):
                    df = seen.get(b)
                    if df is None or len(df) < len(words.tally):
                        seen[b] = df = np.concatenate([np.zeros(0, dtype=np.int64) if df is None else df, np.zeros(len(words.tally) - (0 if df is None else len(df)), dtype=np.int64)])
                    df[grams] += many
                if words.full() or len(seen) * len(words.tally) > 10 * KNOWN:
                    yield from parts()
        yield from parts()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def merged() -> pa.RecordBatch:
            grams, df = (np.concatenate(x) for x in zip(*held, strict=True))
            names, place = np.unique(grams, return_inverse=True)
            total = np.bincount(place, df, len(names)).astype(np.int64)
            return rows([(*at, names[total > 1], total[total > 1])])

        for block, bucket, grams, df in rows_of(batches):
            if (block, bucket) != at:
                if held:
                    yield merged()
                at, held = (block, bucket), []
            held.append((grams.copy(), df.copy()))
        if held:
            yield merged()

    own = dealt.select("block", "part", "text", "n").repartition("block", "part").mapInArrow(count, shape)
    return stored(own.repartition("block", "bucket").sortWithinPartitions("block", "bucket").mapInArrow(merge, shape))


def best_others(items: DataFrame, tile: int | None = None, letters: int | None = None, at_once: int | None = None) -> DataFrame:
    """(block, first, partner, similarity) of items (block, text, n, first), to be
    read several times: the most similar other item of the block, the smallest on ties
    to nine places; no row where it has nothing in common with any. A text that n rows
    share counts n times in the weights, (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1)."""
    tile, letters, at_once = tile or TILE, letters or LETTERS, at_once or ROUND
    kind = items.schema["first"].dataType.simpleString()
    long = F.length("text").cast("double")
    sizes = items.groupBy("block").agg(F.sum("n").alias("all"), F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(tile)), F.ceil(F.sum(long) / F.lit(letters)), F.lit(1)).cast("int").alias("tiles"), F.count(F.lit(1)).alias("_items"))
    sizes = stored(sizes.where("_items > 1").drop("_items"))
    dealt = items.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("first"), F.col("tiles")).cast("int"))
    lists = gram_lists(dealt)
    most = sizes.agg(F.max("tiles")).head()[0] or 0
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("first", kind), ("text", "string"), ("grams", "array<bigint>"), ("df", "array<bigint>"))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out, kinds = None, [], [], []
        vectors = index = None
        firsts: list = []
        own: list[tuple] = []
        waiting: list[tuple] = []
        role_of = 0

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for batch in batches:
                kinds = [batch.schema.field(n).type for n in ("block", "first", "first")] + [pa.float64()]
                yield batch

        def made() -> pa.RecordBatch:
            found = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(found, ["block", "first", "partner", "similarity"])

        def ask(names: list, asked: list[tuple]) -> None:
            out.extend((at[0], f, b[1], b[0]) for f, b in zip(names, index.best(names, asked), strict=True) if b)

        def settle() -> None:
            """What has come so far of the tile's items, or of those that pass."""
            nonlocal index
            names, texts = [f for f, _ in waiting], [t for _, t in waiting]
            waiting.clear()
            if not names or (role_of == 2 and index is None):
                return
            new = vectors.make(texts)
            if role_of == 2:
                return ask(names, new)
            firsts.extend(names)
            own.extend(new)

        def close() -> None:
            nonlocal index
            if own:
                index = Tile(firsts, own, max(1, vectors.size))
                for k in range(0, 0 if at[2] else len(own), BATCH):  # they ask once
                    ask(firsts[k : k + BATCH], own[k : k + BATCH])
                firsts.clear()
                own.clear()

        for block, number, piece, role, total, first, text, grams, df in rows_of(typed()):
            if (block, number, piece) != at:
                if at:
                    settle()
                    close()
                at, held, vectors, index, role_of = (block, number, piece), [], None, None, 0
            if role != role_of:
                if role_of:
                    settle()
                if role_of == 1:
                    close()
                role_of = role
            if not role:
                held.append((grams.copy(), df.copy()))
                continue
            if vectors is None:
                names, many = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
                order, held = np.argsort(names), []
                vectors = Vectors(names[order], many[order], total)
            waiting.append((first, text))
            if len(waiting) >= BATCH:
                settle()
            if len(out) >= 2000:
                yield made()
        if at:
            settle()
            close()
        if out:
            yield made()

    found = []
    for low in range(0, most, at_once):
        here = F.explode(F.sequence(F.lit(low), F.least(F.col("tiles"), F.lit(low + at_once)) - 1))
        slices = F.ceil(F.col("tiles") / SLICE).cast("int")
        every = F.sequence(F.lit(0), slices - 1)
        asked = dealt.where(F.col("tiles") > low).withColumn("tile", here).withColumn("role", F.when(F.col("part") == F.col("tile"), 1).otherwise(2))
        asked = asked.withColumn("slice", F.explode(F.when(F.col("role") == 1, every).otherwise(F.array(F.col("part") % slices))))
        asked = asked.select("block", "tile", "slice", "role", "all", "first", "text", none["grams"], none["df"])
        table = lists.join(sizes.where(F.col("tiles") > low), "block").withColumn("tile", here).withColumn("slice", F.explode(every))
        table = table.select("block", "tile", "slice", F.lit(0).alias("role"), "all", none["first"], none["text"], "grams", "df")
        sent = table.union(asked).repartition("block", "tile", "slice").sortWithinPartitions("block", "tile", "slice", "role")
        found.append(stored(sent.mapInArrow(run, f"block string, first {kind}, partner {kind}, similarity double")))
    discard(lists)
    if not found:
        return items.sparkSession.createDataFrame([], f"block string, first {kind}, partner {kind}, similarity double")
    every = reduce(DataFrame.union, found)
    top = every.groupBy("block", "first").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "partner")).alias("top"))
    return top.select("block", "first", F.col("top.partner").alias("partner"), (-F.col("top.s")).alias("similarity"))
