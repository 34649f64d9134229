"""Density noise (DBSCAN) of any number of points, exact in all dimensions.

Distinct points are dealt to the leaves of a k-d tree over a bounded sample, and a
leaf's points to pieces of bounded size. A point that has enough neighbours in its
own piece is dense without any other comparison. Only the others travel: to the
pieces of the leaves whose points' boxes lie within reach, where they are counted
against the points, and, where they stay sparse, once more against the points found
dense meanwhile. A piece is cut into cells, and whoever has enough neighbours, or lies
out of a cell's reach, is not compared with its points. The tree and the cells decide
what is compared where, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workrisk.plans.storage import PARTS, dealt, discard, stored, stored_in_parts

#: Points of a piece, and rows of the sample that the tree is grown on.
PIECE, SAMPLE = 4000, 20_000
#: Rows that a further part is worth, and noisy points that every task may hold.
PART, NOISE = 100_000, 20_000
#: Squared distances this near eps squared are computed anew from differences.
DOUBT = 1e-7
#: Queries that meet a piece at once, and points of a cell.
CHUNK, CELL = 2048, 128


class Boxes:
    """A k-d tree over a sample: cuts at medians of the widest axis."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.low, self.high, self.cuts = [], [], []
        d = sample.shape[1]

        def grow(part: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: int) -> tuple:
            spread = part.max(axis=0) - part.min(axis=0) if len(part) > 1 else np.zeros(d)
            axis = int(spread.argmax())
            cut = float(np.median(part[:, axis])) if spread[axis] > 0 else 0.0
            left = part[:, axis] <= cut
            if wanted < 2 or spread[axis] <= 0 or left.all():
                self.low.append(low)
                self.high.append(high)
                return (len(self.low) - 1,)
            below, above = high.copy(), low.copy()
            below[axis] = above[axis] = cut
            return axis, cut, grow(part[left], low, below, wanted // 2), grow(part[~left], above, high, wanted - wanted // 2)

        self.root = grow(sample, np.full(d, -np.inf), np.full(d, np.inf), leaves) if len(sample) else self._single(d)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _single(self, d: int) -> tuple:
        self.low.append(np.full(d, -np.inf))
        self.high.append(np.full(d, np.inf))
        return (0,)

    def leaf(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), dtype=np.int32)

        def walk(node: tuple, at: np.ndarray) -> None:
            if len(node) == 1:
                out[at] = node[0]
                return
            left = rows[at, node[0]] <= node[1]
            walk(node[2], at[left])
            walk(node[3], at[~left])

        walk(self.root, np.arange(len(rows)))
        return out


def in_reach(rows: np.ndarray, low: np.ndarray, high: np.ndarray, eps: float) -> np.ndarray:
    """Whether boxes lie within eps of rows: a row of the result for each of ``rows``."""
    low, high = np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)  # no number bounds nothing
    out = np.zeros((len(rows), len(low)))
    for k in range(rows.shape[1]):
        gap = np.maximum(low[:, k] - rows[:, k, None], rows[:, k, None] - high[:, k])
        np.maximum(gap, 0, out=gap)
        gap *= gap
        out += gap
    return out <= eps * eps * (1 + 1e-9)


def within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Whether rows of a and b lie within eps of each other."""
    square = a @ b.T
    square *= -2
    square += (a * a).sum(axis=1)[:, None]
    square += (b * b).sum(axis=1)
    found = square <= eps * eps
    scale = max(1.0, float(np.abs(a).max(initial=0)), float(np.abs(b).max(initial=0)))
    square -= eps * eps
    np.abs(square, out=square)
    i, j = np.nonzero(square <= DOUBT * scale * scale)
    for at in range(0, len(i), 1 << 20):
        p, q = i[at : at + (1 << 20)], j[at : at + (1 << 20)]
        exact = np.zeros(len(p))
        for k in range(a.shape[1]):
            exact += (a[p, k] - b[q, k]) ** 2
        found[p, q] = exact <= eps * eps
    return found


class Cells:
    """The points of a piece in cells of up to CELL points, cut at medians of the widest
    axis, with the boxes that just hold them. A negative weight marks a dense point."""

    def __init__(self, x: np.ndarray, weights: np.ndarray, cell: int = CELL):
        self.rows, todo = [], [np.arange(len(x))]
        while todo:
            own = todo.pop()
            if len(own) <= cell:
                self.rows.append(own)
                continue
            part = x[own]
            axis = int((part.max(axis=0) - part.min(axis=0)).argmax())
            own = own[np.argpartition(part[:, axis], len(own) // 2)]
            todo += [own[: len(own) // 2], own[len(own) // 2 :]]
        self.x, self.weights = [x[own] for own in self.rows], [weights[own] for own in self.rows]
        self.low, self.high = np.array([c.min(axis=0) for c in self.x]), np.array([c.max(axis=0) for c in self.x])

    def _count(self, k: int, rows: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
        met, dense = within(rows, self.x[k], eps), self.weights[k] < 0
        near = (met.astype(np.float64) @ np.abs(self.weights[k]).astype(np.float64)).astype(np.int64)
        return near, met[:, dense].any(axis=1)

    def met(self, rows: np.ndarray, eps: float, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """The weight within eps of each row, or of so many points that it is
        ``enough``; and, of rows without enough, whether a dense point is near."""
        near, reached = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=bool)
        reach = in_reach(rows, self.low, self.high, eps)
        for k in np.flatnonzero(reach.any(axis=0)):
            open_ = np.flatnonzero(reach[:, k] & (near < enough))
            if len(open_):
                more, dense = self._count(k, rows[open_], eps)
                near[open_] += more
                reached[open_] |= dense
        return near, reached

    def own(self, eps: float, enough: int) -> np.ndarray:
        """The weight within eps of each point of the piece, itself included, or of so
        many that it is ``enough``. Its own cell comes first."""
        near = np.zeros(sum(map(len, self.rows)), dtype=np.int64)
        for k, own in enumerate(self.rows):
            near[own] = self._count(k, self.x[k], eps)[0]
        cell, x = np.empty(len(near), dtype=np.int64), np.empty((len(near), self.low.shape[1]))
        for k, own in enumerate(self.rows):
            cell[own], x[own] = k, self.x[k]
        left = np.flatnonzero(near < enough)
        reach = in_reach(x[left], self.low, self.high, eps)
        for k in np.flatnonzero(reach.any(axis=0)):
            open_ = left[reach[:, k] & (cell[left] != k) & (near[left] < enough)]
            if len(open_):
                near[open_] += self._count(k, x[open_], eps)[0]
        return near


def _meet(rows: DataFrame, d: int, eps: float, enough: int) -> DataFrame:
    """Rows (piece, query, id, weight, x), the points of a piece before its queries, to
    what Cells.met() says of each query. A piece is held at a time; queries stream past
    it."""
    dealt = rows.repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk", "query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, points, weights, cells = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            leaf, chunk, query = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "chunk", "query"))
            ids, weight = batch.column("id").to_numpy(), batch.column("weight").to_numpy()
            change = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(chunk) != 0)) + 1
            for start, end in zip([0, *change], [*change, len(x)], strict=True):
                if at != (leaf[start], chunk[start]):
                    at, points, weights, cells = (leaf[start], chunk[start]), [], [], None
                split = start + int(np.searchsorted(query[start:end], 1))
                if split > start:
                    points.append(x[start:split])
                    weights.append(weight[start:split])
                if split < end and points:
                    cells = cells or Cells(np.concatenate(points), np.concatenate(weights))
                    for k in range(split, end, CHUNK):
                        part = slice(k, min(k + CHUNK, end))
                        near, reached = cells.met(x[part], eps, enough)
                        some = (near > 0) | reached
                        yield pa.RecordBatch.from_arrays([pa.array(ids[part][some]), pa.array(near[some]), pa.array(reached[some])], ["id", "near", "reached"])

    return dealt.mapInArrow(run, "id long, near long, reached boolean")


def _counted_within(rows: DataFrame, d: int, eps: float, enough: int) -> DataFrame:
    """Rows (leaf, chunk, id, weight, x) with near, as Cells.own() says. A piece is held
    at a time; each row travels once."""
    dealt_out = rows.select("leaf", "chunk", "id", "weight", "x").repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk")

    def judged(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        x = np.concatenate([c.flatten().to_numpy() for c in table.column("x").chunks]).reshape(-1, d)
        near = Cells(x, table.column("weight").to_numpy()).own(eps, enough)
        yield from table.append_column("near", pa.array(near)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, chunk = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "chunk"))
            change = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(chunk) != 0)) + 1
            for start, end in zip([0, *change], [*change, batch.num_rows], strict=True):
                if held and at != (leaf[start], chunk[start]):
                    yield from judged(held)
                    held = []
                at = (leaf[start], chunk[start])
                held.append(batch.slice(start, end - start))
        if held:
            yield from judged(held)

    return dealt_out.mapInArrow(run, "leaf int, chunk int, id long, weight long, x array<double>, near long")


def dbscan_noise(df: DataFrame, columns: list[str], eps: float, neighbours: int, piece: int = PIECE, sample: int = SAMPLE, keep: list[str] | None = None, part: int = PART) -> DataFrame:
    """``df`` (of it ``keep``) with is_noise: neither dense (rows of a weight of
    ``neighbours`` within eps, itself included) nor within eps of a dense row. Columns
    hold no nulls. Equal rows are one point with a weight. All goes in parts,
    of about ``part`` rows up to PARTS parts, so that only one part lies in shuffle
    files."""
    spark, d = df.sparkSession, len(columns)
    vector = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in columns])  # -0.0 becomes 0.0
    parts = max(1, min(PARTS, df.count() // part))
    every = df.select(vector.alias("x")).withColumn("_h", F.xxhash64("x"))
    points = stored_in_parts("_h", lambda some: some(every).groupBy("x").agg(F.count(F.lit(1)).alias("weight")), (), parts)
    count = points.count()
    share = min(1.0, sample / max(count, 1))
    some = points.where(F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("x").toPandas()["x"]
    matrix = np.array(some.tolist()).reshape(-1, d)
    matrix = matrix[np.lexsort(matrix.T)] if len(matrix) else matrix
    leaves = max(1, min(count // piece, max(1, len(matrix) // 8)))
    tree = spark.sparkContext.broadcast(Boxes(matrix, leaves))  # sample / 8 leaves at most

    @F.pandas_udf("int")
    def leaf_of(x: pd.Series) -> pd.Series:
        return pd.Series(tree.value.leaf(np.array(x.tolist()).reshape(-1, d)))

    placed = dealt(points.withColumns({"id": F.monotonically_increasing_id(), "leaf": leaf_of("x")}), "leaf", parts)
    discard(points)
    ends = [F.array(*[end(F.col("x")[k]) for k in range(d)]).alias(n) for n, end in (("low", F.min), ("high", F.max))]
    boxed = stored(placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(piece)).cast("int").alias("chunks"), *ends))
    chunks, found = boxed.select("leaf", "chunks"), boxed.toPandas().sort_values("leaf")  # a row a leaf
    boxes = spark.sparkContext.broadcast((found["leaf"].to_numpy(), *[np.array(found[n].tolist()).reshape(-1, d) for n in ("low", "high")]))

    @F.pandas_udf("array<int>")
    def leaves_near(x: pd.Series) -> pd.Series:
        leaf, low, high = boxes.value
        rows, step = np.array(x.tolist()).reshape(-1, d), max(1, (1 << 18) // max(1, len(leaf)))
        return pd.Series([leaf[near].tolist() for k in range(0, len(rows), step) for near in in_reach(rows[k : k + step], low, high, eps)], dtype=object)

    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    pieces = lambda rows: rows.join(F.broadcast(chunks), "leaf")  # noqa: E731  # a row a leaf
    first = stored_in_parts("leaf", lambda some: _counted_within(pieces(some(placed)).withColumn("chunk", chunk), d, eps, neighbours), (placed,), parts)
    sparse = stored(first.where(F.col("near") < neighbours).withColumn("leaves", leaves_near("x")).drop("near"))

    point = lambda rows: rows.select("leaf", "chunk", F.lit(0).alias("query"), "id", "weight", "x")

    def sent(rows: DataFrame) -> DataFrame:
        """Rows as queries to all pieces of the leaves."""
        return pieces(rows).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("leaf", "chunk", F.lit(1).alias("query"), "id", "weight", "x")

    asked = lambda rows: rows.select(F.explode("leaves").alias("leaf"), "id", "weight", "x")

    # a sparse point counts all its neighbours, and sees those that are dense already (their weight turned negative)
    def marked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("weight", F.when(F.col("near") >= neighbours, -F.col("weight")).otherwise(F.col("weight")))

    second = stored_in_parts("leaf", lambda some: _meet(point(marked(some(first))).union(sent(some(asked(sparse)))), d, eps, neighbours), (first,), parts)
    summed = lambda rows: rows.groupBy("id").agg(F.sum("near").alias("all_near"), F.max("reached").alias("reached"))
    open_ = stored_in_parts("id", lambda some: some(sparse).join(summed(some(second)), "id", "left").withColumns({"dense": F.coalesce(F.col("all_near") >= neighbours, F.lit(False)), "reached": F.coalesce("reached", F.lit(False))}), (sparse, second), parts)
    lone = open_.where("NOT dense AND NOT reached")

    third = stored_in_parts("leaf", lambda some: _meet(point(some(open_.where("dense"))).union(sent(some(asked(lone)))), d, eps, 1).where("near > 0"), (), parts)
    saved = third.select("id").distinct()
    noise = stored(lone.join(saved, "id", "left_anti").select(F.col("x").alias("_at"), F.xxhash64("x").alias("_h")))
    for table in (boxed, third, open_):
        discard(table)
    kept = df.columns if keep is None else keep
    own = df.withColumn("_x", vector).withColumn("_h", F.xxhash64("_x"))

    def joined(some, there: DataFrame) -> DataFrame:
        found = some(own).join(there.withColumnRenamed("_h", "_noise"), F.col("_x") == F.col("_at"), "left")
        return found.select(*kept, F.col("_noise").isNotNull().alias("is_noise"))

    if noise.count() <= NOISE:
        return joined(lambda table: table, F.broadcast(noise))
    return stored_in_parts("_h", lambda some: joined(some, some(noise)), (noise,), parts)
