"""Near-duplicate vectors by tiles in the order of principal components.

Unit vectors are rotated so that the leading coordinates, along principal axes of
a bounded sample of their table, hold most of every inner product; the others
complete the rotation, which is a product of one reflection an axis and so costs
the same a coordinate in 16 and in 4,096 dimensions. Vectors of a label are dealt
into blocks along a curve through the leading coordinates (Morton's order), which
keeps blocks small in all of them, and only blocks whose boxes are near enough form
a tile: boxes of the leading coordinates and of the norm that they leave, whose
difference no rotation of the rest can make up. In a tile the product is accumulated a
few coordinates at a time; what the rest can add is at most the product of the two
suffix norms, so rows and columns without a pair that can still reach the
threshold drop out, and the tile stops when none is left. The pairs that remain
are decided by the cosine of the given vectors in doubles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workrisk.llm.common import discard, written
from workrisk.llm.components import components

BLOCK = 512
#: Leading coordinates that bound blocks, coordinates added at a time in a tile.
BOX, STEP = 4, 8
#: Rotated coordinates are single precision; bounds get this much room.
ROOM = 1e-4
#: Principal axes of a table, and numbers of the sample that they come from.
LEAD, SAMPLE_NUMBERS = 64, 4_000_000
#: Blocks next to each other that one task holds while others pass, and the
#: numbers of a block and of such a group.
HOME, BLOCK_NUMBERS, HOME_NUMBERS = 8, 1 << 20, 1 << 21


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as (vec_id, key), and one row for each key: a label with a vector.
    key is null where a row links with nothing."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists(v, lambda x: x != 0)
    # adding 0 makes the two zeros one
    text = F.concat_ws(",", F.md5(F.col("label").cast("string").cast("binary")), F.transform(v, lambda x: (x + 0.0).cast("string")))
    rows = vectors.select("vec_id", "label", v.alias("vector"), F.when(usable, F.md5(text.cast("binary"))).alias("key"))
    kinds = rows.where("key IS NOT NULL").groupBy("key").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies")
    )
    return rows.select("vec_id", "key"), kinds.withColumn("dims", F.size("vector"))


@dataclass
class Rotation:
    """A rotation whose first coordinates lie along given axes: one reflection an
    axis, applied in turn."""

    reflectors: np.ndarray
    factors: np.ndarray

    @classmethod
    def along(cls, own: np.ndarray) -> Rotation:
        """``own`` has orthonormal columns."""
        raw, factors = np.linalg.qr(own, mode="raw")
        reflectors = np.triu(raw, 1)[: own.shape[1]]
        reflectors[np.arange(own.shape[1]), np.arange(own.shape[1])] = 1
        return cls(np.ascontiguousarray(reflectors), factors)

    def turn(self, rows: np.ndarray) -> np.ndarray:
        out = rows.copy()
        for v, f in zip(self.reflectors, self.factors, strict=True):
            out -= np.outer(out @ v, f * v)
        return out


def principal(rows: np.ndarray, most: int, rounds: int = 4) -> np.ndarray:
    """Leading principal axes of rows, as orthonormal columns (subspace iteration)."""
    k = min(most, *rows.shape)
    own = np.linalg.qr(np.random.default_rng(0).normal(size=(rows.shape[1], k)))[0]
    for _ in range(rounds):
        own = np.linalg.qr(rows.T @ (rows @ own))[0]
    _, small = np.linalg.eigh((rows @ own).T @ (rows @ own))
    return np.linalg.qr(own @ small[:, ::-1])[0]  # largest first


def axes(kinds: DataFrame) -> dict[int, Rotation]:
    """For each number of dimensions, a rotation along the principal axes of a
    sample of SAMPLE_NUMBERS numbers (chosen by key; as many arrive). Any rotation
    gives the same links, and a good one makes tiles stop early."""
    total = kinds.agg(F.sum("dims")).head()[0] or 0
    share = min(1.0, SAMPLE_NUMBERS / max(total, 1))
    some = kinds.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).orderBy("key").select("vector").toArrow()
    out = {}
    for dims, (_, rows) in unit_rows(some.column("vector").combine_chunks()).items() if some.num_rows else ():
        out[dims] = Rotation.along(principal(rows, LEAD))
    return out


def unit_rows(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dims -> (which rows, their unit vectors)."""
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy()
    lengths = np.diff(offsets)
    out = {}
    for dims in np.unique(lengths).tolist():
        which = np.flatnonzero(lengths == dims)
        rows = values[offsets[which][:, None] + np.arange(dims)]
        rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # keeps squares finite
        out[dims] = which, rows / np.linalg.norm(rows, axis=1, keepdims=True)
    return out


def along_curve(lead: np.ndarray, bits: int = 15) -> np.ndarray:
    """Places of rows in Morton's order: the bits of their coordinates in turn."""
    cells = np.clip((lead.astype(np.float64) + 1) / 2 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
    out = np.zeros(len(cells), dtype=np.int64)
    for bit in reversed(range(bits)):
        for column in cells.T:
            out = out << 1 | column >> bit & 1
    return out


def boxed(rows: np.ndarray) -> np.ndarray:
    """The leading coordinates of unit vectors, and the norm that they leave."""
    return np.column_stack([rows[:, :BOX].astype(np.float64), np.sqrt((rows[:, BOX:].astype(np.float64) ** 2).sum(axis=1))])


def make_blocks(kinds: DataFrame, rotation: dict[int, Rotation], block: int = BLOCK) -> DataFrame:
    """Blocks of at most ``block`` classes of a label, along Morton's curve: block,
    home (the group that holds it), label, dims, low and high of the leading
    coordinates and of the norm that they leave, and the rows."""
    rotation_of = kinds.sparkSession.sparkContext.broadcast(rotation)  # as many numbers as the sample at most

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, units = np.zeros(batch.num_rows, dtype=np.int64), [b""] * batch.num_rows
            turned = [b""] * batch.num_rows
            for dims, (which, rows) in unit_rows(batch.column("vector")).items():
                new = (rotation_of.value[dims].turn(rows) if dims in rotation_of.value else rows).astype("<f4")
                lead[which] = along_curve(new[:, :BOX])
                for i, u, r in zip(which.tolist(), rows, new, strict=True):
                    units[i], turned[i] = u.astype("<f8").tobytes(), r.tobytes()
            names = ["label", "dims", "lead", "key", "copies", "unit", "turned"]
            own = [batch.column(n) for n in ("label", "dims", "key", "copies")]
            yield pa.RecordBatch.from_arrays([own[0], own[1], pa.array(lead), own[2], own[3], pa.array(units, pa.binary()), pa.array(turned, pa.binary())], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, place, count, home, room = TaskContext.get().partitionId(), [], None, 0, 0, (0, 0)

        def full() -> pa.RecordBatch:
            nonlocal count, home, room
            label, dims = place
            if room[0] + 1 > HOME or room[1] + len(held) * dims > HOME_NUMBERS:
                home, room = home + 1, (0, 0)
            room = room[0] + 1, room[1] + len(held) * dims
            turned = boxed(np.frombuffer(b"".join(r[3] for r in held), dtype="<f4").reshape(len(held), dims))
            count += 1
            row = {"block": f"{part:06d}-{count:09d}", "home": f"{part:06d}-{home:09d}", "label": label, "dims": dims, "low": turned.min(axis=0).tolist(), "high": turned.max(axis=0).tolist(),
                   "keys": [r[0] for r in held], "copies": [r[1] for r in held], "units": b"".join(r[2] for r in held), "turned": b"".join(r[3] for r in held)}
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=packed.insert(2, pa.field("label", kind)))

        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field("label").type
            columns = [batch.column(n).to_pylist() for n in ("label", "dims", "key", "copies", "unit", "turned")]
            for label, dims, *row in zip(*columns, strict=True):
                if held and ((label, dims) != place or len(held) >= min(block, max(1, BLOCK_NUMBERS // max(dims, 1)))):
                    yield full()
                place = label, dims
                held.append(row)
        if held:
            yield full()

    label_ddl = kinds.schema["label"].dataType.simpleString()
    packed = pa.schema([("block", pa.string()), ("home", pa.string()), ("dims", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
                        ("keys", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())), ("units", pa.binary()), ("turned", pa.binary())])
    rows = kinds.select("key", "label", "vector", "copies", "dims")
    turned = rows.mapInArrow(rotate, f"label {label_ddl}, dims int, lead long, key string, copies long, unit binary, turned binary")
    dealt = turned.repartitionByRange("label", "dims", "lead", "key").sortWithinPartitions("label", "dims", "lead", "key")
    return dealt.mapInArrow(pack, f"block string, home string, label {label_ddl}, dims int, low array<double>, high array<double>, keys array<string>, copies array<long>, units binary, turned binary")


def near(a: np.ndarray, b: np.ndarray, threshold: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of a and of b whose product may reach the threshold, and how many
    coordinates were looked at."""
    dims = a.shape[1]
    rest = [np.sqrt(np.maximum(np.cumsum((x.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1], 0)).astype(np.float32) for x in (a, b)]
    rows, cols = np.arange(len(a)), np.arange(len(b))
    total = np.zeros((len(a), len(b)), dtype=np.float32)
    for at in range(0, dims, step):
        end = min(at + step, dims)
        total += a[rows, at:end] @ b[cols, at:end].T
        reach = total
        if end < dims:
            reach = total + np.outer(rest[0][rows, end], rest[1][cols, end])
        able = reach >= threshold - ROOM
        some, others = able.any(axis=1), able.any(axis=0)
        if not some.any():
            return rows[:0], cols[:0], end
        if some.mean() < 0.7 or others.mean() < 0.7:
            rows, cols, total, able = rows[some], cols[others], total[some][:, others], able[some][:, others]
    i, j = np.nonzero(able)
    return rows[i], cols[j], dims


def tile_links(x: dict, y: dict, threshold: float) -> list[tuple[str, int, str]]:
    """Of two blocks (or one with itself): (key, vectors linked in this tile, a
    key that stands for its links here), a row for each class with a link."""
    dims, same = x["dims"], x["block"] == y["block"]
    shape = lambda raw, kind: np.frombuffer(raw, dtype=kind).reshape(-1, dims)
    i, j, _ = near(shape(x["turned"], "<f4"), shape(y["turned"], "<f4"), threshold)
    if same:
        keep = i < j
        i, j = i[keep], j[keep]
    a, b = shape(x["units"], "<f8"), shape(y["units"], "<f8")
    for at in range(0, len(i), 1 << 16):  # exact, in bounded pieces
        part = slice(at, at + (1 << 16))
        if at == 0:
            good = np.empty(len(i), dtype=bool)
        good[part] = np.einsum("ij,ij->i", a[i[part]], b[j[part]]) >= threshold
    if not len(i) or not good.any():
        return []
    i, j = i[good], j[good]
    n = len(x["keys"])
    j = j if same else j + n
    keys = x["keys"] if same else [*x["keys"], *y["keys"]]
    copies = np.array(x["copies"] if same else [*x["copies"], *y["copies"]], dtype=np.int64)
    links = np.zeros(len(keys), dtype=np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    low = np.arange(len(keys))
    while True:  # smallest place of each local component
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            break
        low = new
    return [(keys[k], int(links[k]), keys[low[k]]) for k in np.flatnonzero(links).tolist()]


def _visits(blocks: DataFrame, apart: float) -> DataFrame:
    """The blocks of each home (visits 0), then those of later ones that a block of
    it has to meet (visits 1): a block comes once a home, not once a pair.

    Blocks meet through the squares of width ``apart`` that their first two
    coordinates span, each pair in the first square that both have, and by their
    boxes; squares with many blocks are split by adaptive execution, as the join is
    an inner one of two plain sides."""
    outline = blocks.select("block", "home", "label", "dims", "low", "high")
    cell = lambda c, k: F.floor(F.col(c)[k] / apart).cast("int")
    spans = outline
    for k, name in enumerate(("x", "y")):
        spans = spans.withColumn(f"first_{name}", cell("low", k)).withColumn(name, F.explode(F.sequence(cell("low", k), cell("high", k) + 1)))
    other = spans.select(*[F.col(c).alias(f"other_{c}") for c in spans.columns])
    same = F.lit(True)
    for c in ("label", "dims", "x", "y"):
        same = same & (F.col(c) == F.col(f"other_{c}"))
    gap = F.zip_with(F.array(F.col("low"), F.col("high")), F.array(F.col("other_high"), F.col("other_low")), lambda p, q: F.zip_with(p, q, lambda u, v: u - v))
    # the squared distance of two boxes
    square = F.aggregate(F.zip_with(gap[0], gap[1], lambda over, under: F.greatest(over, -under, F.lit(0.0))), F.lit(0.0), lambda s, g: s + g * g)
    once = (F.col("x") == F.greatest("first_x", "other_first_x")) & (F.col("y") == F.greatest("first_y", "other_first_y"))
    pairs = spans.join(other, same & once & (F.col("block") < F.col("other_block")) & (F.col("home") != F.col("other_home")) & (square <= apart * apart))
    columns = ["block", "label", "dims", "keys", "copies", "units", "turned"]
    visitors = pairs.select(F.col("home").alias("at"), F.col("other_block").alias("block")).distinct().join(blocks.drop("home"), "block")
    rows = blocks.select("home", F.lit(0).alias("visits"), *columns).union(visitors.select("at", F.lit(1), *columns))
    return rows.repartition("home").sortWithinPartitions("home", "visits", "block")


def link(vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``.

    Vectors of the same label (and number of dimensions) whose cosine in doubles
    is at least the threshold are linked. Equal vectors of a label are one class
    that is compared once and counts with its copies, so a vector with any
    number of copies costs one row. Nulls in vec_id or label and vectors that are
    null, zero, or hold null or non-finite components link with nothing and are
    components of their own. Rows that repeat a vec_id are vectors like others.
    Extra columns are not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows, kinds = classes(vectors)
    kinds = written(kinds, "vectors")
    blocks = written(make_blocks(kinds, axes(kinds), block), "blocks")
    dealt = _visits(blocks, math.sqrt(2 - 2 * threshold) + ROOM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["home"] != at:
                    at, held = r["home"], []
                found = [] if r["visits"] else tile_links(r, r, threshold)
                for own in held:
                    if (own["label"], own["dims"]) == (r["label"], r["dims"]) and own["block"] < r["block"]:
                        found += tile_links(own, r, threshold)
                if not r["visits"]:
                    held.append(r)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["key", "links", "root"])

    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")  # a row holds a block
    try:
        found = written(dealt.mapInArrow(run, "key string, links long, root string"), "links")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    discard(blocks)
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found, "key", "root").withColumnRenamed("node", "key")
    named = kinds.select("key", "first_id", "copies").join(counts, "key", "left").join(roots, "key", "left")
    named = named.withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(named, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
