"""Sharding by a hierarchical weighted hash tree.

Shards are the leaves of a tree of regions, racks and shards. A row descends
from the root: at each node every child draws a number from a hash of (key,
child), scaled by the child's weight, and the smallest draw wins. A draw
``-ln(u) / weight`` wins with probability in proportion to the weight, and a
changed weight moves rows only into or out of that child: every other draw stays
as it was. A node's weight is the sum of its shards' weights, so a change below
one region leaves the racks and shards of all others alone.

A shard added as a branch of its own therefore takes rows only into itself.
Everything is a column expression; no row leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Draws use this many bits, which a double holds exactly.
DRAW_BITS = 53


@dataclass(frozen=True)
class Shard:
    """A leaf: its number, where it stands, and its weight."""

    number: int
    region: int
    rack: int
    weight: float = 1.0


def tree(n_shards: int, base: int = 8, racks: int = 2, shards: int = 2) -> list[Shard]:
    """A tree for shards 0 to n_shards - 1: the first ``base`` fill regions of
    ``racks`` x ``shards`` leaves, each later one is a region of its own, so that
    tree(n + 1) is grow(tree(n)) from ``base`` on."""
    first = min(n_shards, base)
    per_region = racks * shards
    out = [Shard(n, n // per_region, n // shards % racks) for n in range(first)]
    while len(out) < n_shards:
        out = grow(out)
    return out


def grow(shards: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region of its own."""
    return [*shards, Shard(max(s.number for s in shards) + 1, max(s.region for s in shards) + 1, 0, weight)]


def _draw(key: Column, node: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 64 - DRAW_BITS)
    uniform = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << DRAW_BITS))
    return -F.log(uniform) / F.lit(float(weight))


def place(key: Column, shards: list[Shard]) -> Column:
    """The shard number of a key: three draws down the tree. A null key draws
    like any other value; shards without weight get nothing."""
    live = [s for s in shards if s.weight > 0]
    if not live:
        raise ValueError("no shard has a weight")

    def descend(rest: list[Shard], path: str, levels: tuple[str, ...]) -> Column:
        if not levels:
            return F.lit(rest[0].number)
        children: dict[int, list[Shard]] = {}
        for s in rest:
            children.setdefault(getattr(s, levels[0]), []).append(s)
        below = {c: descend(own, f"{path}/{c}", levels[1:]) for c, own in sorted(children.items())}
        if len(below) == 1:
            return next(iter(below.values()))
        draws = [F.struct(_draw(key, f"{path}/{c}", sum(s.weight for s in children[c])).alias("draw"), F.lit(c).alias("child")) for c in below]
        won = F.least(*draws)["child"]
        out = None
        for c, shard in below.items():
            out = F.when(won == c, shard) if out is None else out.when(won == c, shard)
        return out

    return descend(live, "", ("region", "rack", "number")).cast("int")


def number_rows(rows: DataFrame, group: str, order: list[str], slices: int) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, 2, ... within each group, without a task
    that holds a group. Rows alike in all columns are one with a count until they
    are numbered. These are dealt by a hash into slices of their group, each slice
    is numbered, and the slices' counts, summed up before it, are added."""
    alike = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    dealt = alike.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(group, "_slice").agg(F.sum("_n").alias("_rows"))
    starts = counts.select(group, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    numbered = dealt.join(starts, [group, "_slice"]).withColumn("_first", first)
    every = F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1))
    return numbered.withColumn("slot", every).drop("_slice", "_start", "_first", "_n")


def shard_documents(docs: DataFrame, shards: list[Shard], grown: list[Shard], slices: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    The law is ``key``: doc_id and the tree decide, so repeated rows and equal
    ids share a shard, and a null id has one too. A null text is empty (size 1).
    slot numbers a shard's rows from 0 without gaps; rows alike in everything
    are interchangeable. Columns other than doc_id and text are not read; an
    empty table gives an empty result. The texts stay out of the shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(F.col("doc_id"), shards).alias("shard"),
        place(F.col("doc_id"), grown).alias("grown_shard"),
    )
    found = number_rows(rows, "shard", ["doc_id", "text_crc32", "size"], slices)
    return found.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
