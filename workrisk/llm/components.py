"""Connected components of a graph that is larger than any machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workrisk.llm.common import discard, written


def _trace(edges: DataFrame) -> tuple:
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the
    smallest node of its component.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each
    links a node's neighbours to the smallest of them, and the edges become one
    star a component after a few rounds. Every round is written to the shared
    folder. Nodes with a null are ignored; no edges give an empty result.
    """
    kind = edges.schema[a].dataType
    both = edges.select(F.col(a).alias("u"), F.col(b).cast(kind).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = written(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    trace = _trace(now)
    for _ in range(rounds):
        if not trace[0]:
            break
        each = now.union(now.select("v", "u"))
        least = each.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = each.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        last, now = now, written(small.distinct(), "edges")
        discard(last)
        before, trace = trace, _trace(now)
        if trace == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.union(found.select(F.col("root"), F.col("root")).distinct())
