"""Ranking quality against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from workrisk.operators.peers import percent_rank
from workrisk.operators.ranks import running


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """From mean ranks (Mann and Whitney); null where one class is missing."""
    ranked = percent_rank(df.select(F.col(score).alias("s"), F.col(label).cast("int").alias("y")).where("s IS NOT NULL AND y IS NOT NULL"), "s", "r")
    one = ranked.agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"), F.sum(F.col("r") * F.col("y")).alias("sum"))
    p, n = F.col("p"), F.col("n")
    return one.select(F.round(F.try_divide(F.col("sum") * n - p * (p + 1) / 2, (p * (n - p)).cast("double")), 6).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """The sum of precision times the step in recall, over distinct scores."""
    own = df.select((-F.col(score)).alias("s"), F.col(label).cast("long").alias("y")).where("s IS NOT NULL AND y IS NOT NULL")
    rows = running(own.groupBy("s").agg(F.count(F.lit(1)).alias("_n")), ["s"]).select("s", F.col("_upto").alias("seen"))
    hits = running(own.groupBy("s").agg(F.sum("y").alias("_n")), ["s"]).select(F.col("s").alias("t"), F.col("_n").alias("own"), F.col("_upto").alias("hits"), F.col("_all").alias("all"))
    both = rows.join(hits, F.col("s") == F.col("t"))
    return both.agg(F.round(F.sum(F.col("hits") / F.col("seen") * F.col("own") / F.nullif("all", F.lit(0))), 6).alias("average_precision"))


def at_k(df: DataFrame, score: str, label: str, key: str, ks: tuple[int, ...] = (25, 50, 100)) -> DataFrame:
    """Rows caught, precision, recall and lift over the base rate among the first
    k; k is never more than there are rows."""
    base = df.agg(F.coalesce(F.sum(F.col(label).cast("int")), F.lit(0)).alias("of_total"), F.count(F.lit(1)).alias("rows")).head()
    ks = sorted({min(k, base.rows) for k in ks} - {0})
    if not ks:
        return df.sparkSession.createDataFrame([], "k long, caught long, of_total long, precision_at_k double, recall_at_k double, lift double")
    ranked = running(df.select((-F.col(score).cast("double")).alias("s"), F.col(key).alias("key"), F.col(label).cast("int").alias("y"), F.lit(1).alias("_n")), ["s", "key"])
    parts = [F.struct(F.lit(k).cast("long").alias("k"), F.coalesce(F.sum(F.when(F.col("_upto") <= k, F.col("y"))), F.lit(0)).alias("caught")) for k in ks]
    rows = ranked.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*").withColumn("of_total", F.lit(base.of_total).cast("long"))
    precision, share = F.col("caught") / F.col("k"), F.lit(base.of_total / base.rows)
    return rows.select("k", "caught", "of_total", F.round(precision, 3).alias("precision_at_k"), F.round(F.try_divide(F.col("caught").cast("double"), F.col("of_total").cast("double")), 3).alias("recall_at_k"),
                       F.round(F.try_divide(precision, share), 2).alias("lift"))


def recall_by_kind(df: DataFrame, score: str, label: str, kind: str, key: str, k: int = 100) -> DataFrame:
    top = df.orderBy(F.desc(score), key).limit(k).select(F.col(key).alias("_key"), F.lit(1).alias("_in"))
    marked = df.where(F.col(label).cast("int") == 1).join(top, F.col(key) == F.col("_key"), "left")
    return marked.groupBy(kind).agg(F.count(F.lit(1)).alias("planted"), F.round(F.avg(F.coalesce("_in", F.lit(0))), 6).alias("recall"), F.round(F.avg(score), 4).alias("mean_score"))


def evaluate(df: DataFrame, score: str, label: str, key: str) -> DataFrame | None:
    """All measures in one row, or None without labels of both classes."""
    if label not in df.columns:
        return None
    one = df.agg(F.countDistinct(F.col(label)).alias("n")).head()
    if one.n < 2:
        return None
    found = at_k(df, score, label, key)
    parts = [F.max(F.when(F.col("k") == k, F.col(f"{c}"))).alias(f"{k}_{c.removesuffix('_at_k')}") for k in (25, 50, 100) for c in ("precision_at_k", "recall_at_k", "caught", "lift")]
    return roc_auc(df, score, label).crossJoin(average_precision(df, score, label)).crossJoin(found.agg(*parts))
