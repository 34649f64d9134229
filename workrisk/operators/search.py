"""Reading a register by text and by place: a trigram index for searches, a rank
index for pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from workrisk.operators.ranks import running
from workrisk.operators.reviews import SEARCHED
from workrisk.plans.storage import stored

#: Works of a bucket, whose lists of works are bounded by it.
BUCKET = 5_000
#: Buckets of a task at most, once there are more of them than tasks.
TOGETHER = 8
_PAD = "\x00\x00"


class SearchIndex:
    """Postings (gram, bucket, works) of all trigrams of the searched fields, and the
    works' texts by bucket. Both are stored in order, so that a filter by gram or
    bucket reads the row groups that may hold them. A work is its place in its
    bucket, a small number; texts travel to their buckets, and postings, which hold
    a row for every letter, are made there and don't travel."""

    def __init__(self, works: DataFrame, shown: list[str], bucket: int = BUCKET):
        fields = [c for c in SEARCHED if c in works.columns]
        buckets = max(1, -(-works.count() // bucket))
        body = F.lower(F.concat_ws(" ", *fields))
        own = works.select("work_id", *[c for c in shown if c != "work_id"], body.alias("_body"), F.pmod(F.xxhash64("work_id"), F.lit(buckets)).cast("int").alias("_bucket"))
        tasks = max(int(works.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-buckets // TOGETHER))
        place = F.row_number().over(Window.partitionBy("_bucket").orderBy("work_id")) - 1
        self.bodies = stored(own.repartition(tasks, "_bucket").withColumn("_place", place))
        # two marks at the end, so that its last letters begin trigrams, too
        padded = F.concat("_body", F.lit(_PAD))
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_body")), lambda k: F.substr(padded, k, F.lit(3))))
        there = self.bodies.where(F.length("_body") > 0).select("_bucket", "_place", "_body").repartition(tasks, "_bucket")
        each = there.select("_bucket", "_place", F.explode(grams).alias("gram"))
        self.postings = stored(each.groupBy("gram", "_bucket").agg(F.sort_array(F.collect_list("_place")).alias("works")).sortWithinPartitions("gram", "_bucket"))
        self.shown = shown

    def _lists(self, needle: str) -> DataFrame:
        """The postings that a needle asks for."""
        if len(needle) < 3:
            return self.postings.where(F.col("gram").contains(needle))
        return self.postings.where(F.col("gram").isin(sorted({needle[k : k + 3] for k in range(len(needle) - 2)})))

    def candidates(self, needle: str) -> DataFrame:
        """(_bucket, _place) of the works that have all trigrams of the needle, or a
        trigram that holds a needle of one or two letters."""
        lists = self._lists(needle)
        if len(needle) < 3:
            return lists.select("_bucket", F.explode("works").alias("_place")).distinct()
        n = len({needle[k : k + 3] for k in range(len(needle) - 2)})
        both = lists.groupBy("_bucket").agg(F.collect_list("works").alias("w")).where(F.size("w") == n)
        common = F.aggregate(F.slice("w", 2, n), F.col("w")[0], lambda a, b: F.array_intersect(a, b))
        return both.select("_bucket", F.explode(common).alias("_place"))

    def find(self, text: str) -> DataFrame:
        """As reviews.search(): works with the text in the searched fields, riskiest
        first. Only candidates' texts are looked at."""
        needle = text.lower().strip()
        found = self.bodies
        if needle:
            found = found.join(self.candidates(needle), ["_bucket", "_place"], "left_semi").where(F.col("_body").contains(needle))
        return found.select(*self.shown).orderBy(F.desc("risk_score"), "work_id")

    def read(self, text: str) -> tuple[int, int, int]:
        """Postings that a search reads, works that it verifies, and works in all."""
        needle = text.lower().strip()
        works = self.bodies.count()
        return (self._lists(needle).count(), self.candidates(needle).count(), works) if needle else (0, works, works)


def rank_index(queue: DataFrame, order: list[str]) -> DataFrame:
    """The queue with rank, from 1 on in the order, stored by rank: a page, or what
    follows a row, is a filter by rank and reads one range of the files."""
    keys = {f"_o{k}": F.expr(e) for k, e in enumerate(order)}
    ranked = running(queue.withColumns(keys).withColumn("_n", F.lit(1)), list(keys)).withColumnRenamed("_upto", "rank").drop("_n", "_all", *keys)
    return stored(ranked.repartitionByRange("rank").sortWithinPartitions("rank"))


#: The riskiest first, the more certain of two alike.
QUEUE_ORDER = ["-risk_score", "-confidence", "work_id"]


def page(index: DataFrame, number: int, size: int = 100) -> DataFrame:
    """A page, from 0 on."""
    return index.where((F.col("rank") > number * size) & (F.col("rank") <= (number + 1) * size)).orderBy("rank")


def following(index: DataFrame, cursor: int | None, size: int = 100) -> DataFrame:
    """The rows behind a cursor, the rank of the last row that was shown."""
    after = cursor or 0
    return index.where((F.col("rank") > after) & (F.col("rank") <= after + size)).orderBy("rank")
