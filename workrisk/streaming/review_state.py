"""The review log as a stream: keyed state that follows entries, deletions and
clearings in any order and any cut into micro-batches, and outlives restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from workrisk.operators.reviews import STATUSES

#: Works are dealt to so many keys, since an entry that clears everything has to
#: reach each of them.
KEYS = 32
CHANGES = "work_id string, status string, at timestamp, seq long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestReviews(StatefulProcessor):
    """Of a key's works: the last entry of each, and the last clearing. An entry is
    later by (at, seq), however late it comes. Rows out are works whose review has
    changed, with a null status where there is none any more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "work_id string", "at timestamp, seq long, status string")
        self.cleared = handle.getValueState("cleared", "at timestamp, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(["at", "seq"])
        before = self.cleared.get() if self.cleared.exists() else None
        limit = (before[0], before[1]) if before else None
        out: dict[str, tuple] = {}
        clears = found[found["work_id"].isna()]
        if len(clears):
            latest = (clears["at"].iloc[-1].to_pydatetime(), int(clears["seq"].iloc[-1]))
            if limit is None or latest > limit:
                limit = latest
                self.cleared.update(limit)
                for (work,), (at, seq, status) in list(self.last.iterator()):
                    if (at, seq) <= limit:
                        self.last.removeKey((work,))
                        if status is not None:
                            out[work] = (None, *limit)
        entries = found[found["work_id"].notna()].drop_duplicates("work_id", keep="last")
        for work, status, at, seq in zip(entries["work_id"], entries["status"], entries["at"], entries["seq"], strict=True):
            own = (at.to_pydatetime(), int(seq))
            if limit is not None and own <= limit:
                continue
            if self.last.containsKey((work,)):
                held = self.last.getValue((work,))
                if own <= (held[0], held[1]):
                    continue
            status = None if pd.isna(status) or status == STATUSES[0] else status
            self.last.updateValue((work,), (*own, status))
            out[work] = (status, *own)
        yield pd.DataFrame([(w, *x) for w, x in out.items()], columns=["work_id", "status", "at", "seq"])

    def close(self) -> None:
        pass


def changes(log: DataFrame) -> DataFrame:
    """A stream of (work_id, status, at, seq) entries as a stream of changes; an entry
    without a work clears all before it."""
    every = F.sequence(F.lit(0), F.lit(KEYS - 1))
    own = F.when(F.col("work_id").isNull(), every).otherwise(F.array(F.pmod(F.xxhash64("work_id"), F.lit(KEYS)).cast("int")))
    dealt = log.select(F.explode(own).alias("key"), "work_id", "status", F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"))
    return dealt.groupBy("key").transformWithStateInPandas(LatestReviews(), CHANGES, "Update", "None")


def follow(log: DataFrame, folder: str):
    """A started query that keeps the changes of a log under ``folder``, a table a
    micro-batch, which a repeated batch replaces; it goes on where it ended."""
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    return changes(log).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The reviews as they stand: of each work the change of the last batch."""
    found = spark.read.schema(f"{CHANGES}, batch long").option("basePath", f"{folder}/changes").parquet(f"{folder}/changes")
    last = found.withColumn("_n", F.row_number().over(Window.partitionBy("work_id").orderBy(F.desc("batch")))).where("_n = 1")
    return last.where("status IS NOT NULL").select("work_id", "status", "at", "seq")
