"""What the operators of this subpackage share: the shared folder, written
tables, bounded Arrow batches and the piece cache of the byte-level tokenizers."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. With the byte bound below it keeps a Python worker
#: within a few hundred MB whatever the length of the texts.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
#: Texts longer than this are cut into pieces lazily, so that the list of
#: pieces of one text stays bounded too.
LONG_TEXT = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only a local session without that setting gets a temporary folder of its
    own; on a cluster the setting is required.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if found is None:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = sc.getCheckpointDir()
        if found is None:
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="workrisk-"))
            found = sc.getCheckpointDir()
    return found.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's name inside the application's part of the shared folder."""
    return f"{shared_dir(spark)}/workrisk/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder."""
    delete(spark, f"{shared_dir(spark)}/workrisk/{spark.sparkContext.applicationId}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, with a
    lineage that ends at its files, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    delete(df.sparkSession, df._written)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text (null: empty); whatever else the table has is not read."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def field_ddl(df: DataFrame, name: str) -> str:
    return f"{name} {df.schema[name].dataType.simpleString()}"


_WORKER_CACHES: list = []


def worker_cache(f):
    """What a worker makes once and keeps for its next tasks: the last one, until
    another operator's task calls only()."""
    out = functools.lru_cache(maxsize=1)(f)
    _WORKER_CACHES.append(out)
    return out


def only(*kept) -> None:
    """Called as a task begins: drop what operators other than its own have left in
    the worker, so that a worker holds one operator's tables at a time."""
    dropped = [c for c in _WORKER_CACHES if c not in kept and c.cache_info().currsize]
    for c in dropped:
        c.cache_clear()
    if dropped:
        trim()


def trim() -> None:
    """Give memory that is free back to the machine."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


class PieceCache:
    """Pre-token -> its ids as little-endian int32 bytes.

    ``encode_many`` turns a list of pre-tokens into lists of ids. Two
    generations of at most ``limit`` pieces each bound the memory: when the
    young one is full it becomes the old one, and what is met again comes back.
    """

    def __init__(self, find_all, find_iter, encode_many: Callable[[list[str]], list], limit: int = 200_000):
        self.find_all, self.find_iter, self.encode_many, self.limit = find_all, find_iter, encode_many, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Have all of ``pieces`` in the young generation."""
        new = {p for p in pieces if p not in self.young}
        if not new:
            return
        if len(self.young) + len(new) > self.limit:
            self.old, self.young = self.young, {}
            new = pieces
        back = {p for p in new if p in self.old}
        for p in back:
            self.young[p] = self.old[p]
        if len(back) < len(new):
            unseen = list(new - back)
            found = self.encode_many(unseen)
            raw = np.fromiter(chain.from_iterable(found), dtype="<i4").tobytes()
            at = 0
            for p, ids in zip(unseen, found, strict=True):
                end = at + 4 * len(ids)
                self.young[p] = raw[at:end]
                at = end

    def _join(self, found: list[list[str]]) -> list[bytes]:
        self.learn(set(chain.from_iterable(found)))
        get = self.young.__getitem__
        return [b"".join(map(get, pieces)) for pieces in found]

    def ids_many(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, as int32 bytes."""
        out: list[bytes] = []
        found: list[list[str]] = []
        size = 0
        for text in texts:
            if size + len(text) > LONG_TEXT:
                out += self._join(found)
                found, size = [], 0
            if len(text) > LONG_TEXT:
                pieces = (m.group() for m in self.find_iter(text))
                out.append(b"".join(self._join([part])[0] for part in iter(lambda: list(islice(pieces, 100_000)), [])))
            else:
                found.append(self.find_all(text))
                size += len(text)
        return out + self._join(found)


def list_array(parts: list[bytes]) -> pa.Array:
    """An Arrow list<int32> array of int32 byte strings, without a Python int per id."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
