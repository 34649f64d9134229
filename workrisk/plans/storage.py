"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may go without it."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found is None:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="workrisk-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def _top(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/workrisk/{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


#: Spark's own switch: an execution's shuffle files go when it ends.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables stored on the way to one that kept() makes, innermost last.
_ON_THE_WAY: list[list[DataFrame]] = []


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back: what is used several times is not
    computed again, and plans stay short. Once it is written, the shuffle files it
    was made from go, instead of lying on the executors' disks until the driver
    collects garbage."""
    path = f"{_top(df.sparkSession)}/register-{uuid.uuid4().hex}"
    _write(df, path)
    return _read(df.sparkSession, df.schema, path)


def _write(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    spark = df.sparkSession
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        df.write.mode("append").option("compression", "zstd").parquet(path, partitionBy=list(by) or None)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES_GO)
        else:
            spark.conf.set(_SHUFFLES_GO, before)


def _at(spark: SparkSession, schema, path: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def _read(spark: SparkSession, schema, path: str, dealt: tuple | None = None) -> DataFrame:
    out = _at(spark, schema, path)
    out._stored, out._dealt = path, dealt and (path, *dealt)
    if _ON_THE_WAY:
        _ON_THE_WAY[-1].append(out)
    return out


def settled(make) -> DataFrame:
    """make(), stored; what it stored on the way goes."""
    _ON_THE_WAY.append([])
    out = None
    try:
        out = make()
        out = out if hasattr(out, "_stored") else stored(out)
    finally:
        for table in _ON_THE_WAY.pop():
            if out is None or table is not out:
                discard(table)
    if _ON_THE_WAY:
        _ON_THE_WAY[-1].append(out)
    return out


#: Parts that a join of whole works is stored in, one after the other, and those of
#: joins whose sources are large files, which each part reads again.
PARTS, FEW_PARTS = 8, 4


def _part(table: DataFrame, key: str, k: int, n: int) -> DataFrame:
    """The rows of part k of n. What was stored in parts is read from their folders."""
    folder, by, m = getattr(table, "_dealt", None) or (None, None, 0)
    if by != key or n % m:
        return table.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)) == k)
    own = _at(table.sparkSession, table.schema, f"{folder}/part={k % m}")
    return own if m == n else own.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)) == k)


def dealt(df: DataFrame, key: str, parts: int) -> DataFrame:
    """``df`` stored in parts by one write, for stored_in_parts() to read them singly."""
    path = f"{_top(df.sparkSession)}/register-{uuid.uuid4().hex}"
    _write(df.withColumn("part", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts))), path, ("part",))
    for k in range(parts):  # a part without rows is a folder without files, and one that has gone is an error
        at, system = _path(df.sparkSession, f"{path}/part={k}")
        system.mkdirs(at)
    return _read(df.sparkSession, df.schema, path, (key, parts))


def stored_in_parts(key: str, make, used: tuple[DataFrame, ...] = (), parts: int | None = None) -> DataFrame:
    """make(some), stored: ``some`` keeps of a table the rows whose ``key`` falls into
    one of ``parts`` (PARTS) parts, so that only the shuffle files of one part lie on the
    disks at a time. make() must treat the rows of each key by themselves.

    ``used`` are stored tables that nothing else reads any more: what was stored in
    parts goes part by part as the new ones are written, the rest at the end."""
    path, n = None, parts or PARTS
    try:
        for k in range(n):
            df = make(lambda table, k=k: _part(table, key, k, n))
            spark = df.sparkSession
            path = path or f"{_top(spark)}/register-{uuid.uuid4().hex}"
            _write(df, f"{path}/part={k}")
            for table in used:
                folder, by, m = table._dealt or (None, None, 1)
                if by == key and n % m == 0 and k >= n - m:  # the last of those that read it
                    at, system = _path(spark, f"{folder}/part={k % m}")
                    system.delete(at, True)
    finally:
        for table in used:
            discard(table)
    return _read(spark, df.schema, path, (key, n))


def discard(df: DataFrame) -> None:
    """Delete a table of stored() that nothing reads any more."""
    at, system = _path(df.sparkSession, df._stored)
    system.delete(at, True)


_KEPT: dict[tuple, DataFrame] = {}


def clear(spark: SparkSession) -> None:
    """Delete all that this application has stored."""
    _KEPT.clear()
    at, system = _path(spark, _top(spark))
    system.delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, in whatever store Spark's file systems reach."""
    at, system = _path(spark, path)
    out = system.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).head().value


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _path(spark, path)
    return system.exists(at)


def stamp(spark: SparkSession, path: str) -> tuple:
    """When the files of a table were written, and their size."""
    at, system = _path(spark, path)
    if not system.exists(at):
        return (path, None)
    status = system.getFileStatus(at)
    files = [status] if status.isFile() else list(system.listStatus(at))
    return (path, *sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in files))


def known(spark: SparkSession, key: tuple) -> bool:
    """Whether kept() has the table already."""
    return (spark.sparkContext.applicationId, *key) in _KEPT


def kept(spark: SparkSession, key: tuple, make) -> DataFrame:
    """make(), stored once an application and key, until clear(). Where files have
    changed since, what was made of the old ones goes. So do the tables that make()
    stored on the way, as soon as its result is written."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _KEPT:
        for old in [k for k in _KEPT if k[:2] == key[:2] and [x[0] for x in k[2:]] == [x[0] for x in key[2:]]]:
            discard(_KEPT.pop(old))
        _KEPT[key] = settled(make)
        if _ON_THE_WAY:
            _ON_THE_WAY[-1][:] = [t for t in _ON_THE_WAY[-1] if t is not _KEPT[key]]
    out = _at(_KEPT[key].sparkSession, _KEPT[key].schema, _KEPT[key]._stored)
    out._dealt = _KEPT[key]._dealt
    return out
