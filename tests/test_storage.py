"""What a stored table leaves on disk."""

import os

from pyspark.sql import functions as F

from workrisk.plans import storage


def _files(top):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(top) for f in names if f.startswith("shuffle_"))


def _local(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()


def test_shuffle_files_go_with_the_write(spark):
    tops = list(_local(spark))
    wide = spark.range(200_000).select((F.col("id") % 1000).alias("k"), "id").repartition(4, "k")
    before = sum(map(_files, tops))
    assert storage.stored(wide).count() == 200_000
    assert sum(map(_files, tops)) <= before + 10_000
    assert spark.conf.get(storage._SHUFFLES_GO, None) is None


def test_tables_on_the_way_go(spark):
    """Only the result of kept() stays, and what kept() made inside of it."""
    seen = []

    def inner():
        seen.append(storage.stored(spark.range(3)))
        return seen[-1].select((F.col("id") * 2).alias("id"))

    def outer():
        seen.append(storage.stored(storage.kept(spark, ("inner", ("a", 1)), inner)))
        return seen[-1].where("id > 0")

    found = storage.kept(spark, ("outer", ("a", 1)), outer)
    assert sorted(r.id for r in found.collect()) == [2, 4]
    assert [storage.exists(spark, t._stored) for t in seen] == [False, False]
    assert storage.kept(spark, ("inner", ("a", 1)), inner).count() == 3 and len(seen) == 2
