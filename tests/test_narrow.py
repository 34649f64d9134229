"""What of whole works lies on disk while features are made of them."""

import os
import shutil

from pyspark.sql import functions as F

from workrisk.operators import peers
from workrisk.plans import register, storage


def _tables(spark):
    top = storage._top(spark).removeprefix("file:")
    return set(os.listdir(top)) if os.path.exists(top) else set()


def test_features_leave_one_table(spark, sf_dir, tmp_path):
    """Works, groups, payments and statistics on the way have gone; works are read from
    the features."""
    for t in register.TABLES:
        shutil.copy(f"{sf_dir}/{t}.parquet", tmp_path)
    before = _tables(spark)
    featured = register.shared_features(spark, str(tmp_path))
    assert len(_tables(spark) - before) == 1
    works = register.shared_works(spark, str(tmp_path))
    assert len(_tables(spark) - before) == 1
    assert works.columns == register.build_works(spark, sf_dir).columns
    assert works.count() == featured.count() == register.build_works(spark, sf_dir).distinct().count()


def test_statistics_carry_no_other_columns(spark, sf_dir, monkeypatch):
    """However wide works are, a step sends what it reads."""
    works = storage.stored(register.build_works(spark, sf_dir).withColumn("ballast", F.repeat(F.lit("x"), 50)))
    seen = []
    write = storage._write
    monkeypatch.setattr(storage, "_write", lambda df, path: (seen.append(("ballast" in df.columns, len(df.columns))), write(df, path)))
    featured = register.features(works, register.CONFIG)
    assert [w for w, _ in seen].count(True) == storage.PARTS and max(n for w, n in seen if not w) <= 1 + len(peers.ADDED) + 3
    assert set(featured.columns) == {*works.columns, *peers.ADDED} and featured.count() == works.count()


def test_parts_hold_every_row_once(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 10 != 0, F.col("id").cast("string")).alias("work_id"), "id")
    found = storage.stored_in_parts("work_id", lambda some: some(rows))
    assert sorted(r.id for r in found.collect()) == list(range(1000))
