"""What lies on disk while tables are made of others in parts."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from workrisk.operators import density
from workrisk.plans import storage


def _folder(path):
    return path.removeprefix("file:")


def _tables(spark):
    top = _folder(storage._top(spark))
    return set(os.listdir(top)) if os.path.exists(top) else set()


@pytest.mark.parametrize("parts, others", [(8, 8), (4, 8), (8, 4)])
def test_sources_go_as_parts_are_written(spark, monkeypatch, parts, others):
    rows = spark.range(1000).select(F.when(F.col("id") % 10 != 0, F.col("id").cast("string")).alias("work_id"), "id")
    source = storage.stored_in_parts("work_id", lambda some: some(rows), (), parts)
    plain = storage.stored(rows)
    left, write = [], storage._write

    def seen(df, path, *more):
        write(df, path, *more)
        left.append(len(os.listdir(_folder(source._stored))))

    monkeypatch.setattr(storage, "_write", seen)
    found = storage.stored_in_parts("work_id", lambda some: some(source).join(some(plain).drop("work_id"), "id"), (source, plain), others)
    assert sorted(r.id for r in found.collect()) == list(range(1000))
    assert len(left) == others and (parts > others or left == [min(parts, others - k) for k in range(others)])
    assert not storage.exists(spark, source._stored) and not storage.exists(spark, plain._stored)


def test_a_failed_join_leaves_no_half_source(spark):
    source = storage.stored_in_parts("id", lambda some: some(spark.range(100)))
    with pytest.raises(Exception, match="halfway"):
        storage.stored_in_parts("id", lambda some: some(source).withColumn("x", F.when(F.col("id") == 17, F.raise_error(F.lit("halfway")))), (source,))
    assert not storage.exists(spark, source._stored)


def test_dealt_rows_are_read_by_part(spark):
    source = storage.dealt(spark.range(3), "id", 8)
    assert source.columns == ["id"] and source.count() == 3
    found = storage.stored_in_parts("id", lambda some: some(source))
    assert sorted(r.id for r in found.collect()) == [0, 1, 2]


def test_noise_in_parts_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.3, (200, 3)), rng.normal(4, 0.3, (150, 3)), rng.uniform(-6, 8, (150, 3))])
    x = np.concatenate([x, x[:60]])
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= 0.81
    dense = near.sum(axis=1) >= 6
    want = {k: bool(v) for k, v in enumerate(~(near & dense[None]).any(axis=1))}
    assert 0 < sum(want.values()) < len(want)
    df = storage.stored(spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "k int, a double, b double, c double"))
    for most in (density.NOISE, 10):
        monkeypatch.setattr(density, "NOISE", most)
        before = _tables(spark)
        found = density.dbscan_noise(df, ["a", "b", "c"], 0.9, 6, piece=40, sample=200, keep=["k"], part=100)
        assert found.columns == ["k", "is_noise"] and {r.k: r.is_noise for r in found.collect()} == want
        assert len(_tables(spark) - before) == 1
