"""What scored works leave on disk."""

import os
import shutil

from workrisk.operators import detectors
from workrisk.plans import register, storage


def _tables(spark):
    top = storage._top(spark).removeprefix("file:")
    return set(os.listdir(top)) if os.path.exists(top) else set()


def _rows(df):
    return sorted(map(str, df.collect()))


def test_scored_works_leave_one_table(spark, sf_dir, tmp_path):
    """Features that nothing asked for go, and are read from scored works."""
    for t in register.TABLES:
        shutil.copy(f"{sf_dir}/{t}.parquet", tmp_path)
    own = str(tmp_path)
    before = _tables(spark)
    found = register.plain_scored(spark, own)
    assert len(_tables(spark) - before) == 1
    again, works = register.shared_features(spark, own), register.shared_works(spark, own)
    assert len(_tables(spark) - before) == 1
    want = register.features(storage.stored(register.build_works(spark, sf_dir)), register.CONFIG)
    assert again.columns == want.columns and _rows(again) == _rows(want)
    assert works.columns == register.build_works(spark, sf_dir).columns
    signals = [c for c in detectors.detect(want, register.CONFIG).columns if c in found.columns]
    assert _rows(found.select("work_id", *signals)) == _rows(detectors.detect(want, register.CONFIG).select("work_id", *signals))
