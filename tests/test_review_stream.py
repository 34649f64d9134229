"""The review stream against the batch state, for any cut of the log."""

import random
from datetime import datetime, timedelta

import pytest

from workrisk.operators import reviews
from workrisk.streaming import review_state

DDL = "work_id string, status string, at timestamp, seq long"


def entries(seed, n=260):
    """Entries with deletions, ties in time, and two clearings."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        work = None if k in (90, 180) else f"w{rng.randint(0, 25)}"
        out.append((work, rng.choice([*reviews.STATUSES, None]), datetime(2024, 1, 1) + timedelta(hours=k // 3), k))
    return out


@pytest.mark.parametrize(("seed", "parts", "shuffled"), [(1, 4, False), (2, 3, True)])
def test_any_cut_equals_the_batch(spark, tmp_path, seed, parts, shuffled):
    rows = entries(seed)
    want = {tuple(r) for r in reviews.latest_reviews(spark.createDataFrame(rows, DDL)).select("work_id", "status", "at", "seq").collect()}
    order = list(rows)
    if shuffled:
        random.Random(seed).shuffle(order)
    for part in range(parts):  # the query ends and starts anew each time
        spark.createDataFrame(order[part * len(order) // parts : (part + 1) * len(order) // parts], DDL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        stream = spark.readStream.schema(DDL).parquet(f"{tmp_path}/log")
        review_state.follow(stream, f"{tmp_path}/state").awaitTermination()
    assert {tuple(r) for r in review_state.current(spark, f"{tmp_path}/state").collect()} == want
    assert len(want) > 5
