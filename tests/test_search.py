"""The trigram index against a scan, the rank index against offset and limit."""

import random

import pytest
from pyspark.sql import functions as F

from workrisk.operators import reviews, search
from workrisk.operators import validation as v


@pytest.fixture(scope="module")
def works(spark):
    rng = random.Random(3)
    words = ["road", "drain", "school", "Ward 12", "élan", "x", "Borewell", "50% share", "lot_7", "ab"]
    rows = [(f"w{k:04}", " ".join(rng.choices(words, k=rng.randint(0, 5))) if k % 9 else None, rng.choice(["Goa", "Bihar", None]), float(rng.randint(0, 40)), float(rng.randint(0, 3))) for k in range(900)]
    return spark.createDataFrame(rows, "work_id string, work_description string, state string, risk_score double, confidence double").cache()


@pytest.mark.parametrize("bucket", [50, 5000])
def test_index_equals_scan(works, bucket):
    index = search.SearchIndex(works, ["work_id", "risk_score"], bucket)
    for text in ("a", "X", "ab", "w0", "oad", "ROAD", "road school", "school Goa", " Ward 12 ", "élan", "é", "50%", "lot_7", "_", "%", "nothing here", "", "w0123", "r", "bihar"):
        want = [tuple(r) for r in reviews.search(works, text).select("work_id", "risk_score").collect()]
        assert [tuple(r) for r in index.find(text).collect()] == want, text


def test_index_reads_little(works):
    index = search.SearchIndex(works, ["work_id", "risk_score"], 50)
    lists, verified, everything = index.read("w0123")
    assert everything == 900 and verified <= 20 and lists <= 60
    plan = index._lists("w0123")._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "In(gram" in plan


def test_pages_read_one_range(spark, works):
    index = search.rank_index(works, search.QUEUE_ORDER)
    ordered = works.orderBy(F.desc("risk_score"), F.desc("confidence"), "work_id")
    for number in (0, 2, 7, 8, 9, 50):
        want = [r.work_id for r in ordered.offset(number * 100).limit(100).collect()]
        assert [r.work_id for r in search.page(index, number).collect()] == want
    seen, cursor = [], None
    while rows := search.following(index, cursor, 130).collect():
        seen += [r.work_id for r in rows]
        cursor = rows[-1]["rank"]
    assert seen == [r.work_id for r in ordered.collect()]
    assert "GreaterThan(rank" in search.page(index, 7)._jdf.queryExecution().toString()


def test_profile_of_a_wide_table(spark):
    """A hundred columns, as column by column."""
    rng = random.Random(1)
    names = [f"c{k}" for k in range(98)] + ["a b", "`", "source_row"]
    rows = [tuple(rng.choice([None, rng.randint(0, k % 7)]) for k in range(len(names))) for _ in range(120)]
    table = spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` int" for n in names)).withColumnRenamed("`", "q")
    got = {r.column: tuple(r)[2:] for r in v.column_profile(table, "t").collect()}
    assert set(got) == {*names, "q"} - {"`", "source_row"}
    for k, n in enumerate(names[:-1]):
        own = [r[k] for r in rows if r[k] is not None]
        assert got["q" if n == "`" else n] == (len(own), 120 - len(own), pytest.approx(round(100 * len(own) / 120, 1), abs=0.051), len(set(own)))
    assert {r.non_null for r in v.column_profile(table.limit(0), "t").collect()} == {0}
