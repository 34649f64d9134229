"""What the trigram index moves and holds."""

from pyspark.sql import functions as F

from workrisk.operators import reviews, search


def test_postings_are_made_where_the_texts_are(spark, monkeypatch):
    """No exchange between the letters and the postings; works are small numbers."""
    seen = []
    real = search.stored
    monkeypatch.setattr(search, "stored", lambda df: (seen.append(df), real(df))[1])
    works = spark.range(3000).select(F.concat(F.lit("w"), "id").alias("work_id"), F.concat(F.lit("Lot "), F.col("id") % 97).alias("work_description"), F.rand(1).alias("risk_score"))
    index = search.SearchIndex(works, ["work_id", "risk_score"], 100)
    plan = seen[-1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" not in plan
    assert dict(index.postings.dtypes)["works"] == "array<int>"
    assert index.postings.select(F.max(F.array_max("works"))).head()[0] < 200
    for text in ("lot 9", "w29", "7", "", "zz"):
        assert [tuple(r) for r in index.find(text).collect()] == [tuple(r) for r in reviews.search(works, text).select("work_id", "risk_score").collect()]
