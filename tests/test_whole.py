"""Queries do the whole job: every detector, whole texts."""

from workrisk.config import INDICATORS
from workrisk.plans import catalogue


def test_scored_queries_have_all_six_detectors(spark, sf_dir):
    """The queue, the briefings and the report are those of the full register."""
    q = catalogue.queries()
    full = {r.work_id: r for r in q["register_full"](spark, sf_dir).collect()}
    plain = {r.work_id: r.risk_score for r in q["noisy_or_points"](spark, sf_dir).collect()}
    assert any(r.points_similarity > 0 for r in full.values())
    assert any(abs(r.risk_score - plain[w]) > 1 for w, r in full.items())
    top = sorted(full.values(), key=lambda r: (-r.risk_score, -r.confidence, r.work_id))[:500]
    rows = catalogue.flagship(spark, sf_dir).collect()
    assert [(r.work_id, r.risk_score, r.confidence) for r in rows] == [(r.work_id, r.risk_score, r.confidence) for r in top]
    assert {r.work_id for r in q["briefings_full"](spark, sf_dir).collect()} == {w for w, r in full.items() if r.risk_band != "Low"}
    assert {r.detector for r in q["detector_report_full"](spark, sf_dir).collect()} == set(INDICATORS)


def test_whole_texts_are_normalised(spark, tmp_path):
    spark.createDataFrame([(1, "A-b  " * 300 + "End!")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalogue.queries()["normalise_text"](spark, str(tmp_path)).head().plain == "a b " * 300 + "end"


def test_whole_texts_are_compared(spark, tmp_path):
    """Texts that share only an opening aren't alike; texts alike after it are."""
    opening, body = "the very same opening of all " * 3, " ".join(f"body{k}" for k in range(300))
    some = lambda s: " ".join(f"{s}{k}" for k in range(300))
    texts = [opening + some("x"), opening + some("yy"), some("first")[:60] + body, some("other")[:60] + body]
    df = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.work_id: r.similar_work_id for r in catalogue.queries()["d_similarity"](spark, str(tmp_path)).collect()}
    assert got[2] == 3 and got[3] == 2 and got[0] is None


def test_register_is_rebuilt_when_its_files_change(spark, tmp_path):
    from workrisk.plans import register

    for t in register.TABLES:
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    before = register.shared_works(spark, str(tmp_path)).count()
    assert register.shared_works(spark, str(tmp_path)).inputFiles() == register.shared_works(spark, str(tmp_path)).inputFiles()
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(100).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    assert before > register.shared_works(spark, str(tmp_path)).count() == 100
