"""The screening engine: parsers, sources, detectors, scores and the benchmark."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from workrisk.config import CAPS, INDICATORS, RULES, RiskConfig, check_caps
from workrisk.functions import numeric, text
from workrisk.operators import benchmark, build, datagen, density, detectors, evaluation, multivariate, peers, reviews, rollups, scoring, similarity
from workrisk.operators import validation as v
from workrisk.plans import adapter, register
from workrisk.sources import exports, sinks
from workrisk.sources.workbook import read_workbook, sheet_names, write_workbook
from workrisk.streaming import alerts


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).head().y


@pytest.mark.parametrize(
    "raw, want",
    [("500000", 500000), ("1,25,000", 125000), ("₹ 3,00,000", 300000), ("(5000)", -5000), ("", None), ("n/a", None), ("not a number", None), ("1-2", None), ("Rs. 500", 0.5), (None, None), ("nan", None),
     ("\t(500)", -500), ("(500)\n", -500), ("\u00a0₹\u20031,000\r\n", 1000), ("( 5 )", -5), ("\t\n", None), ("5-", None), ("--5", None), (".", None)],
)
def test_amounts(spark, raw, want):
    assert one(spark, raw, text.parse_amount) == want


@pytest.mark.parametrize("raw, want", [("01-Apr-2023", "2023-04-01"), ("1-Apr-2023", "2023-04-01"), ("5/4/2023", "2023-04-05"), ("2023-04-01", "2023-04-01"), ("rubbish", "None"), (None, "None"),
    *[(x, "2023-04-01") for x in ("\t01-Apr-2023\n", "01-Apr-2023\u00a0", "1 April 2023", "1 Apr 2023", "1-April-2023", "2023/04/01", "2023.04.01", "01.04.2023", "1-Apr-23", "1/4/23", "01-04-23", "1.4.23", "20230401", "Apr 1, 2023", "April 1 2023", "1st April 2023",
        "Saturday, 1 April 2023", "Sat 1 Apr 2023", "01Apr2023", "1-apr-2023", "01-APR-2023", "1/Apr/2023", "2023-Apr-01", "01 04 2023", "2023-04-01 10:20:30", "2023-04-01T10:20:30.5", "01/04/2023 10:20", "Apr 2023", "2023-4-1")],
    ("04/13/2023", "2023-04-13"), ("13/04/2023", "2023-04-13"), ("15 Sept 2023", "2023-09-15"), ("2 May 99", "1999-05-02"), ("31/02/2023", "None"), ("", "None"), ("12:30", "None"), ("Monday", "None"), ("1 2", "None")])
def test_dates(spark, raw, want):
    assert str(one(spark, raw, text.parse_date)) == want


def test_total_lines_in_any_white_space(spark):
    rows = ["\tGrand total\n", "\u00a0TOTAL\u2003", "grand total of all", " subtotal\r\n", "totally", "12", None, "the total"]
    table = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "n int, key string")
    assert [r.n for r in table.where(v.is_summary(F.col("key"))).orderBy("n").collect()] == [0, 1, 2, 3]


def test_text_parsers(spark):
    work = "WS/MP1/2023-2024/101-Construction of CC road"
    assert one(spark, work, text.work_id) == "WS/MP1/2023-2024/101"
    assert one(spark, "WS/MP18283/2025-2026/238259", text.work_id) == "WS/MP18283/2025-2026/238259"
    assert one(spark, "nothing", text.work_id) is None
    assert one(spark, work, text.without_work_id) == "Construction of CC road"
    assert one(spark, "SAMBHAL(DISTRICT MAGISTRATE)", text.district) == "Sambhal"
    assert one(spark, "SOUTH-24 PARGANAS O'BRIEN(x", text.district) == "South-24 Parganas O'Brien"
    assert one(spark, "no place", text.district) is None
    assert one(spark, "Shri Javed Ali Khan (2022-28) (2022-2028)", text.member_name) == "Shri Javed Ali Khan"
    assert one(spark, "  CC Road,  Ward-5! रोड ", text.normalise) == "cc road ward 5 र ड"
    assert one(spark, "P.C.C ??? ?? ???????", text.is_mojibake) is True
    assert one(spark, "plain", text.is_mojibake) is False and one(spark, None, text.is_mojibake) is False


def test_formats(spark):
    assert [one(spark, x, text.rupees, "double") for x in (None, 12_345_678.0, 250_000.0, 999.5)] == ["an unrecorded amount", "Rs 1.23 crore", "Rs 2.50 lakh", "Rs 1,000"]
    assert [one(spark, x, text.indian_grouping, "double") for x in (None, 1.0, 999.0, 1000.0, 123456.0, 12345678.0, -1234567.0)] == ["—", "1", "999", "1,000", "1,23,456", "1,23,45,678", "-12,34,567"]
    assert [one(spark, x, text.ordinal, "long") for x in (1, 2, 3, 4, 11, 12, 13, 21, 111)] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "111th"]
    assert one(spark, 12_000_000.0, text.compact_rupees, "double") == "₹1.2Cr"


def test_ramp_and_haversine(spark):
    assert [one(spark, x, lambda c: numeric.ramp(c, 1, 3), "double") for x in (None, 0.0, 1.0, 2.0, 9.0)] == [None, 0, 0, 0.5, 1]
    assert [one(spark, x, lambda c: numeric.ramp_or_zero(c, 2), "double") for x in (None, 1.0)] == [0, 0.5]
    km = one(spark, 0.0, lambda c: numeric.haversine_km(c, c, c, c + 1), "double")
    assert math.isclose(km, 111.19, abs_tol=0.01)


# ------------------------------------------------------------------- sources


@pytest.fixture
def folder(tmp_path):
    s = list(exports.SANCTIONED)
    row = lambda n, i, amount, status, word="road": [n, f"WS/MP1/2023-2024/{i}-Construction of {word}", "Normal/Others", "Bihar", "GAYA(DISTRICT MAGISTRATE GAYA_IDA)", "Shri A B (2019-24)", "Elected", f"total {word}", "01-Apr-2023", "10-Apr-2023", amount, status]
    write_workbook(f"{tmp_path}/{exports.FILES['sanctioned']}", [["Report"], s, row("1", 101, "500000", "Work Completed"), row("2", 102, "1,25,000", "Sanction", "drain"), row("3", 103, "1", "17629503056.99"),
                   *[row(str(k), 100 + k, "250000", status) for k, status in enumerate(("Physical Inspection", "Vendor Identification", "Work partially Completed", "Time Estimation", "Sanctioned"), 4)], ["Grand Total", None]])
    write_workbook(f"{tmp_path}/{exports.FILES['completed']}", [["Report"], list(exports.COMPLETED), ["1", "WS/MP1/2023-2024/101-x", "01-Sep-2023", "495000"]])
    pay = lambda n, i, kind, who, day, status, amount: [n, f"WS/MP1/2023-2024/{i}", kind, who, day, status, amount]
    write_workbook(f"{tmp_path}/{exports.FILES['expenditure']}", [["Report"], list(exports.EXPENDITURE), pay("1", 101, "Roads", "Vendor A", "01-Jun-2023", "Payment Success", "300000"), pay("2", 101, "Roads", "Vendor A", "01-Aug-2023", "Payment Success", "195000"),
                   pay("3", 102, "Drainage", None, "01-Jul-2023", "In-Progress", "60000"), pay("4", 102, "Drainage", "V", "01-Jul-2023", "Payment Success", "600000000"), ["Grand Total", None, None, None, None, None, "12761418099"]])
    write_workbook(f"{tmp_path}/{exports.FILES['allocation']}", [["Report"], ["Sr. No.", "State", "Constituency", "Hon'ble Members of Parliaments", "Allocated AMOUNT ( ₹ )"], ["1", "Bihar", "Gaya", "Shri A B (2019-24)", "50000000"], ["Total", None]])
    return str(tmp_path)


def test_workbook(spark, folder):
    path = f"{folder}/{exports.FILES['sanctioned']}"
    df = read_workbook(spark, path)
    assert sheet_names(path) == ["Sheet1"] and df.columns[0] == "Sr. No." and df.columns[-4:] == ["source_row", "source_file", "source_sheet", "ingested_at"]
    rows = df.collect()
    assert len(rows) == 9 and rows[0].source_row == "3" and rows[1]["Sanction Amount ( ₹ )"] == "1,25,000"
    with pytest.raises(Exception, match="no workbook"):
        read_workbook(spark, f"{folder}/nothing.xlsx").count()
    with pytest.raises(v.IngestError, match="Nope"):
        v.require_columns(df, ["Nope"], "x")


def test_ingest(spark, folder):
    out = exports.ingest(spark, folder)
    works = {r.work_id[-3:]: r for r in out["works"].collect()}
    assert set(works) == {"101", "102", "104", "105", "106", "107"} and {r.work_status for r in works.values()} == set(v.STATUSES)
    a, b = works["101"], works["102"]
    assert (a.total_expenditure, a.payment_count, a.max_single_payment, a.distinct_vendors, a.is_completed) == (495000, 2, 300000, 1, True)
    assert (b.sanction_amount, b.primary_vendor, b.payments_not_successful, b.district, b.mp_name, b.has_recommendation) == (125000, None, 1, "Gaya", "Shri A B", False)
    reasons = {(r.source, r.reason): r.rows for r in out["quarantine"].summary().collect()}
    assert reasons == {("sanctioned", v.SUMMARY): 1, ("sanctioned", v.NO_STATUS): 2, ("expenditure", v.SUMMARY): 1, ("expenditure", "Payment exceeds the plausibility ceiling of Rs 500,000,000"): 1, ("allocation", v.SUMMARY): 1}
    assert out["allocation"].count() == 1 and out["pipeline"] is None
    one_row = v.matching_report(out["spine"], out["completed"], out["payments"]).head()
    assert (one_row.sanctioned_records, one_row.sanctioned_distinct_ids, one_row.completed_matched_to_sanctioned, one_row.match_rate_completed_pct) == (6, 6, 1, 100.0)


def test_command_line(spark, folder, tmp_path, capsys):
    from workrisk.__main__ import main

    main(["build", "--data-dir", folder, "--outdir", f"{tmp_path}/tables", "--as-of", "2026-01-01"], spark)
    report = sinks.read_report(spark, f"{tmp_path}/tables/ingest_report.json")
    assert report["coverage"]["works_total"] == 6 and report["matching"]["completed_matched_to_sanctioned"] == 1 and report["quarantined_rows"] == 6
    main(["score", "--data-dir", f"{tmp_path}/tables", "--outdir", f"{tmp_path}/scored", "--details", "all"], spark)
    assert sinks.work_detail(spark, f"{tmp_path}/scored", "WS/MP1/2023-2024/101").work_status == "Work Completed"
    assert "points don't add up: 0" in capsys.readouterr().out


def test_benchmark_command(spark, tmp_path, capsys):
    from workrisk.__main__ import main

    main(["benchmark", "--n", "300", "--seed", "7", "--outdir", str(tmp_path)], spark)
    assert sinks.read_report(spark, f"{tmp_path}/benchmark.json")["roc_auc"] > 0.75
    blocks = {r.block: r.content for r in spark.read.json(f"{tmp_path}/payload").collect()}
    assert set(blocks) == {"meta", "generated_by", "disclaimer", "dashboard", "priority_queue", "agencies", "benchmark"} and '"projects_analysed": 300' in blocks["dashboard"]
    one = spark.read.json(f"{tmp_path}/projects").select(F.from_json("record", "isolation_forest_score double, dbscan_is_noise double, risk_score double").alias("r")).select("r.*")
    assert one.where("isolation_forest_score BETWEEN 0 AND 1 AND dbscan_is_noise IN (0, 1)").count() == 300
    assert '"config_version": "v1"' in blocks["meta"] and blocks["meta"].count("data") > 3
    assert spark.read.json(f"{tmp_path}/projects").count() == 300 == spark.read.option("header", True).csv(f"{tmp_path}/scored").count()
    back = sinks.read_csv(spark, f"{tmp_path}/scored", ("project_id", "sanction_date"), benchmark.TYPES)
    assert dict(back.dtypes)["sanction_date"] == "date" and dict(back.dtypes)["project_id"] == "string" and back.where("sanction_date IS NULL").count() == 0
    with pytest.raises(ValueError, match="nothing"):
        sinks.read_csv(spark, f"{tmp_path}/scored", ("nothing",), {})


def test_multiplied_work_is_named(spark):
    with pytest.raises(AssertionError, match="w1"):
        build.check_unmultiplied(spark.createDataFrame([("w1",), ("w1",)], "work_id string"))


def test_sinks(spark, tmp_path, scored, sf_dir):
    r = sinks.records(scored.limit(5)).head()
    assert '"rule_reasons":""' not in r.record and "null" not in r.record
    report = {"config": {"as_of_date": adapter.AS_OF, "data_mode": "x", "source_label": "y", "files": {"a": "b"}}}
    some = scored.orderBy("work_id").limit(50).cache()
    open_ = adapter.recommended(spark, sf_dir).where("work_id IS NULL AND sanction_date IS NULL")
    sinks.export_register(some, str(tmp_path / "out"), report, "flagged", 10, allocation=adapter.allocation(spark, sf_dir), open_=open_)
    assert spark.read.parquet(str(tmp_path / "out" / "works")).count() == 50
    blocks, works = sinks.read_payload(spark, str(tmp_path / "out"))
    assert set(blocks) == {"meta", "dashboard", "detectors", "rules", "data_quality", "priority_queue", "similar_pairs", "national", "rollups", "trends", "fund_utilisation", "early_warning", "recommendation_pipeline", "detail_scope", "detail_available_for"}
    assert works.count() == 50 and len(blocks["priority_queue"]) == 10 and blocks["national"]["works"] == blocks["dashboard"]["works_total"] == 50
    assert (blocks["meta"]["engine_version"], blocks["meta"]["config_version"]) == ("v2.0", "risk-v2-1")
    assert {"rule_id", "name", "rule_type", "source", "status", "records_flagged", "explanation"} <= set(blocks["rules"][0]) and all(r["explanation"] for r in blocks["rules"])
    (lacking,) = [r for r in blocks["rules"] if r["status"] == "not_evaluated"]
    assert "inadmissible_category" in lacking["explanation"]
    assert [d["status"] for d in blocks["detectors"]] == ["active"] * 6 and all(set(d) == {"detector", "status", "reason", "records_evaluated", "records_flagged", "missing_fields"} for d in blocks["detectors"])
    assert all({"work_id", "similar_work_id", "state", "work_category", "sanction_amount", "work_description"} <= set(p) for p in blocks["similar_pairs"])
    assert "members match" in blocks["fund_utilisation"]["note"] or "could not be joined" in blocks["fund_utilisation"]["note"]
    few = detectors.detector_details(scored.drop("district"), ("similarity",))
    assert few[0]["status"] == "active" and detectors.detector_details(scored.drop("district").withColumn("signal_similarity", F.lit(None).cast("double")), ("similarity",))[0]["missing_fields"] == ["district"]
    assert blocks["recommendation_pipeline"]["works"] == open_.count() and set(blocks["rollups"]) == {"state", "district", "mp", "vendor"}
    flagged = some.where("risk_band <> 'Low'").head()
    assert sinks.work_detail(spark, str(tmp_path / "out"), flagged.work_id).risk_score == flagged.risk_score and sinks.work_detail(spark, str(tmp_path / "out"), "none") is None
    path = sinks.export_csv(spark, [{"a": 'x,"y"', "b": None}], ["a", "b"], str(tmp_path), "rows")
    assert open(path, "rb").read() == '﻿a,b\r\n"x,""y""",\r\n'.encode()
    assert sinks.read_table(spark, str(tmp_path / "no"), optional=True) is None
    assert "points don't add up: 0" in sinks.console_report(scored)


# -------------------------------------------------------------------- engine


@pytest.fixture(scope="module")
def scored(spark, sf_dir):
    return register.scored(spark, sf_dir).cache()


def test_cascade_counts_only_what_is_left(spark):
    rows = [("a", "X", "c", "S")] * 3 + [("b", "X", "c", "S")] * 2 + [("d", None, "c", "S")] * 2
    df = spark.createDataFrame([(f"{w}{k}", t, c, s) for k, (w, t, c, s) in enumerate(rows)], "work_id string, work_type string, work_category string, state string")
    df = df.withColumn("work_type", F.when(F.col("work_id").startswith("b"), F.lit("Y")).otherwise(F.col("work_type")))
    got = {r.work_id[0]: (r.peer_level, r.peer_size) for r in peers.assign_peers(df, 3).collect()}
    assert got == {"a": ("work_type + state", 3), "b": ("category + state", 4), "d": ("category + state", 4)}
    assert {r.peer_level for r in peers.assign_peers(df, 50).collect()} == {"insufficient"}


def test_robust_z_fallbacks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 9.0), ("b", 5.0), ("b", 5.0), ("b", 5.0), ("b", 8.0), ("c", 4.0), ("d", None)], "g string, x double")
    got = {(r.g, r.x): r.robust_z for r in peers.robust_z(df, "g", "x").collect()}
    assert math.isclose(got["a", 9.0], 7 / 1.4826) and got["c", 4.0] == 0 and got["d", None] == 0
    assert math.isclose(got["b", 8.0], 3 / np.std([5, 5, 5, 8], ddof=1))


def test_points_add_up_and_caps(spark, scored):
    assert scoring.decomposition_gaps(scored).count() == 0
    top = scored.agg(*[F.max(f"points_{n}").alias(n) for n in INDICATORS]).head()
    assert all(top[n] <= 100 * CAPS[n] + 0.01 for n in INDICATORS)
    r = scored.agg(F.min("risk_score").alias("a"), F.max("risk_score").alias("b"), F.min("confidence").alias("c"), F.max("confidence").alias("d")).head()
    assert r.a >= 0 and r.b <= 100 and r.c >= 0 and r.d <= 1
    with pytest.raises(ValueError):
        check_caps({"x": 1.0})


def test_nothing_checked_gives_zero(spark):
    df = spark.createDataFrame([(None,)], "signal_a double")
    r = scoring.combine(df, {"a": 0.5}).head()
    assert r.points_a == 0 and r.risk_score == 0


def test_missing_column_skips_a_detector(spark, sf_dir):
    works = detectors.detect(register.features(register.build_works(spark, sf_dir), RiskConfig()), RiskConfig()).drop("sanction_uplift_pct", "signal_cost_deviation")
    report = {r.rule_id: r.status for r in detectors.rule_report(works, RiskConfig()).collect()}
    assert report["COST_002"] == report["COMP_001"] == "not_evaluated" and report["FIN_001"] == "evaluated"
    d = detectors.cost_deviation(RiskConfig())
    assert works.drop("peer_key").select(d.on(works.drop("peer_key")).alias("s")).where("s IS NOT NULL").count() == 0
    assert [r.rule_id for r in RULES][:2] == ["FIN_001", "FIN_002"]


def cosines(texts, blocks):
    """Brute force: cosines of the texts of each block."""
    out = np.full((len(texts), len(texts)), -1.0)
    for b in set(blocks):
        own = [i for i in range(len(texts)) if blocks[i] == b]
        counts = {}
        for i in own:
            c = counts[i] = {}
            for w in texts[i].split():
                for n in (3, 4, 5):
                    for k in range(len(w) + 3 - n):
                        g = f" {w} "[k : k + n]
                        c[g] = c.get(g, 0) + 1
        known = {}
        for c in counts.values():
            for g in c:
                known[g] = known.get(g, 0) + 1
        w = {i: {g: (1 + math.log(n)) * (math.log((1 + len(own)) / (1 + known[g])) + 1) for g, n in c.items()} for i, c in counts.items()}
        for i in own:
            for j in own:
                if i != j:
                    norm = math.sqrt(sum(x * x for x in w[i].values()) * sum(x * x for x in w[j].values()))
                    out[i, j] = round(sum(x * w[j].get(g, 0) for g, x in w[i].items()) / norm, 9) if norm else 0.0
    return out


@pytest.mark.parametrize("tile", [3, 2000])
def test_similarity_equals_brute_force(spark, monkeypatch, tile):
    """Repeated texts, the same words in another order, a lone block, missing texts."""
    monkeypatch.setattr(similarity.partners, "__defaults__", (False, tile))
    rng = np.random.default_rng(4)
    words = ["road", "drain", "school", "borewell", "village", "near", "hall", "solar", "light"]
    texts = [" ".join(rng.choice(words, int(rng.integers(2, 6)))) for _ in range(40)] + ["road near school", "school near road", "road near school", "road near school", "alone here"]
    blocks = [f"D{k % 2}" for k in range(40)] + ["D0"] * 4 + ["D2"]
    rows = [(f"w{k:02}", b, t, False) for k, (b, t) in enumerate(zip(blocks, texts, strict=True))] + [("x1", "D0", None, False), ("x2", None, "road", False), ("x3", "D0", "road lot", True)]
    df = spark.createDataFrame(rows, "work_id string, district string, description_normalised string, description_is_mojibake boolean")
    got = {r.work_id: r for r in similarity.similarity(df).collect()}
    s = cosines(texts, blocks)
    for k in range(len(texts) - 1):
        r, best = got[f"w{k:02}"], s[k].max()
        assert r.similarity_score == pytest.approx(round(best, 3), abs=0.0011)
        assert r.similar_work_id == (f"w{int(s[k].argmax()):02}" if best >= 0.62 else None)
        assert r.signal_similarity == pytest.approx(max(0, (best - 0.62) / 0.38), abs=1e-6)
    assert (got["w44"].similarity_score, got["w44"].signal_similarity) == (None, 0.0) and got["x1"].signal_similarity is None
    assert got["x2"].signal_similarity == 0 and got["x2"].similarity_score is None and got["x3"].signal_similarity is None
    assert similarity.similarity(df, most=10).where("similarity_score IS NOT NULL").count() == 0
    assert similarity.top_pairs(similarity.similarity(df).withColumn("risk_score", F.lit(1.0))).count() > 1


def test_blocks_of_thousands_are_compared(spark):
    """A district of more than 900 works: all of them have a partner."""
    df = spark.range(2500).select(F.col("id").cast("string").alias("work_id"), F.lit("D").alias("district"), F.concat(F.lit("road lot "), (F.col("id") % 1300).cast("string")).alias("description_normalised"))
    out = similarity.similarity(df)
    assert out.where("similarity_score IS NULL").count() == 0 and out.where("similarity_score = 1").count() >= 2400


def test_nearby_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    words = ["road", "drain", "school", "borewell", "village", "near"]
    rows = []
    for k in range(60):
        place = (None, None) if k % 9 == 0 else (20 + float(rng.uniform(0, 0.2)), 75 + float(rng.uniform(0, 0.2)))
        rows.append((f"p{k:02}", f"D{k % 2}", "Road" if k % 3 else "Hall", None if k == 7 else " ".join(rng.choice(words, 4)), *place))
    df = spark.createDataFrame(rows, "project_id string, district string, work_category string, work_description string, latitude double, longitude double")
    s = cosines([r[3] or "" for r in rows], [r[1] for r in rows])
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if s[i, j] > 0:
                h = None
                if a[4] is not None and b[4] is not None:
                    x = math.sin(math.radians(b[4] - a[4]) / 2) ** 2 + math.cos(math.radians(a[4])) * math.cos(math.radians(b[4])) * math.sin(math.radians(b[5] - a[5]) / 2) ** 2
                    h = 2 * 6371 * math.asin(math.sqrt(x))
                if a[2] != b[2] or (h is not None and h > 12):
                    s[i, j] = 0
    for r in similarity.similarity_nearby(df).collect():
        k = int(r.project_id[1:])
        best = max(s[k].max(), 0)
        assert r.similarity_score == pytest.approx(best, abs=1e-8) and r.similar_project_id == (f"p{int(s[k].argmax()):02}" if best >= 0.55 else "")


def test_forest_finds_the_outlier():
    rng = np.random.default_rng(0)
    rows = np.vstack([rng.normal(size=(500, 3)), [[9, 9, 9]]])
    scores = multivariate.IsolationForest(100, 256, 1).fit(rows).scores(rows)
    assert scores.argmax() == 500 and 0 < scores.min() < scores.max() < 1


@pytest.mark.parametrize("sizes", [{}, {"piece": 7, "sample": 40}])
def test_noise_equals_brute_force(spark, sizes):
    rng = np.random.default_rng(1)
    pts = np.vstack([rng.normal(0, 0.3, (40, 3)), rng.normal(5, 2, (20, 3)), [[0, 0, 0]] * 3])
    near = np.linalg.norm(pts[:, None] - pts[None], axis=2) <= 1.2
    dense = near.sum(axis=1) >= 6
    want = {i: not (near[i] & dense).any() for i in range(len(pts))}
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "k long, x double, y double, z double")
    assert {r.k: r.is_noise for r in density.dbscan_noise(df, ["x", "y", "z"], 1.2, 6, **sizes).collect()} == want


def test_noise_in_nine_dimensions_equals_brute_force(spark):
    """Thousands of points, most of them undecided in their own piece."""
    rng = np.random.default_rng(11)
    pts = np.vstack([rng.normal(0, s, (700, 9)) for s in (0.2, 0.4, 0.6, 0.9)] + [np.zeros((5, 9))])
    square = ((pts[:, None, :] - pts[None]) ** 2).sum(axis=2)
    near = square <= 1.44
    dense = near.sum(axis=1) >= 10
    want = ~(near & dense).any(axis=1)
    names = [f"c{k}" for k in range(9)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], ", ".join(["k long", *[f"{c} double" for c in names]]))
    got = {r.k: r.is_noise for r in density.dbscan_noise(df, names, 1.2, 10, piece=150, sample=400).collect()}
    assert 200 < want.sum() < 2600 and [got[i] for i in range(len(pts))] == want.tolist()
    assert density.dbscan_noise(df.limit(0), names, 1.2, 10).count() == 0


def test_too_few_rows_are_not_fitted(spark, sf_dir):
    works = register.build_works(spark, sf_dir).limit(50)
    assert multivariate.multivariate(works, RiskConfig()).where("signal_multivariate IS NOT NULL").count() == 0


def test_explanations(scored):
    for r in scored.limit(200).collect():
        points = [e.points for e in r.explanation]
        assert points == sorted(points, reverse=True) and len(points) <= 3 and all(p >= 2.9 for p in points)
        assert (r.primary_reason == "No material indicator") == (not points)
        assert bool(r.briefing) == (r.risk_band != "Low")


def test_benchmark(spark):
    register_ = datagen.generate(spark, n=600, seed=7).cache()
    out = benchmark.run(register_)
    e = evaluation.evaluate(out, "risk_score", "is_anomaly", "project_id").head()
    base = register_.agg(F.avg(F.col("is_anomaly").cast("int"))).head()[0]
    assert e.roc_auc > 0.75 and e["25_precision"] > base
    assert evaluation.evaluate(out.drop("is_anomaly"), "risk_score", "is_anomaly", "project_id") is None
    with pytest.raises(ValueError, match="expenditure"):
        benchmark.run(register_.drop("expenditure"))
    assert rollups.agencies(out).where("works < 5").count() == 0


def test_allocation_join_is_refused_below_a_fifth(spark, scored):
    none = spark.createDataFrame([("nobody", "nowhere", "c", 1.0)], "mp_name string, state string, constituency string, allocated_amount double")
    rows, joined, rate = rollups.fund_utilisation(scored, none)
    assert not joined and rate == 0 and "allocated" not in rows.columns


def test_reviews(spark, scored):
    rows = [("a", "under_review", 1, 1), ("a", "escalated", 2, 2), ("b", "under_review", 1, 3), ("b", None, 2, 4), ("c", "escalated", 1, 5), ("c", "not_reviewed", 2, 6)]
    log = spark.createDataFrame(rows, "work_id string, status string, at int, seq int")
    state = reviews.latest_reviews(log)
    assert [(r.work_id, r.status) for r in state.collect()] == [("a", "escalated")] and reviews.status_of(state, "c") == "not_reviewed"
    cleared = log.union(spark.createDataFrame([(None, None, 5, 7), ("d", "escalated", 6, 8)], log.schema))
    assert [r.work_id for r in reviews.latest_reviews(cleared).collect()] == ["d"]
    q = rollups.queue(scored, 10)
    assert q.count() == 10 and reviews.page(q, 0, 4).count() == 4
    assert reviews.pairs_with_works(similarity.top_pairs(scored), scored).columns


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = adapter.table(spark, sf_dir, "events")
    events.write.parquet(str(tmp_path / "events"))
    q = alerts.follow(spark, str(tmp_path / "events"), events.schema, "counts")
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("counts")) == key(alerts.windowed_counts(events))
