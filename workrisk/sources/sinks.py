"""Outputs: tables, sparse JSON records, CSV files and the console's report."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workrisk.config import BENCHMARK_CAPS, BENCHMARK_CONFIG_VERSION, BENCHMARK_VERSION, CONFIG_VERSION, ENGINE_VERSION, INDICATORS, BenchmarkConfig, RiskConfig
from workrisk.functions.text import shortened
from workrisk.operators import rollups as r
from workrisk.plans.storage import read_text, write_text

# The fields of the index, of a full record, and of the queue.
INDEX = ("work_id", "work_description", "state", "district", "work_category", "work_type", "sanction_amount", "work_status", "risk_score", "risk_band", "confidence", "confidence_band", "primary_reason")
RECORD = (
    "work_id", "work_description", "work_category", "work_type", "state", "district", "ida_raw", "mp_name", "sanction_amount", "recommended_date", "sanction_date", "completion_date", "work_status",
    "is_completed", "total_expenditure", "expenditure_ratio", "payment_count", "max_single_payment", "distinct_vendors", "primary_vendor", "first_payment_date", "last_payment_date", "peer_key",
    "peer_level", "peer_size", "peer_median_cost", "peer_cost_percentile", "cost_robust_z", "days_recommendation_to_sanction", "days_sanction_to_reference", "peer_median_duration", "age_basis",
    "similar_work_id", "similarity_score", "rule_reasons", "identical_description_count", "vendor_district_share", "data_completeness", "detectors_evaluated", "peer_strength", "confidence_reason",
    "risk_score", "risk_band", "confidence", "confidence_band", "primary_reason", "assessment", "briefing", "source_file", "source_row", *(f"points_{n}" for n in INDICATORS),
)
QUEUE = ("work_id", "work_description", "state", "district", "work_category", "sanction_amount", "work_status", "risk_score", "risk_band", "confidence", "confidence_band", "primary_reason")


def cleaned(df: DataFrame) -> DataFrame:
    """Doubles rounded to four places, non-finite ones null, dates as text."""
    out = {}
    for c, kind in df.dtypes:
        if kind in ("double", "float"):
            out[c] = F.when(F.abs(F.col(c)) < float("inf"), F.round(F.col(c).cast("double"), 4))
        elif kind == "date" or kind.startswith("timestamp"):
            out[c] = F.date_format(c, "yyyy-MM-dd")
        elif kind == "string":
            out[c] = F.nullif(F.col(c), F.lit(""))
    return df.withColumns(out)


def records(df: DataFrame, key: str = "work_id") -> DataFrame:
    """(key, record): one JSON text a row, without missing or empty fields."""
    return cleaned(df).select(F.col(key), F.to_json(F.struct(*df.columns)).alias("record"))


def index(scored: DataFrame) -> DataFrame:
    """The short form of every work, descriptions cut at 90 letters."""
    return scored.select(*[c for c in INDEX if c in scored.columns]).withColumn("work_description", shortened(F.col("work_description")))


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted, CRLF, with a header."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\n").csv(path)


def export_csv(spark: SparkSession, rows: list[dict], columns: list[str], folder: str, stem: str) -> str:
    """A small file for a spreadsheet: UTF-8 with a mark, CRLF, a stamped name."""
    quote = lambda v: '"' + str(v).replace('"', '""') + '"' if v is not None and any(c in str(v) for c in '",\r\n') else "" if v is None else str(v)
    path = f"{folder}/{stem}-{datetime.now(timezone.utc):%Y%m%d}.csv"
    write_text(spark, path, "\ufeff" + "\r\n".join([",".join(map(quote, columns)), *(",".join(quote(x.get(c)) for c in columns) for x in rows)]) + "\r\n")
    return path


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    write_text(spark, path, json.dumps(report, indent=2, default=str, ensure_ascii=False))


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def read_table(spark: SparkSession, path: str, optional: bool = False) -> DataFrame | None:
    """A Parquet table, or None where an optional one is missing."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if optional and "PATH_NOT_FOUND" in str(e):
            return None
        raise


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...], types: dict[str, str]) -> DataFrame:
    """A table with a header: the named columns (others are left out) as strings, or
    as their type says. One pass; nothing is inferred."""
    names = spark.read.option("header", True).csv(path).columns  # reads the first line
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"Register is missing required columns: {', '.join(missing)}")
    raw = spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in names)).csv(path)
    return raw.select(*[F.expr(f"try_cast(`{c}` AS {types.get(c, 'string')})").alias(c) for c in names if c in columns or c in types or c == "anomaly_type"])


# What a pair says of its first work.
PAIR = ("state", "district", "work_category", "sanction_amount", "work_description")
#: Rows of a payload's lists.
PAIRS, DISTRICTS, VENDORS, WARNINGS = 200, 400, 300, 300
# What a payload says about itself.
LIMITATIONS = (
    "The risk indicator is an analytical screening score, not a probability of fraud and not a legal finding.",
    "No fraud labels exist for this data, so precision and recall cannot be measured on it.",
    "Rule thresholds are administrative or analytical choices, not verified guideline rules.",
    "Similar descriptions indicate potential duplication requiring verification, not confirmed duplicate works.",
    "District is inferred from the IDA text and its meaning requires confirmation.",
)


def _list(df: DataFrame) -> list[dict]:
    return [json.loads(r) for r in cleaned(df).toJSON().collect()]


def payload(scored: DataFrame, report: dict, config: RiskConfig = RiskConfig(), top: int = 100, scope: str = "all", allocation: DataFrame | None = None, open_: DataFrame | None = None) -> dict:
    """Every block of a viewer's payload but the works themselves: each is a few
    rows, one row a state, member or month, or cut to its own length."""
    from workrisk.operators import detectors, similarity

    as_of = report["config"]["as_of_date"]
    one = lambda df: _list(df)[0]
    rows, joined, rate = r.fund_utilisation(scored, allocation)
    levels = {"state": ["state"], "district": ["state", "district"], "mp": ["mp_name", "state"]}
    rolled = {name: r.rollup(scored, keys) for name, keys in levels.items()}
    rolled["district"] = r.capped(rolled["district"], "district")
    rolled["vendor"] = r.capped(r.rollup(scored.where("primary_vendor IS NOT NULL"), ["primary_vendor", "district"], 5), "vendor")
    waiting = {"available": False, "works": 0, "value": 0.0, "by_state": [], "oldest": []}
    if open_ is not None:
        columns = ["work_description", "work_category", "state", "district", "mp_name", "recommended_amount", "recommended_on"]
        oldest = r.oldest_recommendations(open_, ["source_row"]).select(*[c for c in columns if c in open_.columns])
        waiting = one(r.pipeline_totals(open_, scored)) | {"by_state": _list(r.pipeline_by_state(open_)), "oldest": _list(oldest)}
    flagged = scored.where("risk_band <> 'Low'")
    paired = similarity.top_pairs(scored, PAIRS, PAIR)
    counts = r.allocation_counts(rows if not joined else r.member_utilisation(scored), allocation) if allocation is not None else ()
    return {
        "meta": {"generated_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "data_mode": report["config"]["data_mode"], "data_source": report["config"]["source_label"], "as_of_date": as_of, "engine_version": ENGINE_VERSION, "config_version": CONFIG_VERSION,
                 "source_files": list(report["config"]["files"].values()), "limitations": list(LIMITATIONS)},
        "dashboard": one(r.dashboard(scored)) | {"risk_distribution": _list(r.band_summary(scored)), "flag_reasons": _list(r.reason_counts(scored).orderBy(F.desc("works"), "primary_reason")),
                                                 "caps": config.caps, "bands": {"high": config.band_high, "medium": config.band_medium}},
        "detectors": detectors.detector_details(scored, INDICATORS), "rules": detectors.rule_details(scored, config), "data_quality": report,
        "priority_queue": _list(r.queue(scored, top).select(*[c for c in QUEUE if c in scored.columns])),
        "similar_pairs": _list(paired.select("pair_key", "work_id", "similar_work_id", "similarity_score", *[c for c in PAIR if c in paired.columns])), "national": one(r.national(scored)), "rollups": {name: _list(df) for name, df in rolled.items()},
        "trends": {"monthly": _list(r.monthly(scored)), "risk_by_month": _list(r.risk_by_month(scored).orderBy("month"))},
        "fund_utilisation": {"rows": _list(rows), "allocation_joined": joined, "match_rate_pct": rate, "note": r.utilisation_note(joined, rate, allocation is not None, *counts)},
        "early_warning": _list(r.early_warning(scored, as_of, WARNINGS)), "recommendation_pipeline": waiting, "detail_scope": scope,
        "detail_available_for": (scored if scope == "all" else flagged).count(),
    }


def export_register(scored: DataFrame, folder: str, report: dict, scope: str = "all", top: int = 100, config: RiskConfig = RiskConfig(), allocation: DataFrame | None = None, open_: DataFrame | None = None) -> None:
    """All outputs of a scored register under a folder: the payload's blocks as one
    JSON text a block, the index and the queue as JSON and CSV, the whole register
    as Parquet and CSV, and full records of all or of the flagged works, sorted by
    work so that one is found without reading the others."""
    spark = scored.sparkSession
    record = [c for c in RECORD if c in scored.columns]
    write_parquet(scored, f"{folder}/works")
    scored = spark.read.parquet(f"{folder}/works")
    blocks = payload(scored, report, config, top, scope, allocation, open_)
    texts = spark.createDataFrame([(name, json.dumps(block, default=str)) for name, block in blocks.items()], "block string, content string")
    texts.coalesce(1).write.mode("overwrite").json(f"{folder}/payload")
    records(index(scored)).write.mode("overwrite").json(f"{folder}/index")
    write_csv(cleaned(scored.select(*record)), f"{folder}/scored")
    write_csv(cleaned(r.queue(scored, top).select(*[c for c in QUEUE if c in scored.columns])), f"{folder}/priority_queue")
    chosen = scored if scope == "all" else scored.where("risk_band <> 'Low'")
    chosen.select(*record, "explanation").repartitionByRange("work_id").sortWithinPartitions("work_id").write.mode("overwrite").parquet(f"{folder}/details")


# The fields of a project's record.
PROJECT = (
    "project_id", "state", "district", "block", "latitude", "longitude", "constituency", "sector", "work_category", "work_description", "implementing_agency", "sanction_date", "expected_completion_date",
    "actual_completion_date", "sanctioned_cost", "revised_cost", "effective_cost", "expenditure", "physical_progress_pct", "status", "peer_median_cost", "peer_cost_percentile", "peer_size", "cost_robust_z",
    "overrun_days", "expected_duration_days", "expenditure_ratio_pct", "progress_gap_pct", "cost_escalation_pct", "duplicate_match_id", "compliance_reasons", "agency_work_share", "isolation_forest_score", "dbscan_is_noise", "risk_score", "risk_band",
    "confidence", "primary_reason", "review_status", "assessment", *(f"points_{n}" for n in BENCHMARK_CAPS),
)


def export_benchmark(scored: DataFrame, folder: str, measures: dict, config: BenchmarkConfig = BenchmarkConfig(), top: int = 50) -> None:
    """The benchmark's payload: its blocks as one JSON text each, and projects,
    queue and agencies as tables."""
    from workrisk.operators import benchmark

    queue, agencies = benchmark.queue(scored, top), r.agencies(scored)
    blocks = {
        "meta": {"data_mode": "synthetic_benchmark", "data_source": "A generated register with planted irregularities, not real data", "as_of_date": "n/a", "engine_version": BENCHMARK_VERSION, "config_version": BENCHMARK_CONFIG_VERSION,
                 "source_files": ["workrisk/operators/datagen.py"], "limitations": ["Every record here is generated. No work, agency or amount describes anything real.", "Precision and recall on it describe the detectors, not how they do on real data."]},
        "generated_by": "workrisk (labelled benchmark)", "disclaimer": "A risk score points to unusual patterns for people to review. It does not establish irregularity or fraud.",
        "dashboard": _list(benchmark.dashboard(scored))[0] | {"risk_distribution": _list(benchmark.band_summary(scored)), "flag_reasons": _list(benchmark.reason_summary(scored)),
                                                              "weights": config.caps, "bands": {"high": config.band_high, "medium": config.band_medium}},
        "priority_queue": _list(queue), "agencies": _list(agencies), "benchmark": measures,
    }
    texts = scored.sparkSession.createDataFrame([(name, json.dumps(block, default=str)) for name, block in blocks.items()], "block string, content string")
    texts.coalesce(1).write.mode("overwrite").json(f"{folder}/payload")
    records(scored.select(*[c for c in PROJECT if c in scored.columns], F.to_json("explanation").alias("explanation")), "project_id").write.mode("overwrite").json(f"{folder}/projects")
    write_csv(cleaned(scored.select(*[c for c in PROJECT if c in scored.columns])), f"{folder}/scored")
    write_csv(cleaned(queue), f"{folder}/priority_queue")
    write_csv(cleaned(agencies), f"{folder}/agencies")


def read_payload(spark: SparkSession, folder: str) -> tuple[dict, DataFrame]:
    """The payload's blocks, and the index as a table. Fails without works."""
    blocks = {row.block: json.loads(row.content) for row in spark.read.schema("block string, content string").json(f"{folder}/payload").collect()}
    texts = spark.read.schema("work_id string, record string").json(f"{folder}/index")
    fields = ", ".join(f"{c} {'double' if c in ('sanction_amount', 'risk_score', 'confidence') else 'string'}" for c in INDEX)
    works = texts.select(F.from_json("record", fields).alias("w")).select("w.*")
    if works.isEmpty():
        raise ValueError(f"{folder} holds no works")
    return blocks, works


def work_detail(spark: SparkSession, folder: str, work_id: str):
    """The full record of one work, or None; only row groups that may hold it are read."""
    return spark.read.parquet(f"{folder}/details").where(F.col("work_id") == work_id).head()


def listed(title: str, values: dict) -> str:
    return "\n".join([f"{title}:", *(f"  {k}: {v}" for k, v in values.items())])


def console_report(scored: DataFrame) -> str:
    """Counts by band and peer level, the five riskiest works, and the check that
    points add up."""
    from workrisk.operators.scoring import decomposition_gaps

    lines = []
    for c in ("risk_band", "confidence_band", "peer_level"):
        lines += [f"{c}:"] + [f"  {x[c]}: {x['count']}" for x in scored.groupBy(c).count().orderBy(F.desc("count")).collect()]
    lines += ["risk_score:"] + [f"  {x.summary}: {float(x.risk_score):.2f}" for x in scored.select("risk_score").summary().collect()]
    lines += ["riskiest:"] + [f"  {x.work_id} {x.risk_score}" for x in r.queue(scored, 5).select("work_id", "risk_score").collect()]
    return "\n".join([*lines, f"works whose points don't add up: {decomposition_gaps(scored).count()}"])
