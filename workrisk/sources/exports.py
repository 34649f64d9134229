"""The five exports as typed tables, with rejects in quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workrisk.config import IngestConfig
from workrisk.functions import text as t
from workrisk.operators import validation as v
from workrisk.operators.build import check_unmultiplied, no_recommendations, recommendations, unify
from workrisk.plans.storage import exists, stored
from workrisk.sources.workbook import PROVENANCE, read_workbook

# Names of files and columns of the exports.
FILES = {
    "sanctioned": "Works_Sanctioned.xlsx",
    "completed": "Works_Completed.xlsx",
    "expenditure": "Expenditure_on_Completed_and_On-going_Works_as_on_Date.xlsx",
    "allocation": "Allocated_Limit_for_Honble_MPs.xlsx",
    "recommended": "Works_Recommended.xlsx",
}
SANCTIONED = ("Sr. No.", "Work", "Work category", "State", "IDA", "Hon'ble Members of Parliament", "Elected/Nominated", "Work description", "Recommended date", "Sanction Date", "Sanction Amount ( ₹ )", "Work Status")
COMPLETED = ("Sr. No.", "Work", "Completion Date", "Amount Disbursed ( ₹ )")
EXPENDITURE = ("Sr. No.", "Work ID", "Work", "Vendor Name", "Expenditure Date", "Payment Status", "Fund Disbursed Amount ( ₹ )")


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _like(df: DataFrame, part: str) -> Column:
    """The first column whose name holds a part."""
    return _c(next(c for c in df.columns if part.lower() in c.lower()))


def sanctioned(raw: DataFrame) -> DataFrame:
    v.require_columns(raw, list(SANCTIONED), "sanctioned works")
    title = t.without_work_id(_c("Work"))
    return raw.select(
        _c("Sr. No.").alias("row_key"), t.work_id(_c("Work")).alias("work_id"), title.alias("work_title"), F.coalesce(F.nullif(t.strip(_c("Work description")), F.lit("")), title).alias("work_description"),
        t.strip(_c("Work category")).alias("work_category"), t.strip(_c("State")).alias("state"), t.district(_c("IDA")).alias("district"), _c("IDA").alias("ida_raw"), t.member_name(_c("Hon'ble Members of Parliament")).alias("mp_name"),
        t.strip(_c("Elected/Nominated")).alias("mp_type"), t.parse_amount(_c("Sanction Amount ( ₹ )")).alias("sanction_amount"), t.parse_date(_c("Recommended date")).alias("recommended_date"),
        t.parse_date(_c("Sanction Date")).alias("sanction_date"), t.strip(_c("Work Status")).alias("work_status"), "source_file", F.col("source_row").cast("int").alias("source_row"),
    )


def completed(raw: DataFrame) -> DataFrame:
    v.require_columns(raw, list(COMPLETED), "completed works")
    return raw.select(_c("Sr. No.").alias("row_key"), t.work_id(_c("Work")).alias("work_id"), t.parse_date(_c("Completion Date")).alias("completion_date"),
                      t.parse_amount(_c("Amount Disbursed ( ₹ )")).alias("amount_disbursed_at_completion"), F.col("source_row").cast("int").alias("completed_source_row"))


def expenditure(raw: DataFrame) -> DataFrame:
    """A missing payee stays missing."""
    v.require_columns(raw, list(EXPENDITURE), "expenditure")
    some = lambda c: F.nullif(t.strip(_c(c)), F.lit(""))
    return raw.select(_c("Sr. No.").alias("row_key"), t.work_id(_c("Work ID")).alias("work_id"), some("Work").alias("work_type"), some("Vendor Name").alias("vendor"), t.parse_date(_c("Expenditure Date")).alias("paid_on"),
                      some("Payment Status").alias("status"), t.parse_amount(_c("Fund Disbursed Amount ( ₹ )")).alias("amount"), "source_row")


def allocation(raw: DataFrame) -> DataFrame:
    v.require_columns(raw, ["Sr. No.", "State"], "allocation")
    seat = t.strip(_c("Constituency")) if "Constituency" in raw.columns else F.lit(None).cast("string")
    return raw.select(_c("Sr. No.").alias("row_key"), t.strip(_c("State")).alias("state"), seat.alias("constituency"), t.member_name(_like(raw, "Members of Parliament")).alias("mp_name"), t.parse_amount(_like(raw, "AMOUNT")).alias("allocated_amount"))


def recommended(raw: DataFrame) -> DataFrame:
    v.require_columns(raw, ["Sr. No.", "WORK", "State"], "recommended works")
    return raw.select(_c("Sr. No.").alias("row_key"), t.work_id(_c("WORK")).alias("work_id"), t.strip(_c("State")).alias("state"), t.district(_c("IDA")).alias("district"), _c("Work description").alias("work_description"),
                      t.strip(_c("Work category")).alias("work_category"), t.member_name(_like(raw, "Members of Parliament")).alias("mp_name"), t.parse_amount(_like(raw, "AMOUNT")).alias("recommended_amount"),
                      t.parse_date(_c("Recommended date")).alias("recommended_on"), t.parse_date(_c("Sanction Date")).alias("sanction_date"), F.col("source_row").cast("int").alias("source_row"))


def ingest(spark: SparkSession, folder: str, config: IngestConfig = IngestConfig()) -> dict[str, DataFrame | v.Quarantine | None]:
    """works, payments, allocation, pipeline (open recommendations) and the
    quarantine, from a folder of exports; the last export may be missing."""
    # each workbook is parsed once, whatever reads it later
    raw = {k: stored(read_workbook(spark, f"{folder}/{f}")) for k, f in FILES.items() if exists(spark, f"{folder}/{f}")}
    if missing := [FILES[k] for k in list(FILES)[:3] if k not in raw]:
        raise v.IngestError(f"no workbook at {folder}: {', '.join(missing)}")
    rejected = v.Quarantine()

    def clean(df: DataFrame, checks, source: str) -> DataFrame:
        good, bad = v.split(v.tag(df, checks))
        rejected.add(bad, source)
        return good.drop("row_key")

    spine = sanctioned(raw["sanctioned"])
    spine = clean(spine, v.spine_checks(spine), "sanctioned")
    done = completed(raw["completed"])
    done = clean(done, v.completion_checks(done), "completed")
    paid = expenditure(raw["expenditure"])
    paid = clean(paid, v.payment_checks(paid, config.implausible_payment, config.quarantine_implausible), "expenditure")
    limits = allocation(raw["allocation"]) if "allocation" in raw else None
    if limits is not None:
        limits = clean(limits, v.allocation_checks(limits), "allocation")
    matched, open_ = no_recommendations(spark), None
    if "recommended" in raw:
        rows = recommended(raw["recommended"])
        rows = rows.where(~v.is_summary(F.col("row_key"))).drop("row_key")
        matched, open_ = recommendations(rows)
    works = check_unmultiplied(unify(spine, done, paid, matched, str(config.as_of)))
    return {"works": works, "payments": paid, "allocation": limits, "pipeline": open_, "matched": matched, "quarantine": rejected, "spine": spine, "completed": done}


def reports(found: dict, works: DataFrame, config: IngestConfig = IngestConfig()) -> dict:
    """What is known of an ingest, a few values each: how the sources match, what
    was rejected, dates, amounts, columns, recommendations and coverage."""
    one = lambda df: df.head().asDict()
    rows = lambda df: [r.asDict() for r in df.collect()] if df is not None else []
    rejected = rows(found["quarantine"].summary())
    sources = (("sanctioned", found["spine"]), ("completed", found["completed"]), ("expenditure", found["payments"]), ("allocation", found["allocation"]))
    out = {
        "config": {"as_of_date": str(config.as_of), "data_mode": config.data_mode, "source_label": config.source_label, "files": FILES},
        "matching": one(v.matching_report(found["spine"], found["completed"], found["payments"])), "quarantine": rejected, "quarantined_rows": sum(r["rows"] for r in rejected),
        "dates": one(v.date_consistency(works, str(config.as_of))), "amounts": one(v.amount_consistency(works)), "columns": [r for name, df in sources if df is not None for r in rows(v.column_profile(df, name))],
        "coverage": one(v.coverage(works)),
    }
    if found["pipeline"] is not None:
        out["recommendation_pipeline"] = one(v.recommendation_report(works, found["matched"], found["pipeline"]))
    return out


__all__ = ["PROVENANCE", "ingest", "reports"]
