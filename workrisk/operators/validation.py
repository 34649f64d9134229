"""Validation with quarantine: a row that breaks a rule is kept aside with its
reason, never dropped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workrisk.functions.numeric import is_true, money_sum
from workrisk.functions.text import strip
from workrisk.operators.ranks import quantiles

# Fixed values of the exports, and the reasons of rejects.
SUMMARY_WORDS = ("grand total", "total", "subtotal", "summary", "overall total")
STATUSES = ("Physical Inspection", "Sanction", "Vendor Identification", "Work partially Completed", "Work Completed", "Time Estimation")
DONE = "Work Completed"
SUMMARY = "Summary or total row"
NO_STATUS = "Work Status holds a value that is not a status"
NO_ID = "No work ID could be extracted"
NO_PAID_ID = "No work ID present"
NOT_POSITIVE = "Payment amount is zero or negative"
#: Columns that say where a row came from; profiles leave them out.
ORIGIN = ("source_row", "source_file", "source_sheet", "ingested_at")


class IngestError(ValueError):
    """The input lacks what the engine needs."""


def require_columns(df: DataFrame, columns: list[str], label: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise IngestError(f"{label}: missing {', '.join(missing)}; found {', '.join(df.columns[:15])}")


def is_summary(key: Column) -> Column:
    """A total line, told by the key column alone."""
    text = F.lower(strip(key))
    return is_true(text.isin(*SUMMARY_WORDS) | text.startswith("grand total"))


def tag(df: DataFrame, checks: list[tuple[str, Column]], name: str = "reject_reason") -> DataFrame:
    """The first check that holds, as a reason; a check that is null doesn't."""
    reason = F.lit(None).cast("string")
    for text, condition in reversed(checks):
        reason = F.when(is_true(condition), F.lit(text)).otherwise(reason)
    return df.withColumn(name, reason)


def spine_checks(df: DataFrame) -> list[tuple[str, Column]]:
    odd = F.col("work_status").isNotNull() & ~F.col("work_status").isin(*STATUSES)
    return [(SUMMARY, is_summary(F.col("row_key"))), (NO_STATUS, odd), (NO_ID, F.col("work_id").isNull())]


def completion_checks(df: DataFrame) -> list[tuple[str, Column]]:
    return [(SUMMARY, is_summary(F.col("row_key"))), (NO_ID, F.col("work_id").isNull())]


def implausible_reason(ceiling: float) -> str:
    return f"Payment exceeds the plausibility ceiling of Rs {ceiling:,.0f}"


def payment_checks(df: DataFrame, ceiling: float = 500_000_000.0, implausible: bool = True) -> list[tuple[str, Column]]:
    """A missing amount survives: it is missing, not wrong."""
    out = [(SUMMARY, is_summary(F.col("row_key"))), (NO_PAID_ID, F.col("work_id").isNull())]
    if implausible:
        out.append((implausible_reason(ceiling), F.col("amount") > ceiling))
    return [*out, (NOT_POSITIVE, F.col("amount") <= 0)]


def allocation_checks(df: DataFrame) -> list[tuple[str, Column]]:
    return [(SUMMARY, is_summary(F.col("row_key")) | F.col("state").isNull())]


def split(tagged: DataFrame, name: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """Clean rows, and rejected ones with their reason."""
    return tagged.where(F.col(name).isNull()).drop(name), tagged.where(F.col(name).isNotNull())


class Quarantine:
    """Rejects of all sources under one schema."""

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def add(self, rejected: DataFrame, source: str) -> None:
        self.frames.append(rejected.withColumn("source", F.lit(source)))

    def rows(self) -> DataFrame | None:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self.frames) if self.frames else None

    def summary(self) -> DataFrame | None:
        rows = self.rows()
        return None if rows is None else rows.groupBy("source", F.col("reject_reason").alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def column_profile(df: DataFrame, dataset: str) -> DataFrame:
    """Per column: values, nulls, completeness and distinct values; columns of origin
    are left out. Values are counted in long form, (column, value) first, so a row
    becomes a narrow row a column, not a whole one, and a frequent value is added up
    before it is sent."""
    columns = [c for c in df.columns if c not in ORIGIN]
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for k, c in enumerate(columns)])
    values = df.select(F.explode(each).alias("p")).groupBy("p.k", "p.v").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("v").isNotNull()
    found = values.groupBy("k").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("non_null"), F.count_if(known).alias("distinct_values"))
    # an empty table has its columns, too
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "k int, column string")
    whole = names.join(found, "k", "left").fillna(0, ["rows", "non_null", "distinct_values"])
    return whole.select(
        F.lit(dataset).alias("dataset"), "column", "non_null", (F.col("rows") - F.col("non_null")).alias("missing"),
        F.round(F.col("non_null") * 100.0 / F.greatest("rows", F.lit(1)), 1).alias("completeness_pct"), "distinct_values",
    )


def matching_report(spine: DataFrame, completed: DataFrame, payments: DataFrame) -> DataFrame:
    """How the sources' records and ids fit together, one row of fifteen values."""
    records = [df.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.countDistinct("work_id") - F.max(F.col("work_id").isNull().cast("int"))).alias("again")) for df in (spine, completed, payments)]
    ids = lambda df: df.where("work_id IS NOT NULL").select("work_id")
    sets = [ids(df).distinct().withColumn(f"in_{n}", F.lit(1)) for n, df in (("s", spine), ("c", completed), ("p", payments))]
    joined = sets[0].join(sets[1], "work_id", "full").join(sets[2], "work_id", "full")
    has = lambda *names: reduce(lambda a, b: a & b, [F.col(f"in_{n}").isNotNull() for n in names])
    count = lambda c: F.count_if(c)
    one = joined.agg(
        count(has("s")).alias("sanctioned_distinct_ids"), count(has("c")).alias("completed_distinct_ids"), count(has("p")).alias("expenditure_distinct_works"),
        count(has("c", "s")).alias("completed_matched_to_sanctioned"), count(has("c") & ~has("s")).alias("completed_unmatched"),
        count(has("p", "s")).alias("expenditure_matched_to_sanctioned"), count(has("p") & ~has("s")).alias("expenditure_unmatched"),
        count(has("p", "c")).alias("works_with_both_completion_and_payments"),
    )
    names = (("sanctioned_records", "duplicate_ids_in_sanctioned"), ("completed_records", "duplicate_ids_in_completed"), ("expenditure_payment_records", None))
    for r, (n, again) in zip(records, names, strict=True):
        own = [F.col("n").alias(n)] + ([F.coalesce("again", F.lit(0)).cast("long").alias(again)] if again else [])
        one = one.crossJoin(F.broadcast(r.select(*own)))
    share = lambda a, b: F.round(F.col(a) * 100.0 / F.greatest(F.col(b), F.lit(1)), 2)
    one = one.withColumn("match_rate_completed_pct", share("completed_matched_to_sanctioned", "completed_distinct_ids"))
    return one.withColumn("match_rate_expenditure_pct", share("expenditure_matched_to_sanctioned", "expenditure_distinct_works"))


def date_consistency(works: DataFrame, as_of: str) -> DataFrame:
    """Counts of works whose dates, or whose status and date, don't fit."""
    c, today = F.col, F.lit(as_of).cast("date")
    done = c("work_status").eqNullSafe(DONE)
    return works.agg(
        F.count_if(c("sanction_date") < c("recommended_date")).alias("sanction_before_recommendation"),
        F.count_if(c("completion_date") < c("sanction_date")).alias("completion_before_sanction"),
        F.count_if(c("first_payment_date") < c("sanction_date")).alias("first_payment_before_sanction"),
        F.count_if(c("sanction_date") > today).alias("sanction_date_in_future"),
        F.count_if(c("completion_date") > today).alias("completion_date_in_future"),
        F.count_if(c("sanction_date").isNull()).alias("missing_sanction_date"),
        F.count_if(done & c("completion_date").isNull()).alias("completed_status_without_completion_date"),
        F.count_if(c("completion_date").isNotNull() & ~done).alias("completion_date_without_completed_status"),
    )


def amount_consistency(works: DataFrame) -> DataFrame:
    """Counts of works whose amounts don't fit, and the median share spent."""
    spent, amount = F.col("total_expenditure"), F.col("sanction_amount")
    middle = quantiles(works, None, {"m": (F.col("expenditure_ratio"), 0.5)}).select(F.round("m", 3).alias("median_expenditure_ratio"))
    return works.agg(
        F.count_if(amount.isNull()).alias("missing_sanction_amount"), F.count_if(amount <= 0).alias("zero_or_negative_sanction"), F.count(spent).alias("works_with_expenditure"),
        F.count_if(spent > amount).alias("expenditure_exceeds_sanction"), F.count_if(F.col("completion_date").isNotNull() & spent.isNull()).alias("completed_without_any_payment"),
        F.count_if(F.col("max_single_payment") > amount).alias("single_payment_exceeds_sanction"),
    ).crossJoin(F.broadcast(middle))


def coverage(works: DataFrame) -> DataFrame:
    """What the register covers, one row of eight counts."""
    return works.agg(
        F.count(F.lit(1)).alias("works_total"), F.count_if("is_completed").alias("works_completed"), F.count_if("has_expenditure").alias("works_with_expenditure"), F.count_if("has_work_type").alias("works_with_work_type"),
        F.countDistinct("state").alias("states"), F.countDistinct("district").alias("districts"), F.countDistinct("mp_name").alias("mps"), F.count_if("description_is_mojibake").alias("mojibake_descriptions"),
    )


def recommendation_report(works: DataFrame, matched: DataFrame, open_: DataFrame) -> DataFrame:
    """How many recommendations there are, were sanctioned, or wait, and their value."""
    one = works.agg(F.count_if("has_recommendation").alias("matched_to_sanctioned")).crossJoin(F.broadcast(matched.agg(F.count(F.lit(1)).alias("_matched"))))
    waiting = open_.agg(F.count(F.lit(1)).alias("recommended_not_sanctioned"), money_sum(F.col("recommended_amount")).alias("pipeline_value"))
    both = one.crossJoin(F.broadcast(waiting))
    return both.select((F.col("_matched") + F.col("recommended_not_sanctioned")).alias("recommended_records"), "matched_to_sanctioned", "recommended_not_sanctioned", "pipeline_value")
