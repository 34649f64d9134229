"""One row a work from sanctions, completions, payments and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from workrisk.functions.numeric import money_sum, ratio
from workrisk.functions.text import is_mojibake, normalise
from workrisk.plans.storage import FEW_PARTS, stored_in_parts

SUCCESS = "Payment Success"
COMPLETENESS = (
    "sanction_amount", "sanction_date", "recommended_date", "work_description", "state", "district", "work_status", "total_expenditure",
)


def payment_rollup(payments: DataFrame) -> DataFrame:
    """One row a work, before anything is joined, so no work is multiplied. The
    modes take the smallest value on ties; a payment whose status is missing was
    not successful. A work has few payments, so they travel once as they are: the
    states of modes by work and vendor are longer and would travel twice. Vendors are
    a set, not a distinct count, for which all other aggregates would run four times."""
    return payments.where("work_id IS NOT NULL").repartition("work_id").groupBy("work_id").agg(
        F.sum(F.col("amount").cast("decimal(20,2)")).cast("double").alias("total_expenditure"),
        F.count(F.lit(1)).alias("payment_count"),
        F.max("amount").alias("max_single_payment"),
        F.min("paid_on").alias("first_payment_date"),
        F.max("paid_on").alias("last_payment_date"),
        F.size(F.collect_set("vendor")).cast("long").alias("distinct_vendors"),
        F.mode("work_type", True).alias("work_type"),
        F.mode("vendor", True).alias("primary_vendor"),
        F.count_if(~F.col("status").eqNullSafe(SUCCESS)).alias("payments_not_successful"),
    )


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row")


def recommendations(recommended: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those of sanctioned works (first of each id), and the open ones that have
    neither an id nor a sanction date."""
    matched = keep_first(recommended.where("work_id IS NOT NULL"), ["work_id"], ["source_row"])
    return matched.select("work_id", "recommended_amount", "recommended_on"), recommended.where("work_id IS NULL AND sanction_date IS NULL")


def no_recommendations(spark) -> DataFrame:
    """Stands in for an export that wasn't supplied."""
    return spark.createDataFrame([], "work_id string, recommended_amount double, recommended_on date")


def check_unmultiplied(works: DataFrame) -> DataFrame:
    """Fails, naming an id, where a join multiplied a work."""
    again = works.groupBy("work_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
    if again:
        raise AssertionError(f"a join multiplied works: {', '.join(str(r.work_id) for r in again)}")
    return works


def unify(spine: DataFrame, completed: DataFrame, payments: DataFrame, recommended: DataFrame, as_of: str) -> DataFrame:
    """Left joins of sources with one row a work, and the derived columns; stored. What
    is paid is stored first, and all in parts, so that only the shuffle files of a part
    lie on the disks at a time."""
    paid = stored_in_parts("work_id", lambda some: payment_rollup(some(payments)), parts=FEW_PARTS)
    joined = lambda some: some(spine).join(some(completed), "work_id", "left").join(some(paid), "work_id", "left").join(some(recommended), "work_id", "left")
    return stored_in_parts("work_id", lambda some: _derived(joined(some), as_of), (paid,), FEW_PARTS)


def _derived(works: DataFrame, as_of: str) -> DataFrame:
    today, amount = F.lit(as_of).cast("date"), F.col("sanction_amount")
    works = works.withColumns({
        "sanction_uplift_pct": ratio(amount - F.col("recommended_amount"), F.col("recommended_amount")) * 100,
        "has_recommendation": F.col("recommended_amount").isNotNull(),
        "expenditure_ratio": ratio(F.col("total_expenditure"), amount),
        "has_expenditure": F.col("total_expenditure").isNotNull(),
        "is_completed": F.col("completion_date").isNotNull(),
        "days_recommendation_to_sanction": F.date_diff("sanction_date", "recommended_date"),
        "days_sanction_to_reference": F.date_diff(F.coalesce(F.col("completion_date"), today), F.col("sanction_date")),
        "age_basis": F.when(F.col("completion_date").isNotNull(), "completion_date").otherwise("as_of_date"),
        "description_normalised": normalise(F.col("work_description")),
        "description_is_mojibake": is_mojibake(F.col("work_description")),
        "has_work_type": F.col("work_type").isNotNull(),
    })
    present = sum((F.col(c).isNotNull().cast("int") for c in COMPLETENESS[1:]), F.col(COMPLETENESS[0]).isNotNull().cast("int"))
    return works.withColumn("data_completeness", F.round(present / len(COMPLETENESS), 3))
