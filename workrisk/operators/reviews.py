"""What a reader of the register does: filter, search, page, and record reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The states of a review; the first stands for none.
STATUSES = ("not_reviewed", "under_review", "needs_information", "no_issue_identified", "escalated")
REVIEW_LABELS = {
    "not_reviewed": "Not reviewed",
    "under_review": "Under review",
    "needs_information": "Needs more information",
    "no_issue_identified": "Reviewed — no issue identified",
    "escalated": "Escalated for further examination",
}
SEARCHED = ("work_id", "work_description", "state", "district", "mp_name", "primary_vendor", "work_category", "work_type")


def filter_queue(queue: DataFrame, bands: list[str] | None = None, state: str | None = None, reviewed: DataFrame | None = None) -> DataFrame:
    """By bands and state, and without works that have a review."""
    out = queue.where(F.col("risk_band").isin(*bands)) if bands else queue
    out = out.where(F.col("state") == state) if state else out
    return out.join(reviewed.select("work_id").distinct(), "work_id", "left_anti") if reviewed is not None else out


def states(works: DataFrame) -> DataFrame:
    return works.where("state IS NOT NULL").select("state").distinct()


def search(works: DataFrame, text: str) -> DataFrame:
    """Works with the text in any searched field, riskiest first."""
    all_fields = F.lower(F.concat_ws(" ", *[c for c in SEARCHED if c in works.columns]))
    return works.where(all_fields.contains(text.lower().strip())).orderBy(F.desc("risk_score"), "work_id")


def page(ordered: DataFrame, number: int, size: int = 100) -> DataFrame:
    return ordered.offset(number * size).limit(size)


def latest_reviews(log: DataFrame) -> DataFrame:
    """The state after a log of (work_id, status, at, seq): the last entry of each
    work. not_reviewed (or null) deletes a review; an entry without a work clears
    all before it."""
    cleared = log.where("work_id IS NULL").agg(F.max(F.struct("at", "seq")).alias("_cleared"))
    after = log.where("work_id IS NOT NULL").crossJoin(F.broadcast(cleared)).where(F.col("_cleared").isNull() | (F.struct("at", "seq") > F.col("_cleared"))).drop("_cleared")
    w = Window.partitionBy("work_id").orderBy(F.desc("at"), F.desc("seq"))
    last = after.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return last.where(F.col("status").isNotNull() & (F.col("status") != STATUSES[0]))


def status_of(reviews: DataFrame, work_id: str) -> str:
    found = reviews.where(F.col("work_id") == work_id).select("status").head()
    return found.status if found else STATUSES[0]


def with_reviews(queue: DataFrame, reviews: DataFrame) -> DataFrame:
    own = reviews.select("work_id", F.col("status").alias("review_status"))
    return queue.join(own, "work_id", "left").withColumn("review_status", F.coalesce("review_status", F.lit(STATUSES[0])))


def pairs_with_works(pairs: DataFrame, works: DataFrame) -> DataFrame:
    """Each pair with the partner's own fields."""
    partner = works.select(F.col("work_id").alias("similar_work_id"), F.col("work_description").alias("similar_description"), F.col("sanction_amount").alias("similar_amount"))
    return pairs.join(partner, "similar_work_id", "left")


def material_points(scored: DataFrame, names: tuple[str, ...], least: float = 3.0) -> DataFrame:
    """Per work: its material points by indicator, and the sum of all others."""
    parts = F.array(*[F.struct(F.lit(n).alias("indicator"), F.col(f"points_{n}").alias("points")) for n in names])
    big = F.filter(parts, lambda p: p["points"] >= least)
    rest = F.aggregate(F.filter(parts, lambda p: p["points"] < least), F.lit(0.0), lambda s, p: s + p["points"])
    return scored.select("work_id", "risk_score", big.alias("material"), F.round(rest, 2).alias("other_points"))


def trend(monthly: DataFrame, series: str) -> DataFrame:
    """One series in order of months, with its peak and total."""
    whole = Window.partitionBy("series")
    own = monthly.where(F.col("series") == series)
    return own.withColumns({"peak": F.max("count").over(whole), "total": F.sum("count").over(whole)}).orderBy("month")


#: What each audience reads: a roll-up level, and whether a state can be chosen.
AUDIENCES = {"ministry": ("state", False), "state": ("district", True), "district": ("district", False), "mp": ("member", False), "vendor": ("vendor", False)}


def audience_view(levels: DataFrame, audience: str, state: str | None = None) -> DataFrame:
    """The rows of all_rollups() that an audience reads; of one state where the
    audience is a state and one is chosen."""
    level, by_state = AUDIENCES.get(audience, AUDIENCES["vendor"])
    out = levels.where(F.col("level") == level)
    return out.where(F.col("state") == state) if by_state and state else out


def warnings_view(warnings: DataFrame, state: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The warnings of a state, or all, and how many there are and have no payment."""
    rows = warnings.where(F.col("state") == state) if state else warnings
    return rows, rows.agg(F.count(F.lit(1)).alias("warnings"), F.count_if(F.col("total_expenditure").isNull()).alias("without_payment"))
