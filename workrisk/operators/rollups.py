"""Roll-ups, series, queues and warnings over scored works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workrisk.functions.numeric import is_true, mean_of, money_sum, round_scaled, share_percent

#: An open work without a payment for so long has stalled.
STALLED_DAYS = 365


def _measures() -> list[Column]:
    high, flagged = F.col("risk_band") == "High", F.col("risk_band") != "Low"
    return [
        F.count(F.lit(1)).alias("works"), money_sum(F.col("sanction_amount")).alias("sanctioned"), money_sum(F.col("total_expenditure")).alias("expenditure"),
        F.count_if("is_completed").alias("completed"), F.count_if(high).alias("high_risk"), F.count_if(flagged).alias("flagged"),
        mean_of(F.col("risk_score"), 2, 1).alias("mean_risk"), mean_of(F.col("confidence"), 3, 3).alias("mean_confidence"),
    ]


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "utilisation_pct": share_percent(F.col("expenditure"), F.col("sanctioned")),
        "completion_pct": share_percent(F.col("completed"), F.col("works")),
        "high_risk_pct": share_percent(F.col("high_risk"), F.col("works")),
    })


def rollup(scored: DataFrame, keys: list[str], least: int = 0) -> DataFrame:
    """One level, most high-risk works first; null keys are a group like others."""
    out = scored.groupBy(*keys).agg(*_measures())
    return _rates(out.where(F.col("works") >= least) if least else out).orderBy(F.desc("high_risk"), *keys)


#: Rows of the longer roll-ups that a viewer gets.
CAPS = {"district": 400, "vendor": 300}


def capped(levels: DataFrame, name: str) -> DataFrame:
    """Groups with most high-risk works first, as many as a viewer gets."""
    ordered = levels.orderBy(F.desc("high_risk"), F.desc("works"), *levels.columns[:2])
    return ordered.limit(CAPS[name]) if name in CAPS else ordered


def all_rollups(scored: DataFrame) -> DataFrame:
    """State, district, member and vendor levels in one pass over the works."""
    levels = {"state": ["state"], "district": ["state", "district"], "member": ["mp_name", "state"], "vendor": ["primary_vendor", "district"]}
    columns = ["state", "district", "mp_name", "primary_vendor"]
    out = scored.groupingSets(list(levels.values()), *columns).agg(*_measures(), F.grouping_id().alias("_g"))
    bit = {c: 1 << (len(columns) - 1 - k) for k, c in enumerate(columns)}
    number = {sum(bit[c] for c in columns if c not in own): name for name, own in levels.items()}
    name = F.create_map(*[F.lit(x) for kv in number.items() for x in kv])
    out = out.withColumn("level", name[F.col("_g").cast("int")]).drop("_g")
    vendor = F.col("level") == "vendor"
    return _rates(out.where(~vendor | (F.col("primary_vendor").isNotNull() & (F.col("works") >= 5))))


def national(scored: DataFrame) -> DataFrame:
    """The headline figures of the whole register."""
    high, flagged = F.col("risk_band") == "High", F.col("risk_band") != "Low"
    out = scored.agg(
        F.count(F.lit(1)).alias("works"), F.countDistinct("state").alias("states"), F.countDistinct("district").alias("districts"), F.countDistinct("mp_name").alias("mps"),
        money_sum(F.col("sanction_amount")).alias("sanctioned"), money_sum(F.col("total_expenditure")).alias("expenditure"), F.count_if("is_completed").alias("completed"),
        F.count_if(high).alias("high_risk"), F.count_if(flagged).alias("flagged"),
    )
    return out.withColumn("utilisation_pct", share_percent(F.col("expenditure"), F.col("sanctioned"))).withColumn("completion_pct", share_percent(F.col("completed"), F.col("works")))


def dashboard(scored: DataFrame) -> DataFrame:
    """The scalars of the first page."""
    return scored.agg(
        F.count(F.lit(1)).alias("works_total"), F.count_if(F.col("risk_band") != "Low").alias("works_requiring_review"), F.count_if(F.col("risk_band") == "High").alias("high_priority"),
        F.count_if("is_completed").alias("works_completed"), F.count_if("has_expenditure").alias("works_with_expenditure"), money_sum(F.col("sanction_amount")).alias("total_sanctioned"),
        money_sum(F.col("total_expenditure")).alias("total_expenditure"), mean_of(F.col("data_completeness"), 3, 3).alias("mean_data_completeness"),
    )


def band_summary(scored: DataFrame) -> DataFrame:
    """Bands that occur, High, Medium, Low, with their share of all works."""
    mean = lambda c, digits: F.sum(F.round(F.col(c) * 10**digits).cast("long")) / F.count(c) / 10.0**digits
    out = scored.groupBy("risk_band").agg(F.count(F.lit(1)).alias("works"), mean("risk_score", 2).alias("mean_score"), mean("confidence", 3).alias("mean_confidence"))
    out = out.withColumn("share_pct", F.round(F.col("works") * 100 / F.sum("works").over(Window.partitionBy()), 1))  # three rows
    return out.orderBy(F.array_position(F.array(F.lit("High"), F.lit("Medium"), F.lit("Low")), F.col("risk_band")))


def reason_counts(scored: DataFrame) -> DataFrame:
    return scored.where("risk_band <> 'Low'").groupBy("primary_reason").agg(F.count(F.lit(1)).alias("works"))


def monthly(works: DataFrame) -> DataFrame:
    """Works by the month of sanction, of completion and of first payment: their
    number, and the amounts sanctioned or spent. Three clocks, three series."""
    def series(df: DataFrame, day: str, amount: str, name: str) -> DataFrame:
        known = df.where(F.col(day).isNotNull())
        return known.groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("count"), money_sum(F.col(amount)).alias("amount")).withColumn("series", F.lit(name))

    sanctioned = series(works, "sanction_date", "sanction_amount", "sanctioned")
    completed = series(works.where("is_completed"), "completion_date", "sanction_amount", "completed")
    return sanctioned.unionByName(completed).unionByName(series(works.where("total_expenditure IS NOT NULL"), "first_payment_date", "total_expenditure", "expenditure"))


def risk_by_month(scored: DataFrame) -> DataFrame:
    """The mean comes from a sum of whole hundredths, so the order of rows doesn't
    decide; it is rounded as SQL rounds the double."""
    mean = round_scaled(F.sum(F.round(F.col("risk_score") * 100).cast("long")) / 100.0 / F.count("risk_score"), 2)
    known = scored.where("sanction_date IS NOT NULL").groupBy(F.date_format("sanction_date", "yyyy-MM").alias("month"))
    out = known.agg(F.count(F.lit(1)).alias("works"), F.count_if(F.col("risk_band") == "High").alias("high"), F.count_if(F.col("risk_band") == "Medium").alias("medium"), mean.alias("mean_risk"))
    return out.withColumn("high_pct", share_percent(F.col("high"), F.col("works")))


def member_utilisation(scored: DataFrame) -> DataFrame:
    out = scored.groupBy("mp_name", "state").agg(
        F.count(F.lit(1)).alias("works"), money_sum(F.col("sanction_amount")).alias("sanctioned"), money_sum(F.col("total_expenditure")).alias("expenditure"),
        F.count_if("is_completed").alias("completed"), F.count_if(F.col("risk_band") == "High").alias("high_risk"),
    )
    return out.withColumn("utilisation_pct", share_percent(F.col("expenditure"), F.col("sanctioned")))


def _with_allocation(rows: DataFrame, allocation: DataFrame) -> DataFrame:
    own = allocation.select("mp_name", "state", "constituency", F.col("allocated_amount").alias("allocated"))
    return rows.join(own, ["mp_name", "state"], "left")


def allocation_counts(rows: DataFrame, allocation: DataFrame) -> tuple[int, int, int]:
    """Members that an allocation file matches, members in all, and members it lists."""
    one = _with_allocation(rows, allocation).agg(F.count("allocated").alias("m"), F.count(F.lit(1)).alias("n")).head()
    return one.m, one.n, allocation.count()


def fund_utilisation(scored: DataFrame, allocation: DataFrame | None, least_match_pct: float = 20.0) -> tuple[DataFrame, bool, float]:
    """Utilisation by member, with allocations where enough of them match; rows,
    whether they were joined, and the match rate."""
    rows = member_utilisation(scored)
    if allocation is None:
        return rows, False, 0.0
    joined = _with_allocation(rows, allocation)
    matched, members, _ = allocation_counts(rows, allocation)
    rate = round(100 * matched / max(members, 1), 1)
    if rate < least_match_pct:
        return rows, False, rate
    out = joined.withColumn("sanctioned_pct_of_allocation", share_percent(F.col("sanctioned"), F.col("allocated")))
    out = out.withColumn("spent_pct_of_allocation", share_percent(F.col("expenditure"), F.col("allocated")))
    return out.withColumn("allocation_matched", F.col("allocated").isNotNull()), True, rate


def utilisation_note(joined: bool, rate: float, supplied: bool = True, matched: int = 0, members: int = 0, listed: int = 0) -> str:
    """What the viewer says of the allocation, with the counts behind it."""
    if not supplied:
        return "No allocation file was supplied, so utilisation is against sanctioned amounts only."
    if not joined:
        return (
            f"The allocation file could not be joined: only {matched} of {members} members match it ({rate}%). It lists {listed} members with constituencies, "
            "and the works' members may have none, as in the other house; the two would then describe different houses. "
            "Figures are against sanctioned amounts only; the matching allocation export would give utilisation against entitlement."
        )
    return f"{matched} of {members} members match the allocation file ({rate}%)."


def early_warning(scored: DataFrame, as_of: str, most: int | None = 300) -> DataFrame:
    """Open works far past their peers' duration, without a payment at all or for
    over a year."""
    gap = F.date_diff(F.lit(as_of).cast("date"), F.col("last_payment_date"))
    late = is_true(F.col("days_sanction_to_reference") > F.col("peer_median_duration") * 1.5)
    unpaid = ~F.col("has_expenditure")
    reason = F.when(unpaid, "Open past the peer-group duration with no payment recorded at all").otherwise("Open past the peer-group duration with no payment for over a year")
    out = scored.withColumn("days_since_last_payment", gap).where(~F.col("is_completed") & late & (unpaid | is_true(gap > STALLED_DAYS))).withColumn("warning_reason", reason)
    columns = ["work_id", "work_description", "state", "district", "mp_name", "sanction_amount", "sanction_date", "days_sanction_to_reference", "peer_median_duration",
               "days_since_last_payment", "total_expenditure", "risk_score", "risk_band", "confidence_band", "warning_reason"]
    out = out.select(*[c for c in columns if c in out.columns]).orderBy(F.desc("days_sanction_to_reference"), "work_id")
    return out.limit(most) if most else out


def pipeline_by_state(open_recommendations: DataFrame) -> DataFrame:
    """Open recommendations by state, most first."""
    out = open_recommendations.groupBy("state").agg(F.count(F.lit(1)).alias("works"), money_sum(F.col("recommended_amount")).alias("value"))
    return out.orderBy(F.desc("works"), "state")


def pipeline_totals(open_recommendations: DataFrame, works: DataFrame) -> DataFrame:
    """All open recommendations, their value, and their share of those and the
    sanctioned works together."""
    out = open_recommendations.agg(F.count(F.lit(1)).alias("works"), money_sum(F.col("recommended_amount")).alias("value"))
    out = out.crossJoin(F.broadcast(works.agg(F.count(F.lit(1)).alias("_sanctioned"))))
    total = F.col("works") + F.col("_sanctioned")
    return out.select((F.col("works") > 0).alias("available"), "works", "value", total.alias("recommended_in_total"), share_percent(F.col("works"), total).alias("share_pct"))


def oldest_recommendations(open_recommendations: DataFrame, order: list[str], most: int = 200) -> DataFrame:
    return open_recommendations.orderBy(F.asc_nulls_last("recommended_on"), *order).limit(most)


def agencies(scored: DataFrame, least: int = 5) -> DataFrame:
    """A district's implementing agencies with enough works, riskiest first; works
    without an agency or a district are groups like others."""
    out = scored.groupBy("district", "implementing_agency").agg(
        F.count(F.lit(1)).alias("works"), money_sum(F.col("effective_cost")).alias("total_cost"), mean_of(F.col("risk_score"), 1, 1).alias("mean_risk"), F.count_if(F.col("risk_band") == "High").alias("high_risk_works")
    )
    out = out.where(F.col("works") >= least).withColumn("high_risk_rate", F.round(F.col("high_risk_works") / F.col("works"), 3))
    return out.orderBy(F.desc("mean_risk"), "district", "implementing_agency")


def queue(scored: DataFrame, most: int = 0) -> DataFrame:
    """The riskiest works first; 0 stands for all."""
    out = scored.orderBy(F.desc("risk_score"), F.desc("confidence"), "work_id")
    return out.limit(most) if most > 0 else out
