"""The labelled benchmark: features, detectors and scores of a project register."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workrisk.config import BENCHMARK_LABELS, EXPECTED_DAYS, INADMISSIBLE, BenchmarkConfig, RiskConfig
from workrisk.functions.numeric import is_true, mean_of, ramp_or_zero, ratio
from workrisk.operators import multivariate as mv
from workrisk.operators.peers import group_size, percent_rank, robust_z
from workrisk.operators.ranks import quantiles
from workrisk.operators.scoring import band, combine, explain
from workrisk.operators.similarity import similarity_nearby
from workrisk.plans.storage import stored

REQUIRED = (
    "project_id", "state", "district", "block", "latitude", "longitude", "mp_name", "constituency", "sector", "work_category", "work_description", "implementing_agency",
    "sanction_date", "expected_completion_date", "actual_completion_date", "sanctioned_cost", "revised_cost", "expenditure", "physical_progress_pct", "status",
)
#: What a register read from CSV holds besides strings.
TYPES = {"latitude": "double", "longitude": "double", "sanction_date": "date", "expected_completion_date": "date", "actual_completion_date": "date", "sanctioned_cost": "double",
         "revised_cost": "double", "expenditure": "double", "physical_progress_pct": "double", "is_anomaly": "boolean"}
# What the models see, quantities without a scale.
FEATURES = ("cost_robust_z", "delay_ratio", "progress_gap_pct", "cost_escalation_pct", "physical_progress_pct", "expenditure_ratio_pct", "agency_work_share", "agency_value_share")
ASSESSMENT = "Unusual pattern identified for human review. This score does not establish irregularity or fraud."
NOTHING = "No material risk indicator"


def expected_days(category: Column) -> Column:
    """The category's usual days, or the median of all."""
    known = sorted(EXPECTED_DAYS.values())
    middle = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2
    return F.coalesce(F.create_map(*[F.lit(x) for kv in EXPECTED_DAYS.items() for x in (kv[0], float(kv[1]))])[category], F.lit(middle))


def features(register: DataFrame, config: BenchmarkConfig = BenchmarkConfig()) -> DataFrame:
    """Peers are works of a category in a state. The cost is the revised one where
    there is one, else the sanctioned one."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    out = register.withColumn("effective_cost", F.coalesce("revised_cost", "sanctioned_cost")).withColumn("peer_group", F.concat_ws(" | ", named("work_category"), named("state")))
    out = group_size(out, ["peer_group"], "peer_size")
    out = robust_z(out, "peer_group", "effective_cost", "_z")
    out = out.withColumn("cost_robust_z", F.when(F.col("peer_size") < config.min_peer_group, F.col("_z") * 0.4).otherwise(F.col("_z"))).drop("_z")
    medians = quantiles(out, "peer_group", {"peer_median_cost": (F.col("effective_cost"), 0.5)}).withColumnRenamed("peer_group", "_key")
    out = out.join(medians, F.col("peer_group") == F.col("_key"), "left").drop("_key")
    out = percent_rank(out, "effective_cost", "_rank", "peer_group").withColumn("peer_cost_percentile", F.round(F.coalesce("_rank", F.lit(0.5)) * 100, 1)).drop("_rank")
    today = F.lit(str(config.as_of)).cast("date")
    elapsed = F.date_diff(F.coalesce(F.col("actual_completion_date"), today), F.col("sanction_date"))
    expected = expected_days(F.col("work_category"))
    over = F.when(elapsed.isNotNull(), F.greatest(elapsed - expected, F.lit(0.0)))
    out = out.withColumns({
        "elapsed_days": elapsed,
        "expected_duration_days": expected,
        "overrun_days": over,
        "delay_ratio": F.coalesce(over / expected, F.lit(0.0)),
        "expenditure_ratio_pct": ratio(F.col("expenditure"), F.col("effective_cost")) * 100,
        "cost_escalation_pct": F.coalesce(ratio(F.col("revised_cost") - F.col("sanctioned_cost"), F.col("sanctioned_cost")) * 100, F.lit(0.0)),
    })
    out = out.withColumn("progress_gap_pct", F.col("expenditure_ratio_pct") - F.col("physical_progress_pct"))
    there = [F.col(c).isNotNull().cast("int") for c in config.confidence_fields if c in register.columns]
    out = out.withColumn("data_completeness", reduce(lambda a, b: a + b, there) / len(there))
    return agency_shares(out)


def agency_shares(df: DataFrame) -> DataFrame:
    """An agency's share of its district's works, and of their cost. Works without
    an agency are one agency; works without a district have no share."""
    money = lambda name: F.sum(F.col("effective_cost").cast("decimal(20,2)")).cast("double").alias(name)
    total = df.where("district IS NOT NULL").groupBy(F.col("district").alias("_d")).agg(F.count(F.lit(1)).alias("_works"), money("_cost"))
    own = df.where("district IS NOT NULL").groupBy(F.col("district").alias("_e"), F.col("implementing_agency").alias("_a")).agg(F.count(F.lit(1)).alias("_own_works"), money("_own_cost"))
    out = df.join(total, F.col("district") == F.col("_d"), "left").join(own, (F.col("district") == F.col("_e")) & F.col("implementing_agency").eqNullSafe(F.col("_a")), "left")
    return out.withColumns({
        "agency_work_share": ratio(F.col("_own_works"), F.col("_works")),
        "agency_value_share": ratio(F.col("_own_cost"), F.col("_cost")),
    }).drop("_d", "_e", "_a", "_works", "_cost", "_own_works", "_own_cost")


def delay(config: BenchmarkConfig) -> Column:
    return ramp_or_zero(F.col("delay_ratio") - config.delay_floor, config.delay_full - config.delay_floor)


def mismatch(config: BenchmarkConfig) -> Column:
    return ramp_or_zero(F.col("progress_gap_pct") - config.mismatch_floor, config.mismatch_full - config.mismatch_floor)


# The wording and weights of the rules.
def rule_weights(config: BenchmarkConfig) -> list[tuple[str, Column, float]]:
    c = F.col
    return [
        ("Work category is inadmissible under the scheme's guidelines", c("work_category").isin(*INADMISSIBLE), 1.0),
        (f"Sanctioned cost exceeds the single-work ceiling of Rs {config.ceiling:,.0f}", c("effective_cost") > config.ceiling, 0.8),
        (f"Cost revised upward by more than {config.escalation_percent:.0f}% without re-sanction", c("cost_escalation_pct") > config.escalation_percent, 0.5),
        ("Expenditure booked exceeds the sanctioned amount", c("expenditure_ratio_pct") > 100.5, 0.7),
        ("Reported as fully progressed but not closed as completed", (c("physical_progress_pct") >= 99.5) & ~c("status").eqNullSafe("Completed"), 0.3),
        ("Implementing agency holds an unusually large share of the district's works", c("agency_work_share") > 0.45, 0.3),
    ]


def signals(df: DataFrame, config: BenchmarkConfig = BenchmarkConfig()) -> DataFrame:
    rules = [(name, is_true(broken), w) for name, broken, w in rule_weights(config)]
    total = reduce(lambda a, b: a + b, [F.when(broken, F.lit(w)).otherwise(F.lit(0.0)) for _, broken, w in rules])
    return df.withColumns({
        "signal_cost_deviation": ramp_or_zero(F.greatest(F.col("cost_robust_z"), F.lit(0.0)), config.cost_z_full),
        "signal_delay": delay(config),
        "signal_expenditure_mismatch": mismatch(config),
        "signal_compliance": F.least(F.lit(1.0), total),
        "compliance_reasons": F.array_join(F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken, _ in rules])), "; "),
    })


# The wording of the sentences.
def details() -> dict[str, Column]:
    """A sentence for each of the benchmark's indicators."""
    c = F.col
    grouped = lambda x: F.format_number(F.bround(x, 0), 0)
    whole = lambda x: F.format_string("%.0f", F.bround(x, 0))
    number = lambda x: x.cast("int").cast("string")
    cost = F.concat(F.lit("Sanctioned at Rs "), grouped(c("effective_cost")), F.lit(" against a peer median of Rs "), grouped(c("peer_median_cost")), F.lit(" ("), whole(c("peer_cost_percentile")),
                    F.lit("th percentile for "), c("work_category"), F.lit(" in "), c("state"), F.lit(")"))
    late = F.concat(number(c("overrun_days")), F.lit(" days beyond the "), number(c("expected_duration_days")), F.lit("-day norm for this category, at "),
                    F.coalesce(whole(c("physical_progress_pct")), F.lit("nan")), F.lit("% physical progress"))
    spent = F.concat(F.coalesce(whole(c("expenditure_ratio_pct")), F.lit("nan")), F.lit("% of funds drawn against "), F.coalesce(whole(c("physical_progress_pct")), F.lit("nan")), F.lit("% physical progress"))
    alike = F.when(c("duplicate_match_id") != "", F.concat(F.lit("Closely resembles "), c("duplicate_match_id"), F.lit(", a "), c("work_category"), F.lit(" sanctioned nearby in "), c("district")))
    return {
        "cost_deviation": F.coalesce(cost, F.lit("Cost is high relative to similar works")),
        "delay": F.coalesce(late, F.lit("Running behind the expected timeline")),
        "expenditure_mismatch": spent,
        "duplicate": F.coalesce(alike, F.lit("Description closely resembles another nearby work")),
        "compliance": F.coalesce(F.nullif("compliance_reasons", F.lit("")), F.lit("Guideline check failed")),
        "multivariate": F.concat(F.lit("Combination of indicators is unusual for this peer group"), F.when(c("multivariate_drivers") != "", F.concat(F.lit(" ("), c("multivariate_drivers"), F.lit(")"))).otherwise(F.lit(""))),
    }


def score(df: DataFrame, config: BenchmarkConfig = BenchmarkConfig()) -> DataFrame:
    """Points, score, band, confidence, reasons and review status of works with
    signals. The score is rounded by itself, to one place."""
    out = combine(df, config.caps, score_digits=1).withColumn("risk_band", band(F.col("risk_score"), config.band_high, config.band_medium))
    adequate = F.least(F.col("peer_size") / float(config.min_peer_group), F.lit(1.0))
    out = out.withColumn("confidence", F.round(0.7 * F.col("data_completeness") + 0.3 * F.coalesce(adequate, F.lit(0.0)), 3))
    if "multivariate_drivers" not in out.columns:
        out = out.withColumn("multivariate_drivers", F.lit(""))
    out = explain(out, BENCHMARK_LABELS, details(), NOTHING, ASSESSMENT)
    return out.withColumn("review_status", F.when(F.col("risk_band") == "High", "Pending review").otherwise("Not queued"))


def check_register(register: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED if c not in register.columns]
    if missing:
        raise ValueError(f"Register is missing required columns: {', '.join(missing)}")
    return register


def run(register: DataFrame, config: BenchmarkConfig = BenchmarkConfig(), model: RiskConfig = RiskConfig(dbscan_eps=1.10, dbscan_neighbours=8, model_rows=2)) -> DataFrame:
    """Scored projects: points per indicator, score, band, confidence, reasons."""
    # stored where the next step reads a table several times
    out = stored(signals(stored(features(stored(check_register(register)), config)), config))
    out = stored(similarity_nearby(out, config.duplicate_floor, config.duplicate_km))
    out = out.withColumnsRenamed({"signal_similarity": "signal_duplicate", "similar_project_id": "duplicate_match_id"})
    out = mv.multivariate(out, model, "project_id", FEATURES, drivers="multivariate_drivers")
    return score(stored(out), config)


def queue(scored: DataFrame, most: int = 50) -> DataFrame:
    """The riskiest projects first, the more certain of two alike."""
    columns = ("project_id", "district", "state", "work_category", "implementing_agency", "effective_cost", "risk_score", "risk_band", "confidence", "primary_reason", "review_status")
    return scored.orderBy(F.desc("risk_score"), F.desc("confidence"), "project_id").limit(most).select(*columns)


def dashboard(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("projects_analysed"), F.count_if(F.col("risk_band") != "Low").alias("potential_risks"), F.count_if(F.col("review_status") == "Pending review").alias("pending_review"),
    )


def band_summary(scored: DataFrame) -> DataFrame:
    """Bands that occur, High, Medium, Low."""
    out = scored.groupBy("risk_band").agg(F.count(F.lit(1)).alias("projects"), mean_of(F.col("risk_score"), 1, 1).alias("mean_score"), mean_of(F.col("confidence"), 3, 3).alias("mean_confidence"))
    out = out.withColumn("share_pct", F.round(F.col("projects") * 100 / F.sum("projects").over(Window.partitionBy()), 1))  # three rows
    return out.orderBy(F.array_position(F.array(F.lit("High"), F.lit("Medium"), F.lit("Low")), F.col("risk_band")))


def reason_summary(scored: DataFrame) -> DataFrame:
    flagged = scored.where("risk_band <> 'Low'")
    return flagged.groupBy(F.col("primary_reason").alias("reason")).agg(F.count(F.lit(1)).alias("projects")).orderBy(F.desc("projects"), "reason")
