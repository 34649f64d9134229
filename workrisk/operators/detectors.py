"""Detectors: each turns features into a signal from 0 to 1. Null means "could not
be checked", 0 means "checked, nothing found"."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workrisk.config import TIER_WEIGHT, RiskConfig, Rule
from workrisk.functions.numeric import is_true, ramp
from workrisk.operators.ranks import quantiles


@dataclass
class Detector:
    """What a detector needs and the signal it makes of it."""

    name: str
    fields: tuple[str, ...]
    signal: Column

    def on(self, df: DataFrame) -> Column:
        """The signal, or null for all rows where a field is missing."""
        return F.lit(None).cast("double") if self.missing(df) else self.signal

    def missing(self, df: DataFrame) -> list[str]:
        return [f for f in self.fields if f not in df.columns]


def percentiles(works: DataFrame, config: RiskConfig) -> DataFrame:
    """The register's own thresholds, one row."""
    lag, count = "days_recommendation_to_sanction", "payment_count"
    return quantiles(works, None, {
        "lag_floor": (F.col(lag), config.lag_floor_percentile),
        "lag_full": (F.col(lag), config.lag_full_percentile),
        "payments_floor": (F.when(F.col("has_expenditure"), F.col(count)), config.payments_percentile),
    })


def with_percentiles(works: DataFrame, config: RiskConfig) -> DataFrame:
    """The thresholds joined to all works."""
    return works.crossJoin(F.broadcast(percentiles(works, config)))


def cost_deviation(config: RiskConfig) -> Detector:
    z = F.greatest(F.col("cost_robust_z"), F.lit(0.0))
    usable = F.col("peer_key").isNotNull() & F.col("sanction_amount").isNotNull()
    return Detector("cost_deviation", ("sanction_amount", "peer_key"), F.when(usable, F.least(F.lit(1.0), z / config.cost_z_full)))


def timeline(config: RiskConfig) -> Detector:
    """The worse of duration against peers and lag against the register; null
    where there is neither."""
    duration = ramp(F.col("duration_ratio"), config.duration_floor, config.duration_full)
    lag = ramp(F.col("days_recommendation_to_sanction").cast("double"), F.col("lag_floor"), F.greatest(F.col("lag_full"), F.col("lag_floor") + 1))
    return Detector("timeline", ("days_sanction_to_reference", "days_recommendation_to_sanction"), F.greatest(duration, lag))


def expenditure_consistency(config: RiskConfig) -> Detector:
    done, paid = F.col("is_completed"), F.col("has_expenditure")
    under = ramp(F.col("underspend_gap"), config.underspend_floor, config.underspend_full)
    unpaid = F.when(done & ~paid, F.lit(config.unpaid_signal))
    split = ramp(F.col("payment_count").cast("double"), F.col("payments_floor"), config.payments_full)
    pending = F.when(F.col("payments_not_successful") > 0, F.lit(config.pending_signal))
    worst = F.greatest(F.coalesce(under, F.lit(0.0)), unpaid, split, pending)
    return Detector("expenditure_consistency", ("total_expenditure", "sanction_amount"), F.when(is_true(paid) | is_true(done), worst))


def rule_conditions(config: RiskConfig) -> dict[str, Column]:
    c = F.col
    return {
        "FIN_001": c("total_expenditure") > c("sanction_amount"),
        "FIN_002": c("max_single_payment") > c("sanction_amount"),
        "FIN_003": c("is_completed") & ~c("has_expenditure"),
        "DATE_001": c("first_payment_date") < c("sanction_date"),
        "DATE_002": c("completion_date") < c("sanction_date"),
        "DATE_003": c("days_recommendation_to_sanction") > c("lag_full"),
        "CEIL_001": c("sanction_amount") > config.ceiling,
        "DUP_001": c("identical_description_count") > 1,
        "COST_002": c("sanction_uplift_pct") > config.uplift_percent,
    }


def evaluable(df: DataFrame, config: RiskConfig) -> list[tuple[Rule, Column]]:
    """The rules whose fields the table has, in order, with their conditions."""
    conditions = rule_conditions(config)
    return [(r, is_true(conditions[r.rule_id])) for r in config.rules if r.rule_id in conditions and all(f in df.columns for f in r.fields)]


def compliance(df: DataFrame, config: RiskConfig) -> DataFrame:
    """signal_compliance and rule_reasons; rules without their fields count as not
    evaluated, never as passed."""
    rules = evaluable(df, config)
    total = F.lit(0.0)
    for rule, broken in rules:
        total = total + F.when(broken, F.lit(rule.weight)).otherwise(F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(broken, F.lit(f"[{rule.rule_id}] {rule.name}")) for rule, broken in rules]))
    return df.withColumn("signal_compliance", F.least(F.lit(1.0), total)).withColumn("rule_reasons", F.array_join(reasons, "; "))


def rule_report(df: DataFrame, config: RiskConfig) -> DataFrame:
    """Per rule: whether it could be evaluated, and how many works break it."""
    rules = dict((r.rule_id, broken) for r, broken in evaluable(df, config))
    parts = [
        F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit("evaluated" if r.rule_id in rules else "not_evaluated").alias("status"),
                 (F.count_if(rules[r.rule_id]) if r.rule_id in rules else F.lit(0).cast("long")).alias("flagged"))
        for r in config.rules
    ]
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def rule_details(df: DataFrame, config: RiskConfig) -> list[dict]:
    """rule_report() with the rules' names, types, sources and explanations; of a
    rule that could not be evaluated, the fields that it lacks."""
    found = {r.rule_id: r for r in rule_report(df, config).collect()}
    out = []
    for r in config.rules:
        status, lacking = found[r.rule_id].status, [f for f in r.fields if f not in df.columns]
        own = {"rule_id": r.rule_id, "name": r.name, "rule_type": r.tier, "source": r.source, "status": status, "records_flagged": found[r.rule_id].flagged}
        if status == "evaluated":
            own |= {"tier_weight": TIER_WEIGHT[r.tier], "explanation": r.explanation}
        else:
            own["explanation"] = f"Not evaluated, since the data lack {', '.join(lacking) or 'what it needs'}"
        out.append(own)
    return out


#: What a detector does, and the fields without which it can't.
REASONS = {
    "cost_deviation": ("The sanctioned amount against the median of its peers, on a logarithmic scale, in median absolute deviations.", ("sanction_amount", "peer_key")),
    "timeline": ("The duration against the peers' median, and the time from recommendation to sanction against a configurable threshold.", ("days_sanction_to_reference", "days_recommendation_to_sanction")),
    "expenditure_consistency": ("Disbursement against sanction for completed works, and the number and status of payments.", ("total_expenditure", "sanction_amount")),
    "similarity": ("Descriptions of a district compared by character n-grams. A match may be a similar work and needs verification.", ("description_normalised", "district")),
    "compliance": ("Deterministic checks, whose thresholds are administrative or analytical choices.", ()),
    "multivariate": ("Combinations of features that an isolation forest and density noise find unusual.", ()),
}


def detector_details(df: DataFrame, names: tuple[str, ...]) -> list[dict]:
    """detector_report() with what each detector does, or the fields that it lacks."""
    out = []
    for r in detector_report(df, names).collect():
        reason, fields = REASONS[r.detector]
        lacking = [f for f in fields if f not in df.columns]
        if r.status != "evaluated":
            reason = f"Not evaluated, since the data lack {', '.join(lacking)}" if lacking else "Not evaluated: too few works, or none with what it needs"
        out.append({"detector": r.detector, "status": "active" if r.status == "evaluated" else "skipped", "reason": reason, "records_evaluated": r.evaluated, "records_flagged": r.flagged, "missing_fields": lacking})
    return out


def detect(works: DataFrame, config: RiskConfig, thresholds: DataFrame | None = None) -> DataFrame:
    """All row-wise detectors as signal_<name>, with the thresholds they used: those of
    ``works``, or the given ones where ``works`` are a part of the register."""
    out = with_percentiles(works, config) if thresholds is None else works.crossJoin(F.broadcast(thresholds))
    for d in (cost_deviation(config), timeline(config), expenditure_consistency(config)):
        out = out.withColumn(f"signal_{d.name}", d.on(works))
    return compliance(out, config)


def detector_report(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Per detector: works evaluated, works with a signal, and its status."""
    signal = lambda n: F.col(f"signal_{n}")
    parts = [F.struct(F.lit(n).alias("detector"), F.count(signal(n)).alias("evaluated"), F.count_if(signal(n) > 0).alias("flagged"),
                      F.when(F.count(signal(n)) > 0, "evaluated").otherwise("skipped").alias("status")) for n in names]
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")
