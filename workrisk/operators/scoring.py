"""Independent evidence into points that add up to the score, with a separate
confidence and explanations."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workrisk.config import INDICATORS, LABELS, PEER_STRENGTH, RiskConfig, check_caps
from workrisk.functions.numeric import round_scaled
from workrisk.functions.text import fixed, rupees

ASSESSMENT = (
    "This work exhibits unusual patterns under the configured indicators and may warrant further review. "
    "The system does not establish fraud or wrongdoing."
)


def evidence(signal: Column, cap: float) -> Column:
    """-ln(1 - cap * signal); nothing where the signal is missing."""
    return -F.ln(1 - F.lit(cap) * F.least(F.coalesce(signal, F.lit(0.0)), F.lit(0.999)))


def _half_away(x: float, digits: int) -> float:
    scaled = x * 10.0**digits
    low = math.floor(scaled)
    return (low + (scaled - low >= 0.5)) / 10.0**digits


def _by_c(signals: list[float], caps: list[float], digits: int, score_digits: int) -> list[float]:
    """Points and score of one work by C's logarithm and exponential, which differ
    from the JVM's in the last place."""
    e = [-math.log(1 - cap * min(s, 0.999)) for s, cap in zip(signals, caps, strict=True)]
    total = sum(e[1:], e[0])
    risk = 1 - math.exp(-total)
    return [*[_half_away(x / total * 100 * risk, digits) + 0.0 if total > 0 else 0.0 for x in e], _half_away(100 * risk, score_digits)]


def _at_a_tie(c: Column, digits: int) -> Column:
    """So near a place where rounding turns that the last bits decide."""
    scaled = c * float(10**digits)
    return F.abs(scaled - F.floor(scaled) - 0.5) < 1e-7


def combine(df: DataFrame, caps: dict[str, float], digits: int = 2, score_digits: int | None = None) -> DataFrame:
    """Noisy-or of the signals. The points are shares of the score in proportion
    to the evidence, rounded first; the score is their sum, so it decomposes
    exactly, unless it is to be rounded by itself to ``score_digits``."""
    check_caps(caps)
    e = {n: evidence(F.col(f"signal_{n}"), cap) for n, cap in caps.items()}
    total = sum(list(e.values())[1:], list(e.values())[0])
    out = df.withColumn("_total", total)
    risk = 1 - F.exp(-F.col("_total"))
    share = {n: F.try_divide(x, F.col("_total")) * 100 * risk for n, x in e.items()}
    points = {n: F.when(F.col("_total") > 0, round_scaled(x, digits) + 0.0).otherwise(F.lit(0.0)) for n, x in share.items()}
    if score_digits is None:
        out = out.withColumns({f"points_{n}": x for n, x in points.items()})
        own = [F.col(f"points_{n}") for n in caps]
        return out.withColumn("risk_score", F.round(sum(own[1:], own[0]), digits)).drop("_total")
    # signals in steps of a hundredth make scores that lie between two steps; the few
    # rows at such a place are worked out anew
    near = reduce(lambda a, b: a | b, [_at_a_tie(x, digits) for x in share.values()], _at_a_tie(100 * risk, score_digits))
    anew = F.udf(lambda s: s and _by_c(s, list(caps.values()), digits, score_digits), "array<double>", useArrow=True)
    signals = F.array(*[F.coalesce(F.col(f"signal_{n}"), F.lit(0.0)) for n in caps])
    out = out.withColumn("_tie", F.when((F.col("_total") > 0) & near, signals))
    out = out.withColumn("_anew", F.when(F.col("_tie").isNotNull(), anew("_tie")))
    out = out.withColumns({f"points_{n}": F.coalesce(F.col("_anew")[k], x) for k, (n, x) in enumerate(points.items())})
    return out.withColumn("risk_score", F.coalesce(F.col("_anew")[len(caps)], round_scaled(100 * risk, score_digits))).drop("_total", "_tie", "_anew")


def band(score: Column, high: float, medium: float) -> Column:
    return F.when(score >= high, "High").when(score >= medium, "Medium").otherwise("Low")


def confidence(df: DataFrame, min_peer_group: int = 8) -> DataFrame:
    """How far a score can be trusted: completeness, detectors that could run, and
    the strength of the peer group."""
    level = F.coalesce(F.create_map(*[F.lit(x) for kv in PEER_STRENGTH.items() for x in kv])[F.col("peer_level")], F.lit(0.0))
    evaluated = sum((F.col(f"signal_{n}").isNotNull().cast("int") for n in INDICATORS[1:]), F.col(f"signal_{INDICATORS[0]}").isNotNull().cast("int"))
    out = df.withColumn("detectors_evaluated", evaluated)
    out = out.withColumn("peer_strength", F.round(0.7 * level + 0.3 * F.least(F.col("peer_size") / (4.0 * min_peer_group), F.lit(1.0)), 3))
    value = 0.30 * F.col("data_completeness") + 0.15 * (F.col("detectors_evaluated") / len(INDICATORS)) + 0.55 * F.col("peer_strength")
    out = out.withColumn("confidence", F.round(value, 3))
    out = out.withColumn("confidence_band", F.when(F.col("confidence") <= 0.55, "Low").when(F.col("confidence") <= 0.78, "Medium").otherwise("High"))
    # The wording.
    reason = (
        F.when(level >= 0.85, "Compared against works of the same type")
        .when(level >= 0.45, "Only a broad category peer group was available")
        .otherwise("No adequate peer group — cost comparison not attempted")
    )
    return out.withColumn("confidence_reason", reason)


def _whole(c: Column) -> Column:
    return F.format_number(F.bround(c.cast("double"), 0), 0)


def _plain(c: Column) -> Column:
    return F.bround(c.cast("double"), 0).cast("long").cast("string")


# The wording of sentences and briefings.
def sentences() -> dict[str, Column]:
    """One sentence an indicator, with the figures behind it."""
    c = F.col
    cost = F.concat(F.lit("Sanctioned at Rs "), _whole(c("sanction_amount")), F.lit(" against a peer median of Rs "), _whole(c("peer_median_cost")), F.lit(" ("), _plain(c("peer_cost_percentile")),
                    F.lit("th percentile among "), c("peer_size").cast("string"), F.lit(" comparable works, grouped by "), c("peer_level"), F.lit(")"))
    days = F.concat(c("days_sanction_to_reference").cast("string"), F.lit(" days since sanction against a peer median of "), c("peer_median_duration").cast("int").cast("string"),
                    F.lit(" days ("), c("age_basis"), F.lit(")"))
    lag = F.concat(c("days_recommendation_to_sanction").cast("string"), F.lit(" days between recommendation and sanction"))
    spent = F.concat(_plain(c("expenditure_ratio") * 100), F.lit("% of the sanctioned amount disbursed across "), c("payment_count").cast("string"), F.lit(" payment(s)"))
    alike = F.concat(F.lit("Description closely resembles "), c("similar_work_id"), F.lit(" in the same district (similarity "), F.format_string("%.2f", F.bround("similarity_score", 2)),
                     F.lit(") — requires verification, not a confirmed duplicate"))
    return {
        "cost_deviation": F.coalesce(cost, F.lit("Cost is high relative to comparable works")),
        "timeline": F.coalesce(F.when(c("peer_median_duration") > 0, days), lag, F.lit("Timeline indicator")),
        "expenditure_consistency": F.when(c("is_completed") & ~c("has_expenditure"), F.lit("Recorded as completed but carries no payment record")).otherwise(F.coalesce(spent, F.lit("Expenditure consistency indicator"))),
        "similarity": F.coalesce(alike, F.lit("Description resembles another nearby work")),
        "compliance": F.coalesce(F.nullif("rule_reasons", F.lit("")), F.lit("Rule-based indicator")),
        "multivariate": F.lit("Combination of indicators is unusual for this peer group"),
    }


def explain(df: DataFrame, labels: dict[str, str] = LABELS, details: dict[str, Column] | None = None, nothing: str = "No material indicator", assessment: str = ASSESSMENT) -> DataFrame:
    """The three largest contributions of three points or more, with sentences."""
    details = sentences() if details is None else details
    parts = [
        F.struct((-F.col(f"points_{n}")).alias("minus"), F.lit(k).alias("place"), F.lit(label).alias("indicator"), F.round(f"points_{n}", 1).alias("points"),
                 F.round(100 * F.col(f"points_{n}") / F.greatest("risk_score", F.lit(1e-9)), 1).alias("share_pct"), details[n].alias("detail"))
        for k, (n, label) in enumerate(labels.items())
    ]
    largest = F.slice(F.filter(F.array_sort(F.array(*parts)), lambda p: p["minus"] <= -3.0), 1, 3)
    out = df.withColumn("explanation", F.transform(largest, lambda p: F.struct(p["indicator"].alias("indicator"), p["points"].alias("points"), p["share_pct"].alias("share_pct"), p["detail"].alias("detail"))))
    first = F.when(F.size("explanation") > 0, F.col("explanation")[0]["indicator"]).otherwise(nothing)
    return out.withColumn("primary_reason", first).withColumn("assessment", F.lit(assessment))


def briefing(df: DataFrame) -> DataFrame:
    """A paragraph for each flagged work, from its own figures; empty for others."""
    c = F.col
    where = F.nullif(F.concat_ws(", ", "district", "state"), F.lit(""))
    opening = F.concat(F.lit("This "), rupees(c("sanction_amount")), F.lit(" sanction"), F.coalesce(F.concat(F.lit(" in "), where), F.lit("")),
                       F.lit(" carries an analytical risk indicator of "), _plain(c("risk_score")), F.lit(" out of 100 ("), c("risk_band"), F.lit(" priority, "),
                       F.lower("confidence_band"), F.lit(" confidence)."))
    multiple = F.try_divide(c("sanction_amount"), F.nullif("peer_median_cost", F.lit(0.0)))
    cost = F.when(multiple >= 2, F.concat(F.lit("It is "), fixed(multiple, 1), F.lit(" times the median of "), rupees(c("peer_median_cost")), F.lit(" for "),
                                          c("peer_size").cast("string"), F.lit(" comparable works grouped by "), c("peer_level"), F.lit(".")))
    paid = F.when(c("is_completed") & c("total_expenditure").isNull(), F.lit("It is recorded as completed but carries no payment record at all.")).when(
        c("expenditure_ratio").isNotNull(),
        F.concat(_plain(c("expenditure_ratio") * 100), F.lit("% of the sanctioned amount has been disbursed across "), F.coalesce("payment_count", F.lit(0)).cast("string"), F.lit(" payment(s).")),
    )
    alike = F.concat(F.lit("A closely similar work, "), c("similar_work_id"), F.lit(", was sanctioned in the same district and should be checked to confirm the two were separately executed."))
    rule = F.when(c("rule_reasons") != "", F.concat(F.lit("Rule check: "), F.split("rule_reasons", "; ")[0], F.lit(".")))
    closing = F.lit("Suggested action: verify scope and supporting records before any site visit. This summary describes unusual patterns only and does not establish irregularity or fraud.")
    return df.withColumn("briefing", F.when(c("risk_band") != "Low", F.concat_ws(" ", opening, cost, paid, alike, rule, closing)).otherwise(F.lit("")))


def decomposition_gaps(df: DataFrame, names=INDICATORS, tolerance: float = 0.05) -> DataFrame:
    """Works whose points don't add up to their score (there should be none)."""
    points = [F.col(f"points_{n}") for n in names]
    return df.where(F.abs(sum(points[1:], points[0]) - F.col("risk_score")) > tolerance)


def decomposition_report(df: DataFrame, names=INDICATORS, tolerance: float = 0.05) -> DataFrame:
    """How many works were checked, how many have points at all, and how many
    don't add up."""
    points = [F.col(f"points_{n}") for n in names]
    total = sum(points[1:], points[0])
    broken = F.abs(total - F.col("risk_score")) > tolerance
    return df.agg(F.count(F.lit(1)).alias("checked"), F.count_if(total > 0).alias("with_points"), F.count_if(broken).alias("broken"))


def score(df: DataFrame, config: RiskConfig) -> DataFrame:
    """Signals to points, scores, bands and confidence. narrate() adds the words."""
    for n in INDICATORS:
        if f"signal_{n}" not in df.columns:
            df = df.withColumn(f"signal_{n}", F.lit(None).cast("double"))
    for c, kind in (("similar_work_id", "string"), ("similarity_score", "double")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    out = combine(df, config.caps)
    out = out.withColumn("risk_band", band(F.col("risk_score"), config.band_high, config.band_medium))
    return confidence(out, config.min_peer_group)


def narrate(scored: DataFrame) -> DataFrame:
    """Explanations and briefings of scored works."""
    return briefing(explain(scored))
