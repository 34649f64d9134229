"""Parameters of both engines. Every threshold is a policy choice that a user may
change; the defaults are the published ones."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# Names, caps and weights of the register engine.
INDICATORS = ("cost_deviation", "timeline", "expenditure_consistency", "similarity", "compliance", "multivariate")
LABELS = {
    "cost_deviation": "Cost deviation from peers",
    "timeline": "Timeline indicator",
    "expenditure_consistency": "Expenditure consistency",
    "similarity": "Potentially similar work",
    "compliance": "Rule-based indicator",
    "multivariate": "Unusual combination of indicators",
}
CAPS = {"cost_deviation": 0.55, "timeline": 0.30, "expenditure_consistency": 0.50, "similarity": 0.45, "compliance": 0.60, "multivariate": 0.30}
TIER_WEIGHT = {"verified": 1.00, "financial_consistency": 0.90, "configurable": 0.75, "heuristic": 0.45, "data_quality": 0.30}
PEER_LEVELS = (("work_type + state", ("work_type", "state")), ("work_type", ("work_type",)), ("category + state", ("work_category", "state")), ("state", ("state",)))
PEER_STRENGTH = {"work_type + state": 1.00, "work_type": 0.85, "category + state": 0.45, "state": 0.25, "insufficient": 0.00}

# The labelled benchmark engine.
BENCHMARK_CAPS = {"cost_deviation": 0.55, "delay": 0.45, "expenditure_mismatch": 0.60, "duplicate": 0.65, "compliance": 0.75, "multivariate": 0.40}
BENCHMARK_LABELS = {
    "cost_deviation": "Cost deviation",
    "delay": "Delay",
    "expenditure_mismatch": "Expenditure-progress mismatch",
    "duplicate": "Duplicate / similar project",
    "compliance": "Compliance rule violation",
    "multivariate": "Unusual overall pattern",
}
INADMISSIBLE = (
    "Office building for government department", "Memorial or statue", "Place of worship",
    "Purchase of land", "Asset for commercial organisation", "Grant or loan to individual",
)
EXPECTED_DAYS = {
    "CC road": 180, "Drainage": 150, "School building": 365, "Community hall": 300, "Solar street light": 90, "Drinking water": 120,
    "Toilet block": 120, "Anganwadi centre": 240, "Health sub-centre": 365, "Culvert / bridge": 300, "Playground": 180, "Library": 270,
}


def check_caps(caps: dict[str, float]) -> None:
    """Every cap must lie strictly between 0 and 1, or the combination breaks."""
    for name, value in caps.items():
        if not 0 < value < 1:
            raise ValueError(f"the cap of {name} must lie between 0 and 1, not {value}")


@dataclass(frozen=True)
class IngestConfig:
    as_of: date = date(2026, 9, 24)
    source_label: str = "portal export"
    data_mode: str = "official_export"
    quarantine_implausible: bool = True
    implausible_payment: float = 500_000_000.0
    mojibake_share: float = 0.30


@dataclass(frozen=True)
class Rule:
    """severity times the tier's weight is what a broken rule adds."""

    rule_id: str
    name: str
    tier: str
    fields: tuple[str, ...]
    severity: float
    source: str = "An analytical rule of this engine"
    explanation: str = ""

    @property
    def weight(self) -> float:
        return self.severity * TIER_WEIGHT[self.tier]


# Versions that payloads name.
ENGINE_VERSION, CONFIG_VERSION = "v2.0", "risk-v2-1"
BENCHMARK_VERSION, BENCHMARK_CONFIG_VERSION = "v1-benchmark", "v1"

# The rules, in the order of their reasons (but for their texts).
RULES = (
    Rule("FIN_001", "Total expenditure exceeds sanctioned amount", "financial_consistency", ("total_expenditure", "sanction_amount"), 0.8, explanation="More has been disbursed than was sanctioned."),
    Rule("FIN_002", "Single payment exceeds sanctioned amount", "financial_consistency", ("max_single_payment", "sanction_amount"), 0.7, explanation="A single payment is larger than the whole sanction."),
    Rule("FIN_003", "Completed work with no recorded expenditure", "data_quality", ("completion_date", "total_expenditure"), 0.45, explanation="The work is marked completed, yet no payment for it is on record."),
    Rule("DATE_001", "First payment precedes the sanction date", "financial_consistency", ("first_payment_date", "sanction_date"), 0.7, explanation="Money was paid before the work was sanctioned."),
    Rule("DATE_002", "Completion precedes sanction", "data_quality", ("completion_date", "sanction_date"), 0.6, explanation="The work was completed before it was sanctioned."),
    Rule("DATE_003", "Long delay between recommendation and sanction", "heuristic", ("days_recommendation_to_sanction",), 0.35, source="A threshold that can be configured", explanation="Recommendation and sanction lie unusually far apart."),
    Rule("CEIL_001", "Sanctioned amount above the configured single-work ceiling", "configurable", ("sanction_amount",), 0.5, source="An administrative threshold, not checked against any edition of the guidelines", explanation="The sanction is above the ceiling that is configured for one work."),
    Rule("DUP_001", "Identical description to another work in the same district", "heuristic", ("description_normalised", "district"), 0.5, explanation="Another work of the district has the very same description."),
    Rule("COMP_001", "Work falls in an inadmissible category", "configurable", ("inadmissible_category",), 1.0, source="Needs a verified list of the guidelines' categories", explanation="Works of this category are not admissible."),
    Rule("COST_002", "Sanctioned materially above the amount recommended", "financial_consistency", ("sanction_uplift_pct",), 0.55, source="The register of recommendations, against the sanction", explanation="The sanction is above the recommended amount by more than the configured margin."),
)


# The thresholds of both engines.
@dataclass(frozen=True)
class RiskConfig:
    min_peer_group: int = 8
    cost_z_full: float = 4.0
    duration_floor: float = 1.5
    duration_full: float = 4.0
    lag_floor_percentile: float = 0.90
    lag_full_percentile: float = 0.99
    underspend_floor: float = 0.15
    underspend_full: float = 0.60
    payments_percentile: float = 0.95
    payments_full: int = 20
    unpaid_signal: float = 0.35
    pending_signal: float = 0.25
    uplift_percent: float = 15.0
    similarity_floor: float = 0.62
    similarity_block: int | None = None  # the published engine leaves districts of more than 900 works uncompared
    band_high: float = 70.0
    band_medium: float = 50.0
    ceiling: float = 10_000_000.0
    trees: int = 300
    tree_sample: int = 256
    dbscan_eps: float = 1.2
    dbscan_neighbours: int = 10
    seed: int = 42
    tail: float = 0.85
    model_rows: int = 200
    caps: dict = field(default_factory=lambda: dict(CAPS))
    rules: tuple[Rule, ...] = RULES


@dataclass(frozen=True)
class BenchmarkConfig:
    """Thresholds of the labelled benchmark engine."""

    as_of: date = date(2026, 9, 1)
    min_peer_group: int = 8
    cost_z_full: float = 4.0
    delay_floor: float = 0.25
    delay_full: float = 1.25
    mismatch_floor: float = 15.0
    mismatch_full: float = 50.0
    duplicate_floor: float = 0.55
    duplicate_km: float = 12.0
    band_high: float = 70.0
    band_medium: float = 45.0
    ceiling: float = 10_000_000.0
    escalation_percent: float = 10.0
    confidence_fields: tuple[str, ...] = ("sanctioned_cost", "expenditure", "physical_progress_pct", "sanction_date", "work_description", "implementing_agency", "latitude")
    caps: dict = field(default_factory=lambda: dict(BENCHMARK_CAPS))


check_caps(CAPS)
check_caps(BENCHMARK_CAPS)
