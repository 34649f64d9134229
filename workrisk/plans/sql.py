"""The same register in DuckDB's SQL, as a chain of common table expressions."""

from __future__ import annotations

from workrisk.config import BENCHMARK_CAPS, BENCHMARK_LABELS, CAPS, EXPECTED_DAYS, INADMISSIBLE, PEER_STRENGTH, RULES, BenchmarkConfig, RiskConfig
from workrisk.plans.adapter import AS_OF, CATEGORIES, PEERS

CONFIG = RiskConfig(min_peer_group=PEERS)
SIGNALS = ("cost_deviation", "timeline", "expenditure_consistency", "similarity", "compliance")

SPINE = """
spine AS (
  SELECT o_orderkey::VARCHAR AS work_id, o_orderkey AS k, n_name AS state, CASE WHEN o_orderkey % 59 <> 0 THEN n_name || '/' || c_mktsegment END AS district, c_name AS mp_name,
    CASE WHEN o_orderkey % 53 = 0 THEN '?????? ???' ELSE 'Work on ' || lower(o_orderpriority) END || ' lot ' || (o_orderkey % 97)::VARCHAR AS work_description, o_orderpriority AS work_category,
    o_totalprice AS sanction_amount, o_orderdate::DATE AS sanction_date, o_orderdate::DATE - (o_orderkey % 300)::INT AS recommended_date, CASE WHEN o_orderkey % 37 = 0 THEN 'Work Completed' WHEN o_orderkey % 31 = 0 THEN 'Physical Inspection' WHEN o_orderkey % 29 = 0 THEN 'Vendor Identification' WHEN o_orderkey % 71 = 0 THEN 'Time Estimation'
      WHEN o_orderkey % 73 <> 0 THEN CASE o_orderstatus WHEN 'F' THEN 'Work Completed' WHEN 'P' THEN 'Work partially Completed' ELSE 'Sanction' END END AS work_status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""
PAYMENTS = """
payments AS (
  SELECT l_orderkey::VARCHAR AS work_id, CASE WHEN l_orderkey % 3 <> 0 THEN p_type END AS work_type, 'V' || l_suppkey::VARCHAR AS vendor, l_shipdate::DATE AS paid_on,
    CASE WHEN l_returnflag = 'A' THEN 'In-Progress' ELSE 'Payment Success' END AS status, l_extendedprice AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""
COMPLETED = """
completed AS (
  SELECT o_orderkey::VARCHAR AS work_id, coalesce(max(l_shipdate)::DATE, any_value(o_orderdate)::DATE + 30) AS completion_date
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY o_orderkey
)"""
RECOMMENDED = """
recommended AS (
  SELECT CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey::VARCHAR END AS work_id, n_name AS state, round(round(o_totalprice) * (75 + o_orderkey % 40) / 100.0::DOUBLE, 2) AS recommended_amount,
    o_orderdate::DATE - (o_orderkey % 300)::INT AS recommended_on, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE END AS sanction_date, o_orderkey AS source_row
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def _mode(column: str) -> str:
    return f"""(SELECT work_id, {column} FROM (
      SELECT work_id, {column}, row_number() OVER (PARTITION BY work_id ORDER BY count(*) DESC, {column}) AS n
      FROM payments WHERE {column} IS NOT NULL GROUP BY work_id, {column}) WHERE n = 1)"""


ROLLUP = f"""
rollup_ AS (
  SELECT work_id, sum(amount::DECIMAL(20,2))::DOUBLE AS total_expenditure, count(*) AS payment_count, max(amount) AS max_single_payment, min(paid_on) AS first_payment_date,
    max(paid_on) AS last_payment_date, count(DISTINCT vendor) AS distinct_vendors, count(*) FILTER (status IS DISTINCT FROM 'Payment Success') AS payments_not_successful
  FROM payments GROUP BY work_id
),
paid AS (
  SELECT r.*, t.work_type, v.vendor AS primary_vendor FROM rollup_ r LEFT JOIN {_mode("work_type")} t USING (work_id) LEFT JOIN {_mode("vendor")} v USING (work_id)
)"""
_HAVE = ("sanction_amount", "sanction_date", "recommended_date", "work_description", "state", "district", "work_status", "total_expenditure")
WORKS = f"""
works AS (
  SELECT *, round(({" + ".join(f"({c} IS NOT NULL)::INT" for c in _HAVE)}) / 8.0::DOUBLE, 3) AS data_completeness FROM (
  SELECT s.*, c.completion_date, p.* EXCLUDE (work_id), r.recommended_amount, r.recommended_on,
    (sanction_amount - recommended_amount) / nullif(recommended_amount, 0) * 100 AS sanction_uplift_pct, recommended_amount IS NOT NULL AS has_recommendation,
    total_expenditure / nullif(sanction_amount, 0) AS expenditure_ratio, total_expenditure IS NOT NULL AS has_expenditure, completion_date IS NOT NULL AS is_completed,
    sanction_date - recommended_date AS days_recommendation_to_sanction, coalesce(completion_date, DATE '{AS_OF}') - sanction_date AS days_sanction_to_reference,
    CASE WHEN completion_date IS NOT NULL THEN 'completion_date' ELSE 'as_of_date' END AS age_basis, work_type IS NOT NULL AS has_work_type,
    length(work_description) > 0 AND length(work_description) - length(replace(work_description, '?', '')) >= 0.30::DOUBLE * length(work_description) AS description_is_mojibake,
    trim(regexp_replace(regexp_replace(lower(work_description), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS description_normalised
  FROM spine s LEFT JOIN completed c USING (work_id) LEFT JOIN paid p USING (work_id)
    LEFT JOIN (SELECT work_id, recommended_amount, recommended_on FROM recommended WHERE work_id IS NOT NULL) r USING (work_id)))"""
BASE = ",".join([SPINE, PAYMENTS, COMPLETED, RECOMMENDED, ROLLUP, WORKS])

_LEVELS = (("work_type + state", ("work_type", "state")), ("work_type", ("work_type",)), ("category + state", ("work_category", "state")), ("state", ("state",)))


def _cascade() -> str:
    parts, before = ["\np0 AS (SELECT *, NULL::VARCHAR AS peer_key, 'insufficient' AS peer_level, 0::BIGINT AS peer_size FROM works)"], "p0"
    for i, (name, keys) in enumerate(_LEVELS, 1):
        usable = " AND ".join(f"{c} IS NOT NULL" for c in keys)
        counted = f"count(*) FILTER (peer_key IS NULL AND {usable}) OVER (PARTITION BY {', '.join(keys)})"
        take = f"peer_key IS NULL AND {usable} AND n_ >= {PEERS}"
        text = " || ' | ' || ".join(keys)
        parts.append(f"""
p{i} AS (SELECT * EXCLUDE (n_) REPLACE (CASE WHEN {take} THEN '{name} :: ' || {text} ELSE peer_key END AS peer_key,
    CASE WHEN {take} THEN '{name}' ELSE peer_level END AS peer_level, CASE WHEN {take} THEN n_ ELSE peer_size END AS peer_size)
  FROM (SELECT *, {counted} AS n_ FROM {before}))""")
        before = f"p{i}"
    return ",".join(parts)


FEATURES = f"""
logs AS (SELECT *, CASE WHEN sanction_amount > 0 THEN log10(sanction_amount) END AS log_amount FROM p4),
mids AS (
  SELECT peer_key, median(sanction_amount) AS peer_median_cost, median(log_amount) AS mid, stddev_samp(log_amount) AS std,
    median(CASE WHEN is_completed THEN days_sanction_to_reference END)::DOUBLE AS peer_median_duration
  FROM logs WHERE peer_key IS NOT NULL GROUP BY peer_key
),
mads AS (SELECT l.peer_key, median(abs(log_amount - mid)) AS mad FROM logs l JOIN mids m ON l.peer_key = m.peer_key GROUP BY l.peer_key),
ranked AS (
  SELECT work_id, round((rank() OVER (PARTITION BY peer_key ORDER BY sanction_amount) + (count(*) OVER (PARTITION BY peer_key, sanction_amount) - 1) / 2.0::DOUBLE)
    / count(sanction_amount) OVER (PARTITION BY peer_key) * 100, 1) AS peer_cost_percentile FROM logs WHERE peer_key IS NOT NULL AND sanction_amount IS NOT NULL
),
feats AS (
  SELECT l.*, m.peer_median_cost, m.peer_median_duration, k.peer_cost_percentile,
    coalesce((log_amount - mid) / nullif(1.4826::DOUBLE * mad, 0), (log_amount - mid) / nullif(std, 0), 0) AS cost_robust_z,
    days_sanction_to_reference / nullif(m.peer_median_duration, 0) AS duration_ratio,
    CASE WHEN is_completed AND has_expenditure THEN 1 - least(expenditure_ratio, 1) END AS underspend_gap,
    count(*) OVER (PARTITION BY district) AS district_work_count,
    CASE WHEN primary_vendor IS NOT NULL THEN count(*) OVER (PARTITION BY district, primary_vendor) END / count(*) OVER (PARTITION BY district)::DOUBLE AS vendor_district_share,
    CASE WHEN description_normalised IS NOT NULL AND NOT description_is_mojibake THEN count(*) OVER (PARTITION BY district, description_normalised) END AS identical_description_count
  FROM logs l LEFT JOIN mids m ON l.peer_key = m.peer_key LEFT JOIN mads a ON l.peer_key = a.peer_key LEFT JOIN ranked k ON l.work_id = k.work_id
)"""
_CONDITIONS = {
    "FIN_001": "total_expenditure > sanction_amount", "FIN_002": "max_single_payment > sanction_amount", "FIN_003": "is_completed AND NOT has_expenditure",
    "DATE_001": "first_payment_date < sanction_date", "DATE_002": "completion_date < sanction_date", "DATE_003": "days_recommendation_to_sanction > lag_full",
    "CEIL_001": f"sanction_amount > {CONFIG.ceiling}", "DUP_001": "identical_description_count > 1", "COST_002": f"sanction_uplift_pct > {CONFIG.uplift_percent}",
}
LIVE_RULES = [r for r in RULES if r.rule_id in _CONDITIONS]


def _ramp(x: str, low: str, high: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(0::DOUBLE, least(1::DOUBLE, (({x}) - ({low})) / (({high}) - ({low})))) END"


_PAYMENT_RAMP = f"CASE WHEN {CONFIG.payments_full} <= payments_floor THEN CASE WHEN payment_count IS NOT NULL THEN 0::DOUBLE END ELSE {_ramp('payment_count', 'payments_floor', str(CONFIG.payments_full))} END"
#: TF-IDF of n-grams over a district's different texts, and the best partner of each.
ALIKE = f"""
told AS (SELECT work_id, district, description_normalised AS t FROM works WHERE description_normalised IS NOT NULL AND NOT coalesce(description_is_mojibake, false)),
texts AS (SELECT district, t, count(*) AS n, min(work_id) AS first, min(work_id, 2)[2] AS second, row_number() OVER () AS ti FROM told WHERE district IS NOT NULL GROUP BY district, t),
sized AS (SELECT district, sum(n) AS rows, count(*) AS items FROM texts GROUP BY 1),
cut_ AS (SELECT ti, district, n, ' ' || unnest(string_split(t, ' ')) || ' ' AS w FROM texts),
grams AS (SELECT ti, district, n, w[i:i + m - 1] AS g FROM (SELECT *, unnest(range(1, length(w) - m + 2)) AS i FROM (SELECT *, unnest([3, 4, 5]) AS m FROM cut_) WHERE m <= length(w))),
tf AS (SELECT ti, district, n, g, 1 + ln(count(*)) AS f FROM grams GROUP BY ALL),
heavy AS (SELECT ti, district, g, f * (ln((1 + rows) / (1 + sum(n) OVER (PARTITION BY district, g))::DOUBLE) + 1) AS x FROM tf JOIN sized USING (district)),
unit AS (SELECT ti, district, g, x / sqrt(sum(x * x) OVER (PARTITION BY ti)) AS x FROM heavy),
met AS (SELECT a.ti AS a, b.ti AS b, round(sum(a.x * b.x), 9) AS s FROM unit a JOIN unit b ON a.district = b.district AND a.g = b.g AND a.ti <> b.ti GROUP BY ALL),
top AS (SELECT a, s, first AS other FROM met JOIN texts ON b = ti QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, first) = 1),
likened AS (
  SELECT work_id AS like_id, CASE WHEN n > 1 THEN 1::DOUBLE WHEN items > 1 THEN coalesce(s, 0) END AS alike,
    CASE WHEN n = 1 THEN other WHEN s >= 1 THEN least(CASE WHEN work_id = first THEN second ELSE first END, other) WHEN work_id = first THEN second ELSE first END AS twin
  FROM told JOIN texts USING (district, t) JOIN sized USING (district) LEFT JOIN top ON a = ti
)"""
DETECTED = f"""{ALIKE},
cuts AS (
  SELECT quantile_cont(days_recommendation_to_sanction, {CONFIG.lag_floor_percentile}) AS lag_floor, quantile_cont(days_recommendation_to_sanction, {CONFIG.lag_full_percentile}) AS lag_full,
    quantile_cont(CASE WHEN has_expenditure THEN payment_count END, {CONFIG.payments_percentile}) AS payments_floor FROM feats
),
detected AS (
  SELECT *, CASE WHEN peer_key IS NOT NULL AND sanction_amount IS NOT NULL THEN least(1::DOUBLE, greatest(cost_robust_z, 0) / {CONFIG.cost_z_full}) END AS signal_cost_deviation,
    greatest({_ramp("duration_ratio", str(CONFIG.duration_floor), str(CONFIG.duration_full))}, {_ramp("days_recommendation_to_sanction", "lag_floor", "greatest(lag_full, lag_floor + 1)")}) AS signal_timeline,
    CASE WHEN has_expenditure OR is_completed THEN greatest(coalesce({_ramp("underspend_gap", str(CONFIG.underspend_floor), str(CONFIG.underspend_full))}, 0),
      CASE WHEN is_completed AND NOT has_expenditure THEN {CONFIG.unpaid_signal}::DOUBLE END, {_PAYMENT_RAMP},
      CASE WHEN payments_not_successful > 0 THEN {CONFIG.pending_signal}::DOUBLE END) END AS signal_expenditure_consistency,
    CASE WHEN description_normalised IS NOT NULL AND NOT coalesce(description_is_mojibake, false) THEN coalesce({_ramp("alike", str(CONFIG.similarity_floor), "1.0")}, 0) END AS signal_similarity,
    round(alike, 3) AS similarity_score, CASE WHEN alike >= {CONFIG.similarity_floor} THEN twin END AS similar_work_id,
    least(1::DOUBLE, {" + ".join(f"CASE WHEN {_CONDITIONS[r.rule_id]} THEN {r.weight!r}::DOUBLE ELSE 0 END" for r in LIVE_RULES)}) AS signal_compliance,
    concat_ws('; ', {", ".join(f"CASE WHEN {_CONDITIONS[r.rule_id]} THEN '[{r.rule_id}] {r.name}' END" for r in LIVE_RULES)}) AS rule_reasons
  FROM feats LEFT JOIN likened ON like_id = work_id, cuts
)"""
_E = {n: f"(-ln(1 - {CAPS[n]}::DOUBLE * least(coalesce(signal_{n}, 0), 0.999::DOUBLE)))" for n in SIGNALS}
SCORED = f"""
summed AS (SELECT *, {" + ".join(_E.values())} AS total_ FROM detected),
pointed AS (
  SELECT *, {", ".join(f"CASE WHEN total_ > 0 THEN round({_E[n]} / total_ * 100 * (1 - exp(-total_)), 2) + 0.0::DOUBLE ELSE 0 END AS points_{n}" for n in SIGNALS)} FROM summed
),
rated AS (
  SELECT *, round({" + ".join(f"points_{n}" for n in SIGNALS)}, 2) AS risk_score,
    {" + ".join(f"(signal_{n} IS NOT NULL)::INT" for n in SIGNALS)} AS detectors_evaluated,
    round(0.7 * CASE peer_level {" ".join(f"WHEN '{k}' THEN {v}" for k, v in PEER_STRENGTH.items())} ELSE 0 END::DOUBLE + 0.3 * least(peer_size / {4.0 * PEERS}::DOUBLE, 1), 3) AS peer_strength
  FROM pointed
),
trusted AS (
  SELECT *, CASE WHEN risk_score >= {CONFIG.band_high} THEN 'High' WHEN risk_score >= {CONFIG.band_medium} THEN 'Medium' ELSE 'Low' END AS risk_band,
    round(0.30::DOUBLE * data_completeness + 0.15::DOUBLE * (detectors_evaluated / 6.0::DOUBLE) + 0.55::DOUBLE * peer_strength, 3) AS confidence FROM rated
),
scored AS (SELECT *, CASE WHEN confidence <= 0.55 THEN 'Low' WHEN confidence <= 0.78 THEN 'Medium' ELSE 'High' END AS confidence_band FROM trusted)"""


def with_works(query: str) -> str:
    return f"WITH {BASE} {query}"


def with_features(query: str, more: str = "") -> str:
    return f"WITH {BASE},{_cascade()},{FEATURES}{',' + more if more else ''} {query}"


def with_signals(query: str) -> str:
    return f"WITH {BASE},{_cascade()},{FEATURES},{DETECTED} {query}"


def with_scores(query: str, more: str = "") -> str:
    return f"WITH {BASE},{_cascade()},{FEATURES},{DETECTED},{SCORED}{',' + more if more else ''} {query}"


# ------------------------------------------------------------ the benchmark

_B = BenchmarkConfig()


def _kind_list() -> str:
    return ", ".join("NULL" if c is None else f"'{c}'" for c in CATEGORIES)


PROJECTS = f"""
lines AS (SELECT l_orderkey, max(l_shipdate)::DATE AS last, sum(l_extendedprice::DECIMAL(20,2))::DOUBLE AS spent FROM lineitem GROUP BY 1),
projects AS (
  SELECT *, CASE WHEN k % 4 <> 0 THEN CASE WHEN k % 9 = 0 THEN round(sanctioned_cost * 1.2::DOUBLE, 0) ELSE sanctioned_cost END END AS revised_cost FROM (
  SELECT o_orderkey AS k, 'P' || o_orderkey AS project_id, n_name AS state, CASE WHEN o_orderkey % 59 <> 0 THEN n_name || '/' || c_mktsegment END AS district, [{_kind_list()}][o_orderkey % {len(CATEGORIES)} + 1] AS work_category,
    CASE WHEN o_orderkey % 43 <> 0 THEN 'Agency ' || (o_orderkey % 3) END AS implementing_agency, CASE WHEN o_orderkey % 79 <> 0 THEN o_orderdate::DATE END AS sanction_date,
    CASE WHEN o_orderkey % 5 <> 0 THEN last END AS actual_completion_date, round(o_totalprice * 30, 0) AS sanctioned_cost, CASE WHEN o_orderkey % 8 <> 0 THEN spent * 30 END AS expenditure,
    CASE WHEN o_orderkey % 23 <> 0 THEN (o_orderkey % 101)::DOUBLE END AS physical_progress_pct, CASE WHEN o_orderkey % 2 = 0 THEN 'Completed' WHEN o_orderkey % 3 = 0 THEN 'In progress' END AS status,
    CASE WHEN o_orderkey % 41 <> 0 THEN 1 END AS latitude, o_orderstatus = 'F' AS risk_label, 'Construction of lot ' || (o_orderkey % 211) || ' for ' || lower(o_orderpriority) AS work_description
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN lines ON l_orderkey = o_orderkey)
)"""
_MIDDLE = sorted(EXPECTED_DAYS.values())
_MIDDLE = (_MIDDLE[(len(_MIDDLE) - 1) // 2] + _MIDDLE[len(_MIDDLE) // 2]) / 2
_DAYS = " ".join(f"WHEN '{c}' THEN {float(d)}" for c, d in EXPECTED_DAYS.items())
V1_FEATURES = f"""
v1_cost AS (SELECT *, coalesce(revised_cost, sanctioned_cost) AS effective_cost, coalesce(work_category, 'nan') || ' | ' || state AS peer_group FROM projects),
v1_mid AS (SELECT peer_group, median(effective_cost) AS peer_median_cost, stddev_samp(effective_cost) AS std, count(*) AS peer_size FROM v1_cost GROUP BY 1),
v1_mad AS (SELECT peer_group, median(abs(effective_cost - peer_median_cost)) AS mad FROM v1_cost JOIN v1_mid USING (peer_group) GROUP BY 1),
v1_rank AS (SELECT project_id, (rank() OVER (PARTITION BY peer_group ORDER BY effective_cost) + (count(*) OVER (PARTITION BY peer_group, effective_cost) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY peer_group) AS r
  FROM v1_cost WHERE effective_cost IS NOT NULL),
v1_agency AS (
  SELECT district, implementing_agency, count(*) AS own_works, sum(effective_cost::DECIMAL(20,2))::DOUBLE AS own_cost FROM v1_cost WHERE district IS NOT NULL GROUP BY ALL),
v1_district AS (SELECT district, count(*) AS works, sum(effective_cost::DECIMAL(20,2))::DOUBLE AS cost FROM v1_cost WHERE district IS NOT NULL GROUP BY ALL),
v1_timed AS (
  SELECT c.*, peer_median_cost, peer_size, round(coalesce(r, 0.5::DOUBLE) * 100, 1) AS peer_cost_percentile,
    coalesce((effective_cost - peer_median_cost) / nullif(1.4826::DOUBLE * mad, 0), (effective_cost - peer_median_cost) / nullif(std, 0), 0) * CASE WHEN peer_size < {_B.min_peer_group} THEN 0.4::DOUBLE ELSE 1 END AS cost_robust_z,
    coalesce(actual_completion_date, DATE '{_B.as_of}') - sanction_date AS elapsed_days, CASE work_category {_DAYS} ELSE {_MIDDLE} END::DOUBLE AS expected_duration_days,
    expenditure / nullif(effective_cost, 0) * 100 AS expenditure_ratio_pct, coalesce((revised_cost - sanctioned_cost) / nullif(sanctioned_cost, 0) * 100, 0) AS cost_escalation_pct,
    ({" + ".join(f"(c.{f} IS NOT NULL)::INT" for f in _B.confidence_fields)}) / {len(_B.confidence_fields)}::DOUBLE AS data_completeness,
    own_works / works::DOUBLE AS agency_work_share, own_cost / nullif(cost, 0) AS agency_value_share
  FROM v1_cost c JOIN v1_mid USING (peer_group) JOIN v1_mad USING (peer_group) LEFT JOIN v1_rank USING (project_id)
    LEFT JOIN v1_district d ON c.district = d.district LEFT JOIN v1_agency a ON c.district = a.district AND c.implementing_agency IS NOT DISTINCT FROM a.implementing_agency),
v1_features AS (
  SELECT *, expenditure_ratio_pct - physical_progress_pct AS progress_gap_pct, overrun_days / expected_duration_days AS raw_delay, coalesce(overrun_days / expected_duration_days, 0) AS delay_ratio
  FROM (SELECT *, CASE WHEN elapsed_days IS NOT NULL THEN greatest(elapsed_days - expected_duration_days, 0) END AS overrun_days FROM v1_timed))"""


def _rise(x: str, floor: float, full: float) -> str:
    return f"greatest(0::DOUBLE, least(1::DOUBLE, coalesce({x} - {floor}::DOUBLE, 0) / {full - floor}::DOUBLE))"


_RULES = [
    ("Work category is inadmissible under the scheme''s guidelines", f"work_category IN ({', '.join(repr(c) for c in INADMISSIBLE)})", 1.0),
    (f"Sanctioned cost exceeds the single-work ceiling of Rs {_B.ceiling:,.0f}", f"effective_cost > {_B.ceiling}", 0.8),
    (f"Cost revised upward by more than {_B.escalation_percent:.0f}% without re-sanction", f"cost_escalation_pct > {_B.escalation_percent}", 0.5),
    ("Expenditure booked exceeds the sanctioned amount", "expenditure_ratio_pct > 100.5", 0.7),
    ("Reported as fully progressed but not closed as completed", "physical_progress_pct >= 99.5 AND status IS DISTINCT FROM 'Completed'", 0.3),
    ("Implementing agency holds an unusually large share of the district''s works", "agency_work_share > 0.45", 0.3),
]
V1_SIGNALS = f"""
v1_signals AS (SELECT *, least(1::DOUBLE, greatest(cost_robust_z, 0) / {_B.cost_z_full}::DOUBLE) AS signal_cost_deviation, {_rise("delay_ratio", _B.delay_floor, _B.delay_full)} AS signal_delay,
  {_rise("progress_gap_pct", _B.mismatch_floor, _B.mismatch_full)} AS signal_expenditure_mismatch, least(1::DOUBLE, {" + ".join(f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0 END" for _, c, w in _RULES)}) AS signal_compliance,
  concat_ws('; ', {", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c, _ in _RULES)}) AS compliance_reasons FROM v1_features)"""
V1_LIVE = ("cost_deviation", "delay", "expenditure_mismatch", "compliance")
_V = {n: f"(-ln(1 - {BENCHMARK_CAPS[n]}::DOUBLE * least(signal_{n}, 0.999::DOUBLE)))" for n in V1_LIVE}
_PLACES = list(BENCHMARK_LABELS)
V1_SCORED = f"""
v1_summed AS (SELECT *, {" + ".join(_V.values())} AS total_ FROM v1_signals),
v1_pointed AS (SELECT *, {", ".join(f"CASE WHEN total_ > 0 THEN round({_V[n]} / total_ * 100 * (1 - exp(-total_)), 2) + 0.0::DOUBLE ELSE 0 END AS points_{n}" for n in V1_LIVE)}, round(100 * (1 - exp(-total_)), 1) AS risk_score,
  round(0.7::DOUBLE * data_completeness + 0.3::DOUBLE * least(peer_size / {float(_B.min_peer_group)}::DOUBLE, 1), 3) AS confidence FROM v1_summed),
v1_banded AS (SELECT *, CASE WHEN risk_score >= {_B.band_high} THEN 'High' WHEN risk_score >= {_B.band_medium} THEN 'Medium' ELSE 'Low' END AS risk_band FROM v1_pointed),
v1_first AS (SELECT project_id, arg_max(label, (points, -place)) AS first FROM ({" UNION ALL ".join(f"SELECT project_id, points_{n} AS points, {_PLACES.index(n)} AS place, '{BENCHMARK_LABELS[n]}' AS label FROM v1_banded" for n in V1_LIVE)}) WHERE points >= 3 GROUP BY 1),
v1_scored AS (SELECT b.*, coalesce(first, 'No material risk indicator') AS primary_reason, CASE WHEN risk_band = 'High' THEN 'Pending review' ELSE 'Not queued' END AS review_status FROM v1_banded b LEFT JOIN v1_first USING (project_id))"""


def with_projects(query: str) -> str:
    return f"WITH {PROJECTS},{V1_FEATURES},{V1_SIGNALS},{V1_SCORED} {query}"
