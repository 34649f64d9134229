"""Registered queries of the screening engine and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workrisk.config import INDICATORS
from workrisk.functions import numeric, text
from workrisk.operators import benchmark, build, datagen, detectors, evaluation, multivariate, peers, reviews, rollups, scoring, search, similarity
from workrisk.operators import validation as v
from workrisk.plans import adapter, register, sql
from workrisk.plans.storage import stored
from workrisk.sources import sinks
from workrisk.streaming import alerts

CONFIG = sql.CONFIG
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def whole(f):
    """Register a query over scored works again, as <name>_full: SQL can follow
    five of the detectors, this one has all six."""
    QUERIES[f"{f.__name__}_full"] = lambda spark, sf_dir: f(spark, sf_dir, register.scored)
    return f


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue by all six detectors."""
    return priority_queue(spark, sf_dir, register.scored)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


_t = adapter.table
_works = register.shared_works


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.shared_features(spark, sf_dir)


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.detect(_features(spark, sf_dir), CONFIG)


def _days_as_text(df: DataFrame) -> DataFrame:
    """Dates as text, which all engines' clients compare alike."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"}) if any(k == "date" for _, k in df.dtypes) else df


_plain = register.plain_scored


def _names(scored) -> tuple[str, ...]:
    """The detectors that ``scored`` runs."""
    return sql.SIGNALS if scored is _plain else INDICATORS

# ---------------------------------------------------------------- parsing


_SPACE_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(8195)"


@query(rf"""WITH raw AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN '₹ ' || o_totalprice::DECIMAL(20,2)::VARCHAR WHEN 1 THEN '(' || o_orderkey::VARCHAR || ')' WHEN 2 THEN 'n/a' WHEN 3 THEN '1,25,' || (100 + o_orderkey % 900)::VARCHAR WHEN 4 THEN '' WHEN 5 THEN '1-2'
  WHEN 6 THEN chr(9) || '(' || o_orderkey::VARCHAR || ')' || chr(10) WHEN 7 THEN chr(160) || '₹' || chr(8195) || o_orderkey::VARCHAR || chr(13) || chr(10) ELSE ' 500000 ' END AS s FROM orders),
d AS (SELECT o_orderkey, trim(s, {_SPACE_SQL}) AS s, regexp_replace(s, '[^0-9.\-]', '', 'g') AS x FROM raw)
SELECT o_orderkey, CASE WHEN regexp_matches(s, '^\(.*\)$') THEN -try_cast(x AS DOUBLE) ELSE try_cast(CASE WHEN x IN ('', '-', '.') THEN NULL ELSE x END AS DOUBLE) END AS amount FROM d""")
def parse_amount(spark, sf_dir):
    k = F.col("o_orderkey")
    shown = k.cast("string")
    raw = (
        F.when(k % 9 == 0, F.concat(F.lit("₹ "), F.col("o_totalprice").cast("decimal(20,2)").cast("string"))).when(k % 9 == 1, F.concat(F.lit("("), shown, F.lit(")"))).when(k % 9 == 2, "n/a")
        .when(k % 9 == 3, F.concat(F.lit("1,25,"), (100 + k % 900).cast("string"))).when(k % 9 == 4, "").when(k % 9 == 5, "1-2").when(k % 9 == 6, F.concat(F.lit("\t("), shown, F.lit(")\n")))
        .when(k % 9 == 7, F.concat(F.lit("\u00a0₹\u2003"), shown, F.lit("\r\n"))).otherwise(" 500000 ")
    )
    return _t(spark, sf_dir, "orders").select("o_orderkey", text.parse_amount(raw).alias("amount"))


#: What an export may make of one date; the last one can't be read.
_DATE_SHAPES = ("dd-MMM-yyyy", "d/M/yyyy", "yyyy-MM-dd", "'\t'dd-MMM-yyyy'\n'", "d MMMM yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "d-MMM-yy", "MMMM d, yyyy", "yyyy-MM-dd HH:mm:ss", "EEEE, d MMM yyyy", "ddMMMyyyy", "'\u00a0'd-M-yy", "'rubbish'")


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % {len(_DATE_SHAPES)} <> {len(_DATE_SHAPES) - 1} THEN o_orderdate::DATE::VARCHAR END AS day FROM orders""")
def parse_date(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    raw = F.coalesce(*[F.when(k % len(_DATE_SHAPES) == n, F.date_format(d, shape)) for n, shape in enumerate(_DATE_SHAPES)])
    return _t(spark, sf_dir, "orders").select("o_orderkey", text.parse_date(raw).cast("string").alias("day"))


_TITLE = "'WS/MP' || c_custkey || '/2023-2024/' || (c_custkey * 7) || '- Construction of ' || c_mktsegment || ' road'"


def _titles(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    title = F.concat(F.lit("WS/MP"), k, F.lit("/2023-2024/"), (F.col("c_custkey") * 7).cast("string"), F.lit("- Construction of "), F.col("c_mktsegment"), F.lit(" road"))
    return _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 5 != 0, title).otherwise(F.lit("no id here")).alias("title"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN 'WS/MP' || c_custkey || '/2023-2024/' || (c_custkey * 7) END AS work_id FROM customer")
def extract_work_id(spark, sf_dir):
    return _titles(spark, sf_dir).select("c_custkey", text.work_id(F.col("title")).alias("work_id"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN 'Construction of ' || c_mktsegment || ' road' ELSE 'no id here' END AS bare FROM customer")
def strip_work_id(spark, sf_dir):
    return _titles(spark, sf_dir).select("c_custkey", text.without_work_id(F.col("title")).alias("bare"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE list_aggregate(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') END AS district FROM nation""")
def extract_district(spark, sf_dir):
    raw = F.when(F.col("n_nationkey") % 6 == 0, F.lit("nowhere")).otherwise(F.concat(F.upper("n_name"), F.lit("(DISTRICT MAGISTRATE)")))
    return _t(spark, sf_dir, "nation").select("n_nationkey", text.district(raw).alias("district"))


@query("SELECT c_custkey, c_name AS name FROM customer")
def clean_member_name(spark, sf_dir):
    raw = F.concat(F.lit(" "), F.col("c_name"), F.lit(" (2022-28)  (2022-2028) (NaN-NaN)"))
    return _t(spark, sf_dir, "customer").select("c_custkey", text.member_name(raw).alias("name"))


@query(rf"""SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_{text.SPACES}]', ' ', 'g'), '[{text.SPACES}]+', ' ', 'g')), '') AS plain FROM documents""")
def normalise_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.normalise(F.col("text")).alias("plain"))


@query("""SELECT doc_id, length(t) > 0 AND (length(t) - length(replace(t, '?', ''))) >= 0.30 * length(t) AS lost FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN translate(text, 'aeiou', '?????') ELSE text END AS t FROM documents)""")
def mojibake_flag(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "aeiou", "?????")).otherwise(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", text.is_mojibake(raw).alias("lost"))


@query("""SELECT n_nationkey, round(2 * 6371.0 * asin(sqrt(least(1, greatest(0, pow(sin(radians(n_regionkey - n_nationkey) / 2), 2) + cos(radians(n_nationkey)) * cos(radians(n_regionkey)) * pow(sin(radians(3 * n_regionkey - n_nationkey) / 2), 2))))), 4) AS km FROM nation""")
def haversine(spark, sf_dir):
    a, b = F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")
    return _t(spark, sf_dir, "nation").select("n_nationkey", F.round(numeric.haversine_km(a, a, b, b * 3), 4).alias("km"))


_MONEY = lambda c: f"CASE WHEN {c} IS NULL THEN 'an unrecorded amount' WHEN {c} >= 1e7 THEN 'Rs ' || printf('%.2f', {c} / 1e7::DOUBLE) || ' crore' WHEN {c} >= 1e5 THEN 'Rs ' || printf('%.2f', {c} / 1e5::DOUBLE) || ' lakh' ELSE 'Rs ' || format('{{:,}}', round_even({c}, 0)::BIGINT) END"


@query(f"""WITH d AS (SELECT *, o_totalprice * 50 + 0.13::DOUBLE AS c, round_even(o_totalprice * 50 + 0.13::DOUBLE, 0)::BIGINT::VARCHAR AS w, o_orderkey % 100 AS t FROM orders)
SELECT o_orderkey, {_MONEY('c')} AS words, CASE WHEN length(w) <= 3 THEN w ELSE reverse(rtrim(regexp_replace(reverse(w[:-4]), '(\\d\\d)', '\\1,', 'g'), ',')) || ',' || w[-3:] END AS grouped,
  CASE WHEN c >= 1e7 THEN '₹' || printf('%.1f', c / 1e7::DOUBLE) || 'Cr' WHEN c >= 1e5 THEN '₹' || printf('%.1f', c / 1e5::DOUBLE) || 'L' WHEN c >= 1e3 THEN '₹' || printf('%.1f', c / 1e3::DOUBLE) || 'K' ELSE '₹' || printf('%.0f', c) END AS compact,
  printf('%.1f', c / 1e6::DOUBLE) || '%' AS share, o_orderkey || CASE WHEN t BETWEEN 11 AND 13 THEN 'th' WHEN t % 10 = 1 THEN 'st' WHEN t % 10 = 2 THEN 'nd' WHEN t % 10 = 3 THEN 'rd' ELSE 'th' END AS place,
  strftime(o_orderdate::DATE, '%d %b %Y') AS day, CASE WHEN length(o_orderpriority) > 5 THEN o_orderpriority[:5] || '…' ELSE o_orderpriority END AS short FROM d""")
def display_formats(spark, sf_dir):
    c = F.col("o_totalprice") * 50 + 0.13
    return _t(spark, sf_dir, "orders").select(
        "o_orderkey", text.rupees(c).alias("words"), text.indian_grouping(c).alias("grouped"), text.compact_rupees(c).alias("compact"), text.percent(c / 1e6).alias("share"),
        text.ordinal(F.col("o_orderkey")).alias("place"), text.shown_date(F.col("o_orderdate").cast("date")).alias("day"), text.shortened(F.col("o_orderpriority"), 5).alias("short"),
    )


# ------------------------------------------------------- validation, reports


def _raw_payments(spark, sf_dir):
    k = F.col("l_orderkey")
    return _t(spark, sf_dir, "lineitem").select(
        F.when((k % 50 == 0) & (F.col("l_linenumber") == 1), "Grand Total").when(k % 51 == 0, " TOTAL ").when(k % 53 == 0, "\tGrand total\n").when(k % 54 == 0, "\u00a0Subtotal\r\n").otherwise(k.cast("string")).alias("row_key"), F.when(k % 13 != 0, k.cast("string")).alias("work_id"),
        F.when(k % 17 == 0, None).when(k % 19 == 0, F.lit(-5.0)).when(k % 23 == 0, F.lit(6e8)).otherwise(F.col("l_extendedprice")).alias("amount"), "l_linenumber",
    )


_RAW = f"""raw AS (SELECT CASE WHEN l_orderkey % 50 = 0 AND l_linenumber = 1 THEN 'Grand Total' WHEN l_orderkey % 51 = 0 THEN ' TOTAL ' WHEN l_orderkey % 53 = 0 THEN chr(9) || 'Grand total' || chr(10) WHEN l_orderkey % 54 = 0 THEN chr(160) || 'Subtotal' || chr(13) || chr(10) ELSE l_orderkey::VARCHAR END AS row_key,
  CASE WHEN l_orderkey % 13 <> 0 THEN l_orderkey::VARCHAR END AS work_id, CASE WHEN l_orderkey % 17 = 0 THEN NULL WHEN l_orderkey % 19 = 0 THEN -5.0 WHEN l_orderkey % 23 = 0 THEN 6e8 ELSE l_extendedprice END AS amount FROM lineitem),
tagged AS (SELECT *, CASE WHEN lower(trim(row_key, {_SPACE_SQL})) IN ('grand total', 'total', 'subtotal', 'summary', 'overall total') THEN 'Summary or total row' WHEN work_id IS NULL THEN 'No work ID present'
  WHEN amount > 5e8 THEN 'Payment exceeds the plausibility ceiling of Rs 500,000,000' WHEN amount <= 0 THEN 'Payment amount is zero or negative' END AS reject_reason FROM raw)"""


@query(f"WITH {_RAW} SELECT reject_reason, count(*) AS rows, sum(amount::DECIMAL(20,2))::DOUBLE AS amount FROM tagged GROUP BY reject_reason")
def validate_payments_tagged(spark, sf_dir):
    raw = _raw_payments(spark, sf_dir)
    return v.tag(raw, v.payment_checks(raw)).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("amount").cast("decimal(20,2)")).cast("double").alias("amount"))


@query(f"WITH {_RAW} SELECT count(*) FILTER (reject_reason = 'Summary or total row') AS summaries, count(*) AS rows FROM tagged")
def summary_rows(spark, sf_dir):
    return _raw_payments(spark, sf_dir).agg(F.count_if(v.is_summary(F.col("row_key"))).alias("summaries"), F.count(F.lit(1)).alias("rows"))


def _raw_spine(spark, sf_dir):
    """Works with totals that leaked into the key and the status."""
    k = F.col("work_id").cast("long")
    own = adapter.spine(spark, sf_dir)
    status = F.when(k % 101 == 0, "17629503056.99").when(k % 103 == 0, "Sanctioned").otherwise(F.col("work_status"))
    return own.select(F.when(k % 40 == 0, "Subtotal").otherwise("1").alias("row_key"), F.when(k % 11 != 0, F.col("work_id")).alias("work_id"), status.alias("work_status"))


@query(f"""WITH {sql.SPINE} SELECT CASE WHEN k % 40 = 0 THEN 'Summary or total row' WHEN k % 101 = 0 OR k % 103 = 0 THEN 'Work Status holds a value that is not a status' WHEN k % 11 = 0 THEN 'No work ID could be extracted' END AS reject_reason, count(*) AS rows FROM spine GROUP BY 1""")
def validate_spine_tagged(spark, sf_dir):
    raw = _raw_spine(spark, sf_dir)
    return v.tag(raw, v.spine_checks(raw)).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {sql.SPINE} SELECT work_status, count(*) AS rows FROM spine WHERE NOT (k % 40 = 0 OR k % 101 = 0 OR k % 103 = 0 OR k % 11 = 0) GROUP BY 1")
def statuses_kept(spark, sf_dir):
    """Every real status survives validation."""
    raw = _raw_spine(spark, sf_dir)
    return v.split(v.tag(raw, v.spine_checks(raw)))[0].groupBy("work_status").agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {sql.BASE} SELECT CASE WHEN work_id::BIGINT % 40 = 0 THEN 'Summary or total row' WHEN work_id::BIGINT % 11 = 0 THEN 'No work ID could be extracted' END AS reject_reason, count(*) AS rows FROM completed GROUP BY 1")
def validate_completed_tagged(spark, sf_dir):
    k = F.col("work_id").cast("long")
    raw = adapter.completed(spark, sf_dir).select(F.when(k % 40 == 0, "grand total of all").otherwise("1").alias("row_key"), F.when(k % 11 != 0, F.col("work_id")).alias("work_id"))
    return v.tag(raw, v.completion_checks(raw)).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("rows"))


@query(f"""WITH {_RAW} SELECT 'payments' AS source, reject_reason AS reason, count(*) AS rows FROM tagged WHERE reject_reason IS NOT NULL GROUP BY 2
UNION ALL SELECT 'allocation', 'Summary or total row', count(*) FROM customer WHERE c_custkey % 9 = 0 HAVING count(*) > 0""")
def quarantine_summary(spark, sf_dir):
    q = v.Quarantine()
    raw = _raw_payments(spark, sf_dir)
    q.add(v.split(v.tag(raw, v.payment_checks(raw)))[1], "payments")
    limits = _t(spark, sf_dir, "customer").select(F.lit("1").alias("row_key"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("state"), "c_name")
    q.add(v.split(v.tag(limits, v.allocation_checks(limits)))[1], "allocation")
    return q.summary()


@query("UNION ALL ".join(f"SELECT 'customer' AS dataset, '{c}' AS \"column\", count({e}) AS non_null, count(*) - count({e}) AS missing, round(count({e}) * 100.0::DOUBLE / greatest(count(*), 1), 1) AS completeness_pct, count(DISTINCT {e}) AS distinct_values FROM customer "
                         for c, e in (("c_custkey", "c_custkey"), ("c_name", "c_name"), ("segment", "nullif(c_mktsegment, 'BUILDING')"))))
def column_profile(spark, sf_dir):
    own = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.lit(1).alias("source_row"))
    return v.column_profile(own, "customer")


def _sources(spark, sf_dir):
    return adapter.spine(spark, sf_dir).where("CAST(work_id AS BIGINT) % 10 <> 0"), adapter.completed(spark, sf_dir), adapter.payments(spark, sf_dir)


_IDS = f"""WITH {sql.BASE}, s AS (SELECT DISTINCT work_id FROM spine WHERE k % 10 <> 0), c AS (SELECT DISTINCT work_id FROM completed), p AS (SELECT DISTINCT work_id FROM payments)"""


@query(f"""{_IDS}, s2 AS (SELECT CASE WHEN k % 77 <> 0 THEN work_id END AS work_id FROM spine WHERE k % 10 <> 0 UNION ALL SELECT work_id FROM spine WHERE k % 97 = 1 AND k % 10 <> 0 AND k % 77 <> 0),
 d AS (SELECT DISTINCT work_id FROM s2 WHERE work_id IS NOT NULL), n AS (SELECT (SELECT count(*) FROM s2) AS sanctioned_records, (SELECT count(*) FROM completed) AS completed_records, (SELECT count(*) FROM payments) AS expenditure_payment_records,
  (SELECT count(*) FROM d) AS sanctioned_distinct_ids, (SELECT count(*) FROM c) AS completed_distinct_ids, (SELECT count(*) FROM p) AS expenditure_distinct_works,
  (SELECT count(*) FROM c SEMI JOIN d USING (work_id)) AS completed_matched_to_sanctioned, (SELECT count(*) FROM c ANTI JOIN d USING (work_id)) AS completed_unmatched,
  (SELECT count(*) FROM p SEMI JOIN d USING (work_id)) AS expenditure_matched_to_sanctioned, (SELECT count(*) FROM p ANTI JOIN d USING (work_id)) AS expenditure_unmatched,
  (SELECT count(*) FROM p SEMI JOIN c USING (work_id)) AS works_with_both_completion_and_payments, (SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM s2 GROUP BY work_id)) AS duplicate_ids_in_sanctioned,
  (SELECT count(*) - count(DISTINCT work_id) FROM completed) AS duplicate_ids_in_completed)
SELECT *, round(completed_matched_to_sanctioned * 100.0::DOUBLE / greatest(completed_distinct_ids, 1), 2) AS match_rate_completed_pct, round(expenditure_matched_to_sanctioned * 100.0::DOUBLE / greatest(expenditure_distinct_works, 1), 2) AS match_rate_expenditure_pct FROM n""")
def matching_report(spark, sf_dir):
    """Some works without an id, some twice."""
    s, c, p = _sources(spark, sf_dir)
    k = F.col("work_id").cast("long")
    s = s.select(F.when(k % 77 != 0, F.col("work_id")).alias("work_id")).union(s.where((k % 97 == 1) & (k % 77 != 0)).select("work_id"))
    return v.matching_report(s, c, p)


@query(f"{_IDS} SELECT work_id FROM c INTERSECT SELECT work_id FROM s")
def ids_intersect(spark, sf_dir):
    s, c, _ = _sources(spark, sf_dir)
    return c.select("work_id").intersect(s.select("work_id"))


@query(f"{_IDS} SELECT work_id FROM c EXCEPT SELECT work_id FROM s")
def ids_except(spark, sf_dir):
    s, c, _ = _sources(spark, sf_dir)
    return c.select("work_id").subtract(s.select("work_id"))


@query(f"{_IDS} SELECT work_id, completion_date::VARCHAR AS completion_date FROM completed ANTI JOIN s USING (work_id)")
def unmatched_anti(spark, sf_dir):
    s, c, _ = _sources(spark, sf_dir)
    return _days_as_text(c.join(s, "work_id", "left_anti"))


@query(sql.with_works(f"""SELECT count(*) FILTER (sanction_date < recommended_date) AS sanction_before_recommendation, count(*) FILTER (completion_date < sanction_date) AS completion_before_sanction,
  count(*) FILTER (first_payment_date < sanction_date) AS first_payment_before_sanction, count(*) FILTER (sanction_date > DATE '{adapter.AS_OF}') AS sanction_date_in_future, count(*) FILTER (completion_date > DATE '{adapter.AS_OF}') AS completion_date_in_future,
  count(*) FILTER (sanction_date IS NULL) AS missing_sanction_date, count(*) FILTER (work_status = 'Work Completed' AND completion_date IS NULL) AS completed_status_without_completion_date,
  count(*) FILTER (completion_date IS NOT NULL AND work_status IS DISTINCT FROM 'Work Completed') AS completion_date_without_completed_status FROM works"""))
def date_consistency(spark, sf_dir):
    return v.date_consistency(_works(spark, sf_dir), adapter.AS_OF)


@query(sql.with_works("""SELECT count(*) FILTER (sanction_amount IS NULL) AS missing_sanction_amount, count(*) FILTER (sanction_amount <= 0) AS zero_or_negative_sanction, count(total_expenditure) AS works_with_expenditure,
  count(*) FILTER (total_expenditure > sanction_amount) AS expenditure_exceeds_sanction, count(*) FILTER (completion_date IS NOT NULL AND total_expenditure IS NULL) AS completed_without_any_payment,
  count(*) FILTER (max_single_payment > sanction_amount) AS single_payment_exceeds_sanction, round(median(total_expenditure / nullif(sanction_amount, 0)), 3) AS median_expenditure_ratio FROM works"""))
def amount_consistency(spark, sf_dir):
    return v.amount_consistency(_works(spark, sf_dir))


@query(sql.with_works("""SELECT count(*) AS works_total, count(completion_date) AS works_completed, count(total_expenditure) AS works_with_expenditure, count(work_type) AS works_with_work_type, count(DISTINCT state) AS states,
  count(DISTINCT district) AS districts, count(DISTINCT mp_name) AS mps, count(*) FILTER (work_description LIKE '?????? %') AS mojibake_descriptions FROM works"""))
def coverage(spark, sf_dir):
    return v.coverage(_works(spark, sf_dir))


@query(sql.with_works("""SELECT (SELECT count(*) FROM recommended WHERE work_id IS NOT NULL OR sanction_date IS NULL) AS recommended_records, (SELECT count(recommended_amount) FROM works) AS matched_to_sanctioned,
  count(*) AS recommended_not_sanctioned, coalesce(sum(recommended_amount::DECIMAL(20,2))::DOUBLE, 0) AS pipeline_value FROM recommended WHERE work_id IS NULL AND sanction_date IS NULL"""))
def recommendation_report(spark, sf_dir):
    matched, open_ = build.recommendations(adapter.recommended(spark, sf_dir))
    return v.recommendation_report(_works(spark, sf_dir), matched, open_)


# --------------------------------------------------------------- building


@query(f"WITH {sql.BASE} SELECT * REPLACE (first_payment_date::VARCHAR AS first_payment_date, last_payment_date::VARCHAR AS last_payment_date) FROM rollup_")
def payment_rollup(spark, sf_dir):
    return _days_as_text(build.payment_rollup(adapter.payments(spark, sf_dir)).drop("work_type", "primary_vendor"))


@query(f"WITH {sql.BASE} SELECT work_id, work_type, primary_vendor FROM paid")
def payment_mode(spark, sf_dir):
    return build.payment_rollup(adapter.payments(spark, sf_dir)).select("work_id", "work_type", "primary_vendor")


_UNIFIED = ["work_id", "state", "district", "work_category", "sanction_amount", "sanction_date", "recommended_date", "completion_date", "total_expenditure", "payment_count", "max_single_payment", "first_payment_date", "last_payment_date",
            "distinct_vendors", "work_type", "primary_vendor", "payments_not_successful", "recommended_amount", "has_recommendation", "has_expenditure", "is_completed", "days_recommendation_to_sanction", "days_sanction_to_reference",
            "age_basis", "description_normalised", "data_completeness"]


@query(sql.with_works(f"SELECT {', '.join(c + '::VARCHAR AS ' + c if c.endswith('_date') else c for c in _UNIFIED)}, round(sanction_uplift_pct, 6) AS sanction_uplift_pct, round(expenditure_ratio, 6) AS expenditure_ratio FROM works"))
def unified_works(spark, sf_dir):
    return _days_as_text(_works(spark, sf_dir).select(*_UNIFIED, F.round("sanction_uplift_pct", 6).alias("sanction_uplift_pct"), F.round("expenditure_ratio", 6).alias("expenditure_ratio")))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem) WHERE n = 1")
def dedup_keep_first(spark, sf_dir):
    return build.keep_first(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")


def _open(spark, sf_dir):
    return build.recommendations(adapter.recommended(spark, sf_dir))[1]


_OPEN = f"WITH {sql.BASE}, open_ AS (SELECT * FROM recommended WHERE work_id IS NULL AND sanction_date IS NULL)"


@query(f"{_OPEN}, g AS (SELECT state, count(*) AS works, sum(recommended_amount::DECIMAL(20,2))::DOUBLE AS value FROM open_ GROUP BY state) SELECT * FROM g")
def recommendation_pipeline_state(spark, sf_dir):
    return rollups.pipeline_by_state(_open(spark, sf_dir))


@query(f"{_OPEN} SELECT count(*) > 0 AS available, count(*) AS works, sum(recommended_amount::DECIMAL(20,2))::DOUBLE AS value, count(*) + (SELECT count(*) FROM works) AS recommended_in_total, round(count(*) / (count(*) + (SELECT count(*) FROM works))::DOUBLE * 100, 1) AS share_pct FROM open_")
def recommendation_pipeline_totals(spark, sf_dir):
    return rollups.pipeline_totals(_open(spark, sf_dir), _works(spark, sf_dir))


@query(f"{_OPEN} SELECT state, recommended_amount, recommended_on::VARCHAR AS recommended_on, source_row FROM open_ ORDER BY open_.recommended_on NULLS LAST, source_row LIMIT 200")
def recommendation_oldest(spark, sf_dir):
    return _days_as_text(rollups.oldest_recommendations(_open(spark, sf_dir), ["source_row"]).select("state", "recommended_amount", "recommended_on", "source_row"))


# ------------------------------------------------------ peers and features


@query(sql.with_features("SELECT work_id, peer_key, peer_level, peer_size FROM p4"))
def peer_cascade(spark, sf_dir):
    return peers.assign_peers(_works(spark, sf_dir), CONFIG.min_peer_group).select("work_id", "peer_key", "peer_level", "peer_size")


_FEATS = ("peer_median_cost", "peer_median_duration", "cost_robust_z", "duration_ratio", "underspend_gap", "vendor_district_share")


@query(sql.with_features(f"SELECT work_id, peer_cost_percentile, district_work_count, identical_description_count, {', '.join(f'round({c}, 6) AS {c}' for c in _FEATS)} FROM feats"))
def peer_features(spark, sf_dir):
    return _features(spark, sf_dir).select("work_id", "peer_cost_percentile", "district_work_count", "identical_description_count", *[F.round(c, 6).alias(c) for c in _FEATS])


@query("""WITH m AS (SELECT c_mktsegment AS g, median(c_acctbal) AS mid, stddev_samp(c_acctbal) AS std FROM customer GROUP BY 1), d AS (SELECT g, median(abs(c_acctbal - mid)) AS mad FROM customer JOIN m ON c_mktsegment = g GROUP BY g)
SELECT c_custkey, round(coalesce((c_acctbal - mid) / nullif(1.4826::DOUBLE * mad, 0), (c_acctbal - mid) / nullif(std, 0), 0), 6) AS z FROM customer JOIN m ON c_mktsegment = m.g JOIN d ON m.g = d.g""")
def robust_z(spark, sf_dir):
    return peers.robust_z(_t(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", "z").select("c_custkey", F.round("z", 6).alias("z"))


_PCT = "(rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE) / count(*) OVER ()"


@query(f"SELECT o_orderkey, round({_PCT}, 9) AS pct FROM (SELECT o_orderkey, round(o_totalprice / 10000) AS v FROM orders)")
def global_pct_rank(spark, sf_dir):
    own = _t(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 10000).alias("v"))
    return peers.percent_rank(own, "v", "pct").select("o_orderkey", F.round("pct", 9).alias("pct"))


# --------------------------------------------------------------- detectors


@query(sql.with_signals("SELECT work_id, round(signal_cost_deviation, 6) AS signal FROM detected"))
def d_cost(spark, sf_dir):
    return _signals(spark, sf_dir).select("work_id", F.round("signal_cost_deviation", 6).alias("signal"))


@query(sql.with_signals("SELECT work_id, round(signal_timeline, 6) AS signal FROM detected"))
def d_timeline(spark, sf_dir):
    return _signals(spark, sf_dir).select("work_id", F.round("signal_timeline", 6).alias("signal"))


@query(sql.with_signals("SELECT work_id, round(signal_expenditure_consistency, 6) AS signal FROM detected"))
def d_expenditure(spark, sf_dir):
    return _signals(spark, sf_dir).select("work_id", F.round("signal_expenditure_consistency", 6).alias("signal"))


@query(sql.with_signals("SELECT work_id, round(signal_compliance, 6) AS signal, rule_reasons FROM detected"))
def d_compliance(spark, sf_dir):
    return _signals(spark, sf_dir).select("work_id", F.round("signal_compliance", 6).alias("signal"), "rule_reasons")


@query(sql.with_signals(" UNION ALL ".join(f"SELECT '{r.rule_id}' AS rule_id, 'evaluated' AS status, count(*) FILTER ({sql._CONDITIONS[r.rule_id]}) AS flagged FROM detected" if r.rule_id in sql._CONDITIONS else f"SELECT '{r.rule_id}', 'not_evaluated', 0" for r in CONFIG.rules)))
def rule_report(spark, sf_dir):
    return detectors.rule_report(_signals(spark, sf_dir), CONFIG)


@whole
@query(sql.with_signals(" UNION ALL ".join(f"SELECT '{n}' AS detector, count(signal_{n}) AS evaluated, count(*) FILTER (signal_{n} > 0) AS flagged, CASE WHEN count(signal_{n}) > 0 THEN 'evaluated' ELSE 'skipped' END AS status FROM detected" for n in sql.SIGNALS)))
def detector_report(spark, sf_dir, scored=_plain):
    return detectors.detector_report(scored(spark, sf_dir), _names(scored))


_GRAMS = r"""used AS (SELECT doc_id, lang || '/' || source AS block, nullif(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), '') AS t FROM documents),
sized AS (SELECT *, count(*) OVER (PARTITION BY block) AS rows FROM used WHERE t IS NOT NULL AND block IS NOT NULL),
words AS (SELECT doc_id, block, rows, ' ' || unnest(string_split(t, ' ')) || ' ' AS w FROM sized WHERE rows >= 2),
counted AS (SELECT doc_id, block, rows, w, count(*) AS c FROM words GROUP BY ALL),
grams AS (SELECT doc_id, block, rows, c, w[i:i + n - 1] AS g FROM (SELECT *, unnest(range(1, length(w) - n + 2)) AS i FROM (SELECT *, unnest([3, 4, 5]) AS n FROM counted) WHERE n <= length(w))),
tf AS (SELECT block, doc_id, rows, g, 1 + ln(sum(c)) AS f FROM grams GROUP BY ALL),
raw AS (SELECT block, doc_id, g, f * (ln((1 + rows) / (1 + count(*) OVER (PARTITION BY block, g))::DOUBLE) + 1) AS x FROM tf),
unit AS (SELECT block, doc_id, g, x / sqrt(sum(x * x) OVER (PARTITION BY block, doc_id)) AS x FROM raw),
met AS (SELECT a.block, a.doc_id AS a, b.doc_id AS b, round(sum(a.x * b.x), 9) AS s FROM unit a JOIN unit b ON a.block = b.block AND a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM met) WHERE n = 1)
SELECT doc_id AS work_id, round(CASE WHEN doc_id IN (SELECT doc_id FROM sized WHERE rows >= 2) THEN coalesce(s, 0) END, 3) AS similarity_score, CASE WHEN s >= 0.62 THEN b END AS similar_work_id,
  round(CASE WHEN t IS NOT NULL THEN greatest(0, least(1, (coalesce(s, 0) - 0.62) / (1 - 0.62::DOUBLE))) END, 6) AS signal FROM used LEFT JOIN top ON doc_id = a"""


def _described(spark, sf_dir):
    """Documents as works; stored, since their texts are read several times and cost
    much to normalise."""
    return stored(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("work_id"), F.concat("lang", F.lit("/"), "source").alias("district"), text.normalise(F.col("text")).alias("description_normalised")))


@query(f"WITH {_GRAMS}")
def d_similarity(spark, sf_dir):
    """Whole texts, blocks of any size."""
    found = similarity.similarity(_described(spark, sf_dir))
    return found.select("work_id", "similarity_score", "similar_work_id", F.round("signal_similarity", 6).alias("signal"))


@query("""WITH q AS (SELECT quantile_cont(c_acctbal, 0.5) AS m, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS r FROM customer) SELECT c_custkey, round((c_acctbal - m) / CASE WHEN r = 0 THEN 1 ELSE r END, 6) AS scaled FROM customer, q""")
def robust_scale(spark, sf_dir):
    return multivariate.robust_scale(_t(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("scaled")), ["scaled"]).select("c_custkey", F.round("scaled", 6).alias("scaled"))


@query("""WITH p AS (SELECT s_suppkey, s_acctbal / 1000 AS x, s_nationkey::DOUBLE AS y FROM supplier), n AS (SELECT a.s_suppkey, b.s_suppkey AS o FROM p a JOIN p b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 1.44),
d AS (SELECT s_suppkey FROM n GROUP BY 1 HAVING count(*) >= 5) SELECT s_suppkey, NOT EXISTS (SELECT 1 FROM n JOIN d ON n.o = d.s_suppkey WHERE n.s_suppkey = p.s_suppkey) AS is_noise FROM p""")
def dbscan_noise(spark, sf_dir):
    own = _t(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return multivariate.dbscan_noise(own, ["x", "y"], 1.2, 5).select("s_suppkey", "is_noise")


_MODEL = multivariate.FEATURES
_MATRIX = f"""filled AS (SELECT work_id, {", ".join(f"coalesce({c}, median({c}) OVER (), 0)::DOUBLE AS {c}" for c in _MODEL)} FROM feats),
q AS (SELECT {", ".join(f"quantile_cont({c}, 0.25) AS a{k}, quantile_cont({c}, 0.5) AS m{k}, quantile_cont({c}, 0.75) AS b{k}" for k, c in enumerate(_MODEL))} FROM filled),
scaled AS (SELECT work_id, {", ".join(f"({c} - m{k}) / CASE WHEN b{k} - a{k} = 0 THEN 1 ELSE b{k} - a{k} END AS {c}" for k, c in enumerate(_MODEL))} FROM filled, q)"""


def _scaled(spark, sf_dir):
    own = _features(spark, sf_dir).select("work_id", *_MODEL)
    return multivariate.robust_scale(multivariate.feature_matrix(own), list(_MODEL))


@query(sql.with_features(f"SELECT work_id, {', '.join(f'round({c}, 6) AS {c}' for c in _MODEL)} FROM scaled", _MATRIX))
def model_inputs(spark, sf_dir):
    """What the models see of every work: nulls filled, robustly scaled."""
    return _scaled(spark, sf_dir).select("work_id", *[F.round(c, 6).alias(c) for c in _MODEL])


@query(sql.with_features(f"""SELECT work_id, NOT EXISTS (SELECT 1 FROM near JOIN dense ON near.b = dense.a WHERE near.a = scaled.work_id) AS is_noise FROM scaled""",
                         f"""{_MATRIX}, points AS MATERIALIZED (SELECT * FROM scaled), near AS MATERIALIZED (SELECT p.work_id AS a, o.work_id AS b FROM points p JOIN points o ON {" + ".join(f"pow(p.{c} - o.{c}, 2)" for c in _MODEL)} <= {CONFIG.dbscan_eps * CONFIG.dbscan_eps!r}::DOUBLE),
dense AS (SELECT a FROM near GROUP BY a HAVING count(*) >= {CONFIG.dbscan_neighbours})"""))  # fmt: skip
def register_noise(spark, sf_dir):
    """Density noise of the whole register in all nine features."""
    return multivariate.dbscan_noise(_scaled(spark, sf_dir), list(_MODEL), CONFIG.dbscan_eps, CONFIG.dbscan_neighbours, keep=["work_id"])


@query()
def d_multivariate(spark, sf_dir):
    """The forest draws at random, so SQL can't follow; its inputs and the noise
    have SQL of their own."""
    return multivariate.multivariate(_features(spark, sf_dir), CONFIG).select("work_id", "signal_multivariate")


# ----------------------------------------------------------------- scoring


@whole
@query(sql.with_scores(f"SELECT work_id, {', '.join(f'points_{n}' for n in sql.SIGNALS)}, risk_score, risk_band FROM scored"))
def noisy_or_points(spark, sf_dir, scored=_plain):
    return scored(spark, sf_dir).select("work_id", *[f"points_{n}" for n in _names(scored)], "risk_score", "risk_band")


@whole
@query(sql.with_scores("SELECT work_id, detectors_evaluated, peer_strength, confidence, confidence_band FROM scored"))
def confidence(spark, sf_dir, scored=_plain):
    return scored(spark, sf_dir).select("work_id", "detectors_evaluated", "peer_strength", "confidence", "confidence_band")


_LABELLED = " UNION ALL ".join(f"SELECT work_id, risk_score, {k} AS place, '{scoring.LABELS[n]}' AS indicator, points_{n} AS points FROM scored" for k, n in enumerate(INDICATORS) if n in sql.SIGNALS)
_REASONED = f"parts AS ({_LABELLED}), firsts AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY points DESC, place) AS n FROM parts WHERE points >= 3)"


@whole
@query(sql.with_scores("SELECT work_id, n, indicator, round(points, 1) AS points, round(100 * points / greatest(risk_score, 1e-9), 1) AS share_pct FROM firsts WHERE n <= 3", _REASONED))
def explanations(spark, sf_dir, scored=_plain):
    return scored(spark, sf_dir).select("work_id", F.posexplode("explanation").alias("k", "e")).select("work_id", (F.col("k") + 1).alias("n"), "e.indicator", "e.points", "e.share_pct")


@whole
@query(sql.with_scores("SELECT coalesce(indicator, 'No material indicator') AS primary_reason, count(*) AS works FROM scored LEFT JOIN (SELECT work_id, indicator FROM firsts WHERE n = 1) USING (work_id) WHERE risk_band <> 'Low' GROUP BY 1", _REASONED))
def primary_reason_counts(spark, sf_dir, scored=_plain):
    return rollups.reason_counts(scored(spark, sf_dir))


_MARGIN = f"round_even(sanction_amount, 0)::BIGINT"
_WORDED = f"""worded AS (SELECT work_id, 'This ' || {_MONEY("sanction_amount")} || ' sanction' || coalesce(' in ' || nullif(concat_ws(', ', district, state), ''), '') || ' carries an analytical risk indicator of ' || round_even(risk_score, 0)::BIGINT || ' out of 100 (' || risk_band
  || ' priority, ' || lower(confidence_band) || ' confidence).' AS opening,
  CASE WHEN sanction_amount / nullif(peer_median_cost, 0) >= 2 THEN 'It is ' || printf('%.1f', sanction_amount / peer_median_cost) || ' times the median of ' || {_MONEY("peer_median_cost")} || ' for ' || peer_size || ' comparable works grouped by ' || peer_level || '.' END AS cost,
  CASE WHEN is_completed AND total_expenditure IS NULL THEN 'It is recorded as completed but carries no payment record at all.' WHEN expenditure_ratio IS NOT NULL
    THEN round_even(expenditure_ratio * 100, 0)::BIGINT || '% of the sanctioned amount has been disbursed across ' || coalesce(payment_count, 0) || ' payment(s).' END AS paid,
  'A closely similar work, ' || similar_work_id || ', was sanctioned in the same district and should be checked to confirm the two were separately executed.' AS twin_,
  CASE WHEN rule_reasons <> '' THEN 'Rule check: ' || string_split(rule_reasons, '; ')[1] || '.' END AS rule FROM scored WHERE risk_band <> 'Low')"""


@whole
@query(sql.with_scores("SELECT work_id, concat_ws(' ', opening, cost, paid, twin_, rule, 'Suggested action: verify scope and supporting records before any site visit. This summary describes unusual patterns only and does not establish irregularity or fraud.') AS briefing FROM worded", _WORDED))
def briefings(spark, sf_dir, scored=_plain):
    return scored(spark, sf_dir).where("risk_band <> 'Low'").select("work_id", "briefing")


_SENTENCES = {
    "cost_deviation": f"'Sanctioned at Rs ' || format('{{:,}}', {_MARGIN}) || ' against a peer median of Rs ' || format('{{:,}}', round_even(peer_median_cost, 0)::BIGINT) || ' (' || round_even(peer_cost_percentile, 0)::BIGINT || 'th percentile among ' || peer_size || ' comparable works, grouped by ' || peer_level || ')'",
    "timeline": "CASE WHEN peer_median_duration > 0 THEN days_sanction_to_reference || ' days since sanction against a peer median of ' || trunc(peer_median_duration)::INT || ' days (' || age_basis || ')' ELSE coalesce(days_recommendation_to_sanction || ' days between recommendation and sanction', 'Timeline indicator') END",
    "expenditure_consistency": "CASE WHEN is_completed AND NOT has_expenditure THEN 'Recorded as completed but carries no payment record' ELSE coalesce(round_even(expenditure_ratio * 100, 0)::BIGINT || '% of the sanctioned amount disbursed across ' || payment_count || ' payment(s)', 'Expenditure consistency indicator') END",
    "similarity": "coalesce('Description closely resembles ' || similar_work_id || ' in the same district (similarity ' || printf('%.2f', round_even(similarity_score, 2)) || ') — requires verification, not a confirmed duplicate', 'Description resembles another nearby work')",
    "compliance": "coalesce(nullif(rule_reasons, ''), 'Rule-based indicator')",
}
_DETAILS = " UNION ALL ".join(f"SELECT work_id, '{scoring.LABELS[n]}' AS indicator, {_SENTENCES[n]} AS detail FROM scored WHERE points_{n} >= 3" for n in sql.SIGNALS)


@whole
@query(sql.with_scores("SELECT work_id, indicator, detail FROM firsts JOIN details USING (work_id, indicator) WHERE n <= 3", f"{_REASONED}, details AS ({_DETAILS})"))
def explanation_details(spark, sf_dir, scored=_plain):
    return scored(spark, sf_dir).select("work_id", F.explode("explanation").alias("e")).select("work_id", "e.indicator", "e.detail")


@whole
@query(sql.with_scores("""SELECT work_id, CASE WHEN lvl >= 0.85 THEN 'Compared against works of the same type' WHEN lvl >= 0.45 THEN 'Only a broad category peer group was available' ELSE 'No adequate peer group — cost comparison not attempted' END AS confidence_reason
  FROM (SELECT work_id, CASE peer_level WHEN 'work_type + state' THEN 1.0 WHEN 'work_type' THEN 0.85 WHEN 'category + state' THEN 0.45 WHEN 'state' THEN 0.25 ELSE 0 END AS lvl FROM scored)"""))
def confidence_reasons(spark, sf_dir, scored=_plain):
    return scored(spark, sf_dir).select("work_id", "confidence_reason")


@query()
def register_full(spark, sf_dir):
    """Every detector, similarity and the unusual ones included."""
    out = register.scored(spark, sf_dir)
    return out.select("work_id", *[f"points_{n}" for n in INDICATORS], "risk_score", "risk_band", "confidence", "similar_work_id", "similarity_score", "primary_reason")


@whole
@query(sql.with_scores(f"SELECT count(*) AS checked, count(*) FILTER (risk_score > 0) AS with_points, count(*) FILTER (abs({' + '.join(f'points_{n}' for n in sql.SIGNALS)} - risk_score) > 0.05) AS broken FROM scored"))
def decomposition_check(spark, sf_dir, scored=_plain):
    return scoring.decomposition_report(scored(spark, sf_dir), _names(scored))


# ---------------------------------------------------------------- roll-ups

def _half_up(c: str, digits: int, to: int) -> str:
    total, n, step = f"sum(round({c} * {10**digits})::BIGINT)::BIGINT", f"count({c})", 10 ** (digits - to)
    return f"((2 * {total} + {step} * {n}) // (2 * {step} * {n})) / {10.0**to}::DOUBLE"


_M = f"""count(*) AS works, sum(sanction_amount::DECIMAL(20,2))::DOUBLE AS sanctioned, coalesce(sum(total_expenditure::DECIMAL(20,2))::DOUBLE, 0) AS expenditure, count(*) FILTER (is_completed) AS completed,
  count(*) FILTER (risk_band = 'High') AS high_risk, count(*) FILTER (risk_band <> 'Low') AS flagged, {_half_up('risk_score', 2, 1)} AS mean_risk, {_half_up('confidence', 3, 3)} AS mean_confidence"""
_R = "round(expenditure / nullif(sanctioned, 0) * 100, 1) AS utilisation_pct, round(completed / works::DOUBLE * 100, 1) AS completion_pct, round(high_risk / works::DOUBLE * 100, 1) AS high_risk_pct"


def _rollup_sql(keys: str, having: str = "") -> str:
    return sql.with_scores(f"SELECT *, {_R} FROM (SELECT {keys}, {_M} FROM scored GROUP BY {keys}) {having}")


@whole
@query(_rollup_sql("state"))
def rollup_state(spark, sf_dir, scored=_plain):
    return rollups.rollup(scored(spark, sf_dir), ["state"])


@whole
@query(_rollup_sql("state, district"))
def rollup_district(spark, sf_dir, scored=_plain):
    return rollups.rollup(scored(spark, sf_dir), ["state", "district"])


@whole
@query(_rollup_sql("mp_name, state"))
def rollup_member(spark, sf_dir, scored=_plain):
    return rollups.rollup(scored(spark, sf_dir), ["mp_name", "state"])


@whole
@query(_rollup_sql("primary_vendor, district", "WHERE works >= 5 AND primary_vendor IS NOT NULL"))
def rollup_vendor(spark, sf_dir, scored=_plain):
    return rollups.rollup(scored(spark, sf_dir).where("primary_vendor IS NOT NULL"), ["primary_vendor", "district"], 5)


@whole
@query(sql.with_scores(f"""SELECT * EXCLUDE (g), CASE g WHEN 1 THEN 'state' WHEN 2 THEN 'district' WHEN 3 THEN 'member' ELSE 'vendor' END AS level, {_R} FROM (
  SELECT state, NULL AS district, NULL AS mp_name, NULL AS primary_vendor, 1 AS g, {_M} FROM scored GROUP BY state UNION ALL SELECT state, district, NULL, NULL, 2, {_M} FROM scored GROUP BY state, district
  UNION ALL SELECT state, NULL, mp_name, NULL, 3, {_M} FROM scored GROUP BY mp_name, state UNION ALL SELECT NULL, district, NULL, primary_vendor, 4, {_M} FROM scored WHERE primary_vendor IS NOT NULL GROUP BY primary_vendor, district HAVING count(*) >= 5)"""))
def rollup_grouping_sets(spark, sf_dir, scored=_plain):
    return rollups.all_rollups(scored(spark, sf_dir))


@whole
@query(sql.with_scores("""SELECT *, round(expenditure / nullif(sanctioned, 0) * 100, 1) AS utilisation_pct, round(completed / works::DOUBLE * 100, 1) AS completion_pct FROM (SELECT count(*) AS works, count(DISTINCT state) AS states, count(DISTINCT district) AS districts,
  count(DISTINCT mp_name) AS mps, sum(sanction_amount::DECIMAL(20,2))::DOUBLE AS sanctioned, coalesce(sum(total_expenditure::DECIMAL(20,2))::DOUBLE, 0) AS expenditure, count(*) FILTER (is_completed) AS completed,
  count(*) FILTER (risk_band = 'High') AS high_risk, count(*) FILTER (risk_band <> 'Low') AS flagged FROM scored)"""))
def national_summary(spark, sf_dir, scored=_plain):
    return rollups.national(scored(spark, sf_dir))


@whole
@query(sql.with_scores(f"""SELECT count(*) AS works_total, count(*) FILTER (risk_band <> 'Low') AS works_requiring_review, count(*) FILTER (risk_band = 'High') AS high_priority, count(completion_date) AS works_completed, count(total_expenditure) AS works_with_expenditure,
  sum(sanction_amount::DECIMAL(20,2))::DOUBLE AS total_sanctioned, coalesce(sum(total_expenditure::DECIMAL(20,2))::DOUBLE, 0) AS total_expenditure, {_half_up('data_completeness', 3, 3)} AS mean_data_completeness FROM scored"""))
def dashboard(spark, sf_dir, scored=_plain):
    return rollups.dashboard(scored(spark, sf_dir))


@whole
@query(sql.with_scores("SELECT *, round(works * 100 / sum(works) OVER ()::DOUBLE, 1) AS share_pct FROM (SELECT risk_band, count(*) AS works, sum(round(risk_score * 100)::BIGINT) / count(*)::DOUBLE / 100 AS mean_score, sum(round(confidence * 1000)::BIGINT) / count(*)::DOUBLE / 1000 AS mean_confidence FROM scored GROUP BY 1) ORDER BY list_position(['High', 'Medium', 'Low'], risk_band)"))
def band_summary(spark, sf_dir, scored=_plain):
    return rollups.band_summary(scored(spark, sf_dir))


@whole
@query(_rollup_sql("state, district", "WHERE state = (SELECT min(n_name) FROM nation)"))
def audience_state(spark, sf_dir, scored=_plain):
    """What a state's authority reads: its districts."""
    first = _t(spark, sf_dir, "nation").agg(F.min("n_name")).head()[0]
    return reviews.audience_view(rollups.all_rollups(scored(spark, sf_dir)), "state", first).drop("mp_name", "primary_vendor", "level")


def _series(where: str, day: str, amount: str, name: str) -> str:
    return f"SELECT strftime({day}, '%Y-%m') AS month, count(*) AS count, sum({amount}::DECIMAL(20,2))::DOUBLE AS amount, '{name}' AS series FROM works WHERE {day} IS NOT NULL AND {where} GROUP BY 1"


_MONTHS = " UNION ALL ".join([_series("true", "sanction_date", "sanction_amount", "sanctioned"), _series("is_completed", "completion_date", "sanction_amount", "completed"), _series("total_expenditure IS NOT NULL", "first_payment_date", "total_expenditure", "expenditure")])


@query(sql.with_works(_MONTHS))
def monthly_series(spark, sf_dir):
    return rollups.monthly(_works(spark, sf_dir))


@query(sql.with_works(f"SELECT *, max(count) OVER () AS peak, sum(count) OVER ()::BIGINT AS total FROM ({_MONTHS}) WHERE series = 'expenditure'"))
def trend_paid(spark, sf_dir):
    return reviews.trend(monthly_series(spark, sf_dir), "expenditure")


@whole
@query(sql.with_scores("SELECT *, round(high / works::DOUBLE * 100, 1) AS high_pct FROM (SELECT strftime(sanction_date, '%Y-%m') AS month, count(*) AS works, count(*) FILTER (risk_band = 'High') AS high, count(*) FILTER (risk_band = 'Medium') AS medium, round(avg(risk_score), 2) AS mean_risk FROM scored GROUP BY 1)"))
def risk_by_month(spark, sf_dir, scored=_plain):
    return rollups.risk_by_month(scored(spark, sf_dir))


@whole
@query(sql.with_scores("""SELECT g.*, c_mktsegment AS constituency, c_acctbal * 1000 AS allocated, round(sanctioned / nullif(c_acctbal * 1000, 0) * 100, 1) AS sanctioned_pct_of_allocation, round(expenditure / nullif(c_acctbal * 1000, 0) * 100, 1) AS spent_pct_of_allocation, c_acctbal IS NOT NULL AS allocation_matched
  FROM (SELECT *, round(expenditure / nullif(sanctioned, 0) * 100, 1) AS utilisation_pct FROM (SELECT mp_name, state, count(*) AS works, sum(sanction_amount::DECIMAL(20,2))::DOUBLE AS sanctioned, coalesce(sum(total_expenditure::DECIMAL(20,2))::DOUBLE, 0) AS expenditure,
    count(*) FILTER (is_completed) AS completed, count(*) FILTER (risk_band = 'High') AS high_risk FROM scored GROUP BY 1, 2)) g LEFT JOIN (customer JOIN nation ON c_nationkey = n_nationkey) ON mp_name = c_name AND state = n_name"""))
def fund_utilisation(spark, sf_dir, scored=_plain):
    return rollups.fund_utilisation(scored(spark, sf_dir), adapter.allocation(spark, sf_dir))[0]


@whole
@query(sql.with_scores(f"""SELECT work_id, state, district, sanction_amount, days_sanction_to_reference, peer_median_duration, DATE '{adapter.AS_OF}' - last_payment_date AS days_since_last_payment, risk_score, risk_band,
  CASE WHEN NOT has_expenditure THEN 'Open past the peer-group duration with no payment recorded at all' ELSE 'Open past the peer-group duration with no payment for over a year' END AS warning_reason
  FROM scored WHERE NOT is_completed AND days_sanction_to_reference > peer_median_duration * 1.5 AND (NOT has_expenditure OR DATE '{adapter.AS_OF}' - last_payment_date > 365) ORDER BY days_sanction_to_reference DESC, work_id LIMIT 300"""))
def early_warning(spark, sf_dir, scored=_plain):
    return rollups.early_warning(scored(spark, sf_dir), adapter.AS_OF).select("work_id", "state", "district", "sanction_amount", "days_sanction_to_reference", "peer_median_duration", "days_since_last_payment", "risk_score", "risk_band", "warning_reason")


@whole
@query(sql.with_scores(f"""SELECT count(*) AS warnings, count(*) FILTER (total_expenditure IS NULL) AS without_payment FROM (SELECT state, total_expenditure FROM scored
  WHERE NOT is_completed AND days_sanction_to_reference > peer_median_duration * 1.5 AND (NOT has_expenditure OR DATE '{adapter.AS_OF}' - last_payment_date > 365) ORDER BY days_sanction_to_reference DESC, work_id LIMIT 300) WHERE state = (SELECT min(n_name) FROM nation)"""))
def warnings_of_state(spark, sf_dir, scored=_plain):
    first = _t(spark, sf_dir, "nation").agg(F.min("n_name")).head()[0]
    return reviews.warnings_view(rollups.early_warning(scored(spark, sf_dir), adapter.AS_OF), first)[1]


# ------------------------------------------------- queue, readers, reviews

_QUEUE = ("work_id", "state", "district", "work_type", "sanction_amount", "peer_size", "risk_score", "risk_band", "confidence")


@whole
@query(sql.with_scores(f"SELECT {', '.join(_QUEUE)} FROM scored ORDER BY risk_score DESC, confidence DESC, work_id LIMIT 500"))
def priority_queue(spark, sf_dir, scored=_plain):
    return rollups.queue(scored(spark, sf_dir), 500).select(*_QUEUE)


@whole
@query(sql.with_scores("SELECT work_id, risk_score, risk_band FROM scored WHERE risk_band IN ('High', 'Medium') AND state = (SELECT min(n_name) FROM nation)"))
def queue_filter(spark, sf_dir, scored=_plain):
    first = _t(spark, sf_dir, "nation").agg(F.min("n_name")).head()[0]
    return reviews.filter_queue(scored(spark, sf_dir), ["High", "Medium"], first).select("work_id", "risk_score", "risk_band")


def _log(spark, sf_dir):
    """Events as entries; one event in 4,001 clears all before it."""
    e = _t(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 6 == 0, None).otherwise(F.element_at(F.array(*[F.lit(s) for s in reviews.STATUSES]), (F.col("event_id") % 5 + 1).cast("int")))
    return e.select(F.when(F.col("event_id") % 4001 != 0, F.col("user_id").cast("string")).alias("work_id"), status.alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


_LOG = f"""log AS (SELECT CASE WHEN event_id % 4001 <> 0 THEN user_id::VARCHAR END AS work_id, CASE WHEN event_id % 6 <> 0 THEN [{', '.join(repr(s) for s in reviews.STATUSES)}][event_id % 5 + 1] END AS status, ts AS at_, event_id AS seq FROM events),
latest AS (SELECT work_id, status, seq FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY at_ DESC, seq DESC) AS n FROM log WHERE work_id IS NOT NULL AND ((SELECT max((at_, seq)) FROM log WHERE work_id IS NULL) IS NULL OR (at_, seq) > (SELECT max((at_, seq)) FROM log WHERE work_id IS NULL))) WHERE n = 1 AND status <> 'not_reviewed')"""


@query(f"WITH {_LOG} SELECT * FROM latest")
def reviews_latest(spark, sf_dir):
    return reviews.latest_reviews(_log(spark, sf_dir)).select("work_id", "status", "seq")


@whole
@query(sql.with_scores("SELECT work_id, risk_score FROM scored ANTI JOIN latest USING (work_id)", _LOG))
def queue_hide_reviewed(spark, sf_dir, scored=_plain):
    return reviews.filter_queue(scored(spark, sf_dir), reviewed=reviews.latest_reviews(_log(spark, sf_dir))).select("work_id", "risk_score")


@whole
@query(sql.with_scores("SELECT work_id, risk_score FROM scored WHERE contains(lower(concat_ws(' ', work_id, work_description, state, district, mp_name, primary_vendor, work_category, work_type)), 'urgent lot 7')"))
def works_search(spark, sf_dir, scored=_plain):
    return reviews.search(scored(spark, sf_dir), "urgent lot 7").select("work_id", "risk_score")


#: Searches of one, two, three and more letters, and of nothing that is there.
NEEDLES = ("7", "q5", "lot", " Urgent lot 7", "4-NOT SPECIFIED", "none of it", "9%")


@query(sql.with_scores(f"SELECT needle, work_id, risk_score FROM scored, (SELECT unnest([{', '.join(repr(x) for x in NEEDLES)}]) AS needle) WHERE contains(lower(concat_ws(' ', work_id, work_description, state, district, mp_name, primary_vendor, work_category, work_type)), lower(trim(needle)))"))
def works_search_indexed(spark, sf_dir):
    """The same through the trigram index, built once for all searches."""
    index = search.SearchIndex(_plain(spark, sf_dir), ["work_id", "risk_score"])
    found = [index.find(x).select(F.lit(x).alias("needle"), "work_id", "risk_score") for x in NEEDLES]
    return reduce(DataFrame.union, found)


@query(sql.with_scores("SELECT work_id, risk_score, row_number() OVER (ORDER BY risk_score DESC, confidence DESC, work_id) AS rank FROM scored QUALIFY rank BETWEEN 5001 AND 5100"))
def queue_page_indexed(spark, sf_dir):
    """A far page through the rank index."""
    index = search.rank_index(_plain(spark, sf_dir).select("work_id", "risk_score", "confidence"), search.QUEUE_ORDER)
    return search.page(index, 50).select("work_id", "risk_score", "rank")


@whole
@query(sql.with_scores("SELECT work_id, risk_score FROM scored ORDER BY risk_score DESC, confidence DESC, work_id LIMIT 100 OFFSET 200"))
def queue_page(spark, sf_dir, scored=_plain):
    return reviews.page(rollups.queue(scored(spark, sf_dir)), 2).select("work_id", "risk_score")


@query("SELECT DISTINCT n_name AS state FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey")
def distinct_states(spark, sf_dir):
    return reviews.states(adapter.spine(spark, sf_dir))


@query("SELECT doc_id AS work_id, CASE WHEN length(text) > 90 THEN left(text, 90) || '…' ELSE text END AS short FROM documents")
def works_index_truncated(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("work_id"), text.shortened(F.col("text")).alias("short"))


@whole
@query(sql.with_scores(f"SELECT work_id, round(sum(points) FILTER (points < 3), 2) AS other_points, count(*) FILTER (points >= 3) AS material FROM parts GROUP BY 1", _REASONED))
def points_breakdown(spark, sf_dir, scored=_plain):
    out = reviews.material_points(scored(spark, sf_dir), _names(scored))
    return out.select("work_id", F.when(F.size("material") < len(_names(scored)), F.col("other_points")).alias("other_points"), F.size("material").cast("long").alias("material"))


_KEYS = ("confidence_band", "district", "primary_reason", "risk_band", "risk_score", "sanction_amount", "state", "work_category", "work_description", "work_id", "work_status", "work_type", "confidence")


@whole
@query(sql.with_scores(f"""SELECT work_id, concat_ws(',', {", ".join("'primary_reason'" if k == "primary_reason" else f"CASE WHEN nullif({k}::VARCHAR, '') IS NOT NULL THEN '{k}' END" for k in sorted(_KEYS))}) AS keys, round(sanction_amount, 4) AS sanction_amount, round(confidence, 4) AS confidence,
  CASE WHEN length(work_description) > 90 THEN work_description[:90] || '…' ELSE work_description END AS work_description FROM scored"""))
def sparse_records(spark, sf_dir, scored=_plain):
    """The index as JSON texts, read back: which keys a record has, and some values."""
    found = sinks.records(sinks.index(scored(spark, sf_dir))).withColumn("r", F.from_json("record", "sanction_amount double, confidence double, work_description string"))
    return found.select("work_id", F.array_join(F.sort_array(F.json_object_keys("record")), ",").alias("keys"), "r.sanction_amount", "r.confidence", "r.work_description")


_ODD = "CASE c_custkey % 4 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE ELSE c_acctbal / 7 END"


@query(f"SELECT c_custkey, CASE WHEN isfinite({_ODD}) THEN round({_ODD}, 4) END AS number, CASE WHEN c_custkey % 3 <> 0 THEN '2001-02-03' END AS day, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS name FROM customer")
def cleaned_values(spark, sf_dir):
    k = F.col("c_custkey")
    odd = F.when(k % 4 == 0, F.lit(float("nan"))).when(k % 4 == 1, F.lit(float("inf"))).otherwise(F.col("c_acctbal") / 7)
    own = _t(spark, sf_dir, "customer").select("c_custkey", odd.alias("number"), F.when(k % 3 != 0, F.lit("2001-02-03").cast("timestamp")).alias("day"), F.when(k % 5 != 0, F.col("c_name")).otherwise("").alias("name"))
    return sinks.cleaned(own)


_PAIRED = _GRAMS.rpartition("SELECT doc_id AS work_id")[0]


@query(f"""WITH {_PAIRED}, s AS (SELECT doc_id, b, round(s, 3) AS similarity_score FROM used JOIN top ON doc_id = a WHERE s >= 0.62),
p AS (SELECT least(doc_id, b)::VARCHAR || '||' || greatest(doc_id, b)::VARCHAR AS pair_key, doc_id, similarity_score FROM s)
SELECT pair_key, similarity_score FROM (SELECT *, row_number() OVER (PARTITION BY pair_key ORDER BY similarity_score DESC, doc_id) AS n FROM p) WHERE n = 1 ORDER BY similarity_score DESC, pair_key LIMIT 200""")
def similar_pairs(spark, sf_dir):
    found = similarity.similarity(_described(spark, sf_dir)).withColumn("risk_score", F.lit(0.0))
    return similarity.top_pairs(found).select("pair_key", "similarity_score")


@query(f"""WITH {_PAIRED}, s AS (SELECT doc_id, b FROM used JOIN top ON doc_id = a WHERE s >= 0.62)
SELECT doc_id AS work_id, b AS similar_work_id, lang AS similar_description, n_chars::DOUBLE AS similar_amount FROM s JOIN (SELECT doc_id AS b, lang, n_chars FROM documents) USING (b)""")
def pairs_with_works(spark, sf_dir):
    """Each pair with its partner's own fields."""
    found = similarity.similarity(_described(spark, sf_dir)).where("similar_work_id IS NOT NULL").select("work_id", "similar_work_id")
    works = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("work_id"), F.col("lang").alias("work_description"), F.col("n_chars").cast("double").alias("sanction_amount"))
    return reviews.pairs_with_works(found, works).select("work_id", "similar_work_id", "similar_description", "similar_amount")


# --------------------------------------------------- evaluation, benchmark

_LAB = "SELECT l.doc_id, quality AS y, d.n_chars::DOUBLE AS s, lang FROM labels l JOIN documents d USING (doc_id)"


def _labelled(spark, sf_dir):
    return _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("s"), "lang")


@query(f"WITH l AS ({_LAB}), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM l) SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y)))::DOUBLE, 6) AS roc_auc FROM r")
def roc_auc(spark, sf_dir):
    return evaluation.roc_auc(_labelled(spark, sf_dir), "s", "y")


@query(f"WITH l AS ({_LAB}), g AS (SELECT s, sum(y) AS own, count(*) AS n FROM l GROUP BY s), c AS (SELECT own, sum(own) OVER w AS hits, sum(n) OVER w AS seen, sum(own) OVER () AS total FROM g WINDOW w AS (ORDER BY s DESC)) SELECT round(sum(hits / seen::DOUBLE * own / total::DOUBLE), 6) AS average_precision FROM c")
def average_precision(spark, sf_dir):
    return evaluation.average_precision(_labelled(spark, sf_dir), "s", "y")


@query(f"""WITH l AS ({_LAB}), n AS (SELECT *, row_number() OVER (ORDER BY s DESC, doc_id) AS n FROM l), b AS (SELECT sum(y)::BIGINT AS total, count(*) AS rows FROM l), k AS (SELECT DISTINCT least(unnest([25, 50, 100, 100000000]), rows) AS k, total, rows FROM b)
SELECT k, sum(y)::BIGINT AS caught, any_value(total) AS of_total, round(sum(y) / k::DOUBLE, 3) AS precision_at_k, round(sum(y) / any_value(total)::DOUBLE, 3) AS recall_at_k, round(sum(y) / k::DOUBLE / (any_value(total) / any_value(rows)::DOUBLE), 2) AS lift FROM n JOIN k ON n <= k GROUP BY k""")
def precision_at_k(spark, sf_dir):
    """k is never more than there are rows."""
    return evaluation.at_k(_labelled(spark, sf_dir), "s", "y", "doc_id", (25, 50, 100, 100_000_000))


@query(f"WITH l AS ({_LAB}), n AS (SELECT *, row_number() OVER (ORDER BY s DESC, doc_id) AS n FROM l) SELECT lang, count(*) AS planted, round(avg((n <= 100)::INT::DOUBLE), 6) AS recall, round(avg(s), 4) AS mean_score FROM n WHERE y = 1 GROUP BY lang")
def recall_by_kind(spark, sf_dir):
    return evaluation.recall_by_kind(_labelled(spark, sf_dir), "s", "y", "lang", "doc_id")


@query()
def benchmark_run(spark, sf_dir):
    """The labelled benchmark end to end, with its measures."""
    return evaluation.evaluate(benchmark.run(datagen.generate(spark)), "risk_score", "is_anomaly", "project_id")


_projects = adapter.projects
_V1 = ("peer_median_cost", "cost_robust_z", "delay_ratio", "expenditure_ratio_pct", "progress_gap_pct", "cost_escalation_pct", "agency_work_share", "agency_value_share", "data_completeness")


def _v1_signals(spark, sf_dir):
    return benchmark.signals(stored(benchmark.features(stored(_projects(spark, sf_dir)))))


def _v1_scored(spark, sf_dir):
    """With the four detectors that SQL can follow."""
    none = {"signal_duplicate": F.lit(0.0), "signal_multivariate": F.lit(0.0), "duplicate_match_id": F.lit("")}
    return benchmark.score(_v1_signals(spark, sf_dir).withColumns(none))


@query(sql.with_projects(f"SELECT project_id, peer_size, peer_cost_percentile, elapsed_days, expected_duration_days, overrun_days, {', '.join(f'round({c}, 6) AS {c}' for c in _V1)} FROM v1_features"))
def v1_features(spark, sf_dir):
    own = benchmark.features(stored(_projects(spark, sf_dir)))
    return own.select("project_id", "peer_size", "peer_cost_percentile", "elapsed_days", "expected_duration_days", "overrun_days", *[F.round(c, 6).alias(c) for c in _V1])


@query(sql.with_projects(f"SELECT project_id, {', '.join(f'round(signal_{n}, 6) AS signal_{n}' for n in sql.V1_LIVE)}, compliance_reasons FROM v1_signals"))
def v1_signals(spark, sf_dir):
    return _v1_signals(spark, sf_dir).select("project_id", *[F.round(f"signal_{n}", 6).alias(f"signal_{n}") for n in sql.V1_LIVE], "compliance_reasons")


@query(sql.with_projects(f"SELECT project_id, {', '.join(f'points_{n}' for n in sql.V1_LIVE)}, risk_score, risk_band, confidence, primary_reason, review_status FROM v1_scored"))
def v1_scores(spark, sf_dir):
    return _v1_scored(spark, sf_dir).select("project_id", *[f"points_{n}" for n in sql.V1_LIVE], "risk_score", "risk_band", "confidence", "primary_reason", "review_status")


@query(sql.with_projects("SELECT project_id, state, effective_cost, risk_score, risk_band, confidence, review_status FROM v1_scored ORDER BY risk_score DESC, confidence DESC, project_id LIMIT 50"))
def v1_queue(spark, sf_dir):
    return benchmark.queue(_v1_scored(spark, sf_dir)).select("project_id", "state", "effective_cost", "risk_score", "risk_band", "confidence", "review_status")


@query(sql.with_projects(f"""SELECT *, round(high_risk_works / works::DOUBLE, 3) AS high_risk_rate FROM (SELECT district, implementing_agency, count(*) AS works, coalesce(sum(effective_cost::DECIMAL(20,2))::DOUBLE, 0) AS total_cost, {_half_up('risk_score', 1, 1)} AS mean_risk,
  count(*) FILTER (risk_band = 'High') AS high_risk_works FROM v1_scored GROUP BY ALL) WHERE works >= 5"""))
def agency_rollup(spark, sf_dir):
    return rollups.agencies(_v1_scored(spark, sf_dir))


_NEARBY = f"""WITH {sql.PROJECTS},
placed AS (SELECT project_id AS id, district AS block, coalesce(work_category, 'nan') AS category, lower(work_description) AS t, k, CASE WHEN k % 41 <> 0 THEN n_nationkey + (k % 100) / 400.0::DOUBLE END AS lat, CASE WHEN k % 41 <> 0 THEN n_nationkey * 2 + (k % 90) / 400.0::DOUBLE END AS lon
  FROM projects JOIN orders ON o_orderkey = k JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE district IS NOT NULL),
texts AS (SELECT block, t, count(*) AS n, row_number() OVER () AS ti FROM placed GROUP BY ALL),
sized AS (SELECT block, sum(n) AS rows FROM texts GROUP BY 1),
words AS (SELECT ti, block, n, ' ' || unnest(string_split(t, ' ')) || ' ' AS w FROM texts),
grams AS (SELECT ti, block, n, w[i:i + m - 1] AS g FROM (SELECT *, unnest(range(1, length(w) - m + 2)) AS i FROM (SELECT *, unnest([3, 4, 5]) AS m FROM words) WHERE m <= length(w))),
tf AS (SELECT ti, block, n, g, 1 + ln(count(*)) AS f FROM grams GROUP BY ALL),
raw AS (SELECT ti, block, g, f * (ln((1 + rows) / (1 + sum(n) OVER (PARTITION BY block, g))::DOUBLE) + 1) AS x FROM tf JOIN sized USING (block)),
unit AS (SELECT ti, block, g, x / sqrt(sum(x * x) OVER (PARTITION BY ti)) AS x FROM raw),
own AS (SELECT id, block, category, ti, lat, lon FROM placed JOIN texts USING (block, t)),
kinds AS (SELECT DISTINCT ti, block, category, g, x FROM own JOIN unit USING (ti, block)),
alike AS (SELECT a.category, a.ti AS a, b.ti AS b, round(sum(a.x * b.x), 9) AS s FROM kinds a JOIN kinds b ON a.block = b.block AND a.category = b.category AND a.g = b.g GROUP BY ALL),
met AS (SELECT x.id AS a, y.id AS b, s FROM own x JOIN alike ON a = x.ti AND alike.category = x.category JOIN own y ON y.ti = alike.b AND y.category = x.category AND y.id <> x.id
  WHERE x.lat IS NULL OR y.lat IS NULL OR 2 * {numeric.EARTH_KM} * asin(sqrt(least(1, pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2)))) <= 12),
top AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) = 1)
SELECT project_id, CASE WHEN s >= 0.55 THEN b ELSE '' END AS similar_project_id, round(coalesce(s, 0), 4) AS similarity_score, round(greatest(0::DOUBLE, (coalesce(s, 0) - 0.55::DOUBLE) / 0.45::DOUBLE), 4) AS signal FROM projects LEFT JOIN top ON project_id = a"""


@query(_NEARBY)
def v1_duplicates(spark, sf_dir):
    """Within a district, a category and 12 km."""
    found = similarity.similarity_nearby(_projects(spark, sf_dir))
    return found.select("project_id", "similar_project_id", F.round("similarity_score", 4).alias("similarity_score"), F.round("signal_similarity", 4).alias("signal"))


def _step(n: int, stride: float) -> int:
    step = max(1, int(n * stride))
    while math.gcd(step, n) > 1:
        step += 1
    return step


@query(f"""SELECT CASE WHEN (id * {_step(1200, 0.6180339887)} + 42) % 1200 < 84 THEN [{", ".join(repr(k) for k in datagen.KINDS)}][((id * {_step(1200, 0.6180339887)} + 42) % 1200) % 5 + 1]
  WHEN (id * {_step(1200, 0.4142135623)} + 295) % 1200 < 7 THEN 'inadmissible_work' ELSE '' END AS anomaly_type, count(*) AS projects FROM range(1200) r(id) GROUP BY 1""")
def generated_register(spark, sf_dir):
    """Exactly seven in a hundred are irregular, the kinds in turn, and a few more
    above the ceiling."""
    return datagen.generate(spark).groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("projects"))


# --------------------------------------------------------------- streaming


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return alerts.windowed_counts(_t(spark, sf_dir, "events"))


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, run""")
def event_sessions(spark, sf_dir):
    out = alerts.sessions(_t(spark, sf_dir, "events"))
    return out.withColumn("session_start", F.date_format(F.col("session_start").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))
