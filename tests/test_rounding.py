"""Rounding and printing to the last place, as C and SQL engines do it."""

import math
import random

from pyspark.sql import functions as F

from workrisk.functions import text
from workrisk.operators import rollups, scoring


def test_printed_numbers_are_binary_values(spark):
    """As C's printf: what looks like a tie in decimals seldom is one."""
    values = [1.985, 1.005, 0.125, 0.375, 2.675, 1.115, 198500 / 1e5, 12.5, 13.5, 0.0, 1e9 + 0.005, -1.985, 99.995, 0.285]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate([*values, None])], "k int, x double").orderBy("k")
    for digits in (0, 1, 2):
        assert [r[0] for r in rows.select(text.fixed(F.col("x"), digits)).collect()][:-1] == [f"{x:.{digits}f}" for x in values]
    assert spark.range(1).select(text.rupees(F.lit(198500.0))).head()[0] == "Rs 1.99 lakh"


def test_monthly_mean_is_rounded_as_a_double(spark):
    """67.225 times 100 lies below 6722.5; and sums don't depend on the order of rows."""
    rows = [("2001-08-01", 60.01, "High"), ("2001-08-02", 74.44, "Low"), ("2001-09-01", 0.1, "Low"), ("2001-09-01", 0.2, "Low"), ("2001-09-03", 0.3, "Low")]
    found = {}
    for k in (1, -1):
        own = spark.createDataFrame(rows[::k], "d string, risk_score double, risk_band string").select(F.col("d").cast("date").alias("sanction_date"), "risk_score", "risk_band")
        found[k] = {r.month: r.mean_risk for r in rollups.risk_by_month(own.coalesce(1)).collect()}
    assert found[1] == found[-1] == {"2001-08": 67.22, "2001-09": 0.2}


def test_scores_between_two_steps_are_those_of_c(spark):
    """Single signals make scores that lie between two steps; C's log and exp decide."""
    rng = random.Random(1)
    rows = [(k, k / 1000, 0.0) for k in range(1001)] + [(2000 + k, round(rng.random(), 2), round(rng.random(), 1)) for k in range(500)]
    caps = {"a": 0.85, "b": 0.5}
    own = spark.createDataFrame(rows, "k int, signal_a double, signal_b double")
    got = {r.k: (r.points_a, r.points_b, r.risk_score) for r in scoring.combine(own, caps, score_digits=1).collect()}

    def half(x, digits):
        y = x * 10**digits
        return (math.floor(y) + (y - math.floor(y) >= 0.5)) / 10**digits

    for k, a, b in rows:
        e = [-math.log(1 - cap * min(s, 0.999)) for cap, s in ((0.85, a), (0.5, b))]
        total = e[0] + e[1]
        want = [half(x / total * 100 * (1 - math.exp(-total)), 2) if total else 0.0 for x in e]
        assert got[k] == (*want, half(100 * (1 - math.exp(-total)), 1)), k
