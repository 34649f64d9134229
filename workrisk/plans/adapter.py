"""The engine's inputs from the driver's tables: orders are works, their lines are
payments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workrisk.config import EXPECTED_DAYS, INADMISSIBLE
from workrisk.operators.validation import STATUSES

AS_OF = "2001-12-31"
#: Large enough that every level of the peer cascade takes some works.
PEERS = 45


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def status(k):
    """Mostly as the order's status says; some fit neither it nor the completions."""
    plain = F.when(F.col("o_orderstatus") == "F", STATUSES[4]).when(F.col("o_orderstatus") == "P", STATUSES[3]).otherwise(STATUSES[1])
    return F.when(k % 37 == 0, STATUSES[4]).when(k % 31 == 0, STATUSES[0]).when(k % 29 == 0, STATUSES[2]).when(k % 71 == 0, STATUSES[5]).when(k % 73 != 0, plain)


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)  # nations are 25
    return joined.select(
        k.cast("string").alias("work_id"), F.col("n_name").alias("state"), F.when(k % 59 != 0, F.concat("n_name", F.lit("/"), "c_mktsegment")).alias("district"), F.col("c_name").alias("mp_name"),
        F.concat(F.when(k % 53 == 0, "?????? ???").otherwise(F.concat(F.lit("Work on "), F.lower("o_orderpriority"))), F.lit(" lot "), (k % 97).cast("string")).alias("work_description"), F.col("o_orderpriority").alias("work_category"),
        F.col("o_totalprice").alias("sanction_amount"), day.alias("sanction_date"), F.date_sub(day, (k % 300).cast("int")).alias("recommended_date"), status(k).alias("work_status"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    # a third of the works have no type, so that broader peer levels are needed
    kind = F.when(F.col("l_orderkey") % 3 != 0, F.col("p_type"))
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").cast("string").alias("work_id"), kind.alias("work_type"), F.concat(F.lit("V"), F.col("l_suppkey").cast("string")).alias("vendor"), F.col("l_shipdate").cast("date").alias("paid_on"),
        F.when(F.col("l_returnflag") == "A", "In-Progress").otherwise("Payment Success").alias("status"), F.col("l_extendedprice").alias("amount"),
    )


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    day = F.coalesce(F.col("last").cast("date"), F.date_add(F.col("o_orderdate").cast("date"), 30))
    return orders.join(last, orders.o_orderkey == last.l_orderkey, "left").select(F.col("o_orderkey").cast("string").alias("work_id"), day.alias("completion_date"))


def recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recommendations; those of a third of the works have no id."""
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    k = F.col("o_orderkey")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
    return joined.select(
        F.when(k % 3 != 0, k.cast("string")).alias("work_id"), F.col("n_name").alias("state"), F.round(F.round("o_totalprice") * (75 + k % 40) / 100, 2).alias("recommended_amount"),
        F.date_sub(F.col("o_orderdate").cast("date"), (k % 300).cast("int")).alias("recommended_on"), F.when(k % 2 == 0, F.col("o_orderdate").cast("date")).alias("sanction_date"), k.alias("source_row"),
    )


def allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
    return joined.select(F.col("c_name").alias("mp_name"), F.col("n_name").alias("state"), F.col("c_mktsegment").alias("constituency"), (F.col("c_acctbal") * 1000).alias("allocated_amount"))


#: The benchmark's categories, some that aren't admissible, and one missing.
CATEGORIES = [*EXPECTED_DAYS, *INADMISSIBLE[:2], None]


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the benchmark's projects, with gaps in every column that may have
    them; risk_label stands for a known answer."""
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("last"), F.sum(F.col("l_extendedprice").cast("decimal(20,2)")).cast("double").alias("spent"))
    cost = F.round(F.col("o_totalprice") * 30, 0)
    return joined.join(lines, k == F.col("l_orderkey"), "left").select(
        F.concat(F.lit("P"), k.cast("string")).alias("project_id"), F.col("n_name").alias("state"), F.when(k % 59 != 0, F.concat("n_name", F.lit("/"), "c_mktsegment")).alias("district"),
        F.concat(F.lit("Block "), (k % 6).cast("string")).alias("block"), F.when(k % 41 != 0, F.col("n_nationkey") + (k % 100) / 400.0).alias("latitude"), F.when(k % 41 != 0, F.col("n_nationkey") * 2 + (k % 90) / 400.0).alias("longitude"),
        F.col("c_name").alias("mp_name"), F.col("c_mktsegment").alias("constituency"), F.lit("Works").alias("sector"), F.element_at(F.array(*[F.lit(x) for x in CATEGORIES]), (k % len(CATEGORIES) + 1).cast("int")).alias("work_category"),
        F.concat(F.lit("Construction of lot "), (k % 211).cast("string"), F.lit(" for "), F.lower("o_orderpriority")).alias("work_description"), F.when(k % 43 != 0, F.concat(F.lit("Agency "), (k % 3).cast("string"))).alias("implementing_agency"),
        F.when(k % 79 != 0, day).alias("sanction_date"), F.date_add(day, 200).alias("expected_completion_date"), F.when(k % 5 != 0, F.col("last")).alias("actual_completion_date"), cost.alias("sanctioned_cost"),
        F.when(k % 4 != 0, F.when(k % 9 == 0, F.round(cost * 1.2, 0)).otherwise(cost)).alias("revised_cost"), F.when(k % 8 != 0, F.col("spent") * 30).alias("expenditure"), F.when(k % 23 != 0, (k % 101).cast("double")).alias("physical_progress_pct"),
        F.when(k % 2 == 0, "Completed").when(k % 3 == 0, "In progress").alias("status"), (F.col("o_orderstatus") == "F").alias("risk_label"),
    )
