"""Exact quantiles and running sums in groups of any size: no task holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workrisk.plans.storage import stored

#: A group of fewer values is sorted by the task that aggregates it.
SMALL = 50_000
#: Ranges that a larger group's values are cut into, again and again.
RANGES = 256
_ROUNDS = 40


def quantiles(df: DataFrame, by: str | None, wanted: dict[str, tuple[Column, float]], small: int = SMALL, largest: int | None = None) -> DataFrame:
    """``by`` and a column for each wanted (value, share): the exact quantile of the
    group's values, between two values in proportion; nulls are left out.

    Groups of up to ``small`` values are aggregated as they are. A larger group's
    values are cut into ranges of about equal counts, the values before, in and at
    the ends of the range around the wanted rank are counted, and the range is cut
    again until ``small`` values are left in it: two passes over the group a round,
    with a row a rank and task to shuffle. All large groups and values go together; ranks
    of one Column object are ranks of the same values, which are read once.
    Without ``by`` there is one row; rows without a group are left out. Who knows
    that no group has more than ``largest`` rows saves counting them.
    """
    names = list(wanted)
    group = F.col(by) if by else F.lit(0)
    columns = list({id(wanted[n][0]): wanted[n][0] for n in names}.values())
    of = [next(k for k, c in enumerate(columns) if c is wanted[n][0]) for n in names]
    own = df.select(group.alias("_g"), *[c.cast("double").alias(f"_v{k}") for k, c in enumerate(columns)])
    own = own.where("_g IS NOT NULL") if by else own
    values = [f"_v{k}" for k in range(len(columns))]
    shares = [float(wanted[n][1]) for n in names]

    def direct(rows: DataFrame) -> DataFrame:
        return rows.groupBy("_g").agg(*[F.percentile(values[k], q).alias(n) for k, q, n in zip(of, shares, names, strict=True)])

    large = None
    if largest is None or largest > small:
        large = own.groupBy("_g").agg(*[F.count(v).alias(v) for v in values]).where(F.greatest(*values, F.lit(0)) > small)
    if large is None or not large.head(1):
        found = direct(own)
    else:
        large = stored(large)
        keys = large.select("_g")
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("_i"), F.col(v).alias("_x")) for k, v in enumerate(values)]))
        long = own.join(keys, "_g").select("_g", each.alias("p")).select("_g", "p.*").where("_x IS NOT NULL")
        found = direct(own.join(keys, "_g", "left_anti")).unionByName(_of_large(large, long, list(zip(names, of, shares, strict=True)), small))
    if by:
        return found.withColumnRenamed("_g", by)
    return df.sparkSession.range(1).join(F.broadcast(found.drop("_g")), F.lit(True), "left").drop("id")  # one row


def _of_large(large: DataFrame, long: DataFrame, wanted: list[tuple[str, int, float]], small: int) -> DataFrame:
    """_g and the quantiles, from rows (_g, _i, _x) of the groups in ``large``."""
    place = lambda k, q: F.lit(q) * (F.col(f"_v{k}") - 1)
    ranks = [F.struct(F.lit(k).alias("_i"), end(place(k, q)).cast("long").alias("_k"), F.col(f"_v{k}").alias("_n")) for _, k, q in wanted for end in (F.floor, F.ceil)]
    nothing = F.lit(None).cast("double")
    state = large.select("_g", F.explode(F.array_distinct(F.array(*ranks))).alias("r")).select("_g", "r.*").where("_n > 0").select(
        "_g", "_i", "_k", F.lit(0).cast("long").alias("_before"), "_n", nothing.alias("_low"), nothing.alias("_high"), nothing.alias("_value")
    )
    state = stored(state)
    on = ["_g", "_i"]
    x, low, high = F.col("_x"), F.col("_low"), F.col("_high")
    inside = (low.isNull() | (x > low)) & (high.isNull() | (x < high))
    grid = [j / RANGES for j in range(RANGES + 1)]
    for _ in range(_ROUNDS):
        open_ = state.where((F.col("_n") > small) & F.col("_value").isNull())
        if not open_.head(1):
            break
        # ranks that share a range share its cuts
        ranges = open_.select(*on, "_low", "_high").distinct()
        seen = long.join(ranges, on).where(inside).groupBy(*on, "_low", "_high").agg(F.percentile_approx("_x", grid, 8 * RANGES).alias("_cuts"))
        cuts = seen.select(*[F.col(c).alias(f"_of{c}") for c in (*on, "_low", "_high")], "_cuts")
        same = (F.col("_g") == F.col("_of_g")) & (F.col("_i") == F.col("_of_i")) & low.eqNullSafe(F.col("_of_low")) & high.eqNullSafe(F.col("_of_high"))
        at = (F.col("_k") - F.col("_before")) / F.col("_n") * RANGES
        bound = lambda to: F.element_at("_cuts", (F.least(F.lit(RANGES), F.greatest(F.lit(0), to)) + 1).cast("int"))
        cut = stored(open_.join(cuts, same).select(*open_.columns, bound(F.floor(at) - 1).alias("_a"), bound(F.ceil(at) + 1).alias("_b")))
        a, b = F.col("_a"), F.col("_b")
        counted = long.join(cut, on).where(inside).groupBy(*on, "_k").agg(
            F.count_if(x < a).alias("_c0"), F.count_if(x == a).alias("_c1"), F.count_if((x > a) & (x < b)).alias("_c2"), F.count_if((x == b) & (b > a)).alias("_c3"), F.count_if(x > b).alias("_c4")
        )
        # which of the five parts holds the rank, whatever the cuts were worth
        upto, parts = F.col("_before"), []
        for c, kind in zip(("_c0", "_c1", "_c2", "_c3", "_c4"), ((low, a, None), (None, None, a), (a, b, None), (None, None, b), (b, high, None)), strict=True):
            parts.append((upto + F.col(c), F.struct(upto.alias("_before"), F.col(c).alias("_n"), *[(v if v is not None else nothing).alias(n) for n, v in zip(("_low", "_high", "_value"), kind, strict=True)])))
            upto = upto + F.col(c)
        chosen = F.coalesce(*[F.when(F.col("_k") < end, part) for end, part in parts])
        moved = cut.join(counted, [*on, "_k"]).select(*on, "_k", chosen.alias("p")).select(*on, "_k", "p.*")
        state = stored(moved.unionByName(state.where((F.col("_n") <= small) | F.col("_value").isNotNull())))
    else:
        raise RuntimeError("the ranges did not close in")
    left = state.where("_value IS NULL")
    last = long.join(left, on).where(inside).groupBy(*on, "_k", "_before").agg(F.array_sort(F.collect_list("_x")).alias("_all"))
    last = last.select(*on, "_k", F.element_at("_all", (F.col("_k") - F.col("_before") + 1).cast("int")).alias("_value"))
    known = state.where("_value IS NOT NULL").select(*on, "_k", "_value").union(last)
    values = known.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("_i", "_k"), "_value"))).alias("_values"))  # two a column

    def between(k: int, q: float) -> Column:
        to = place(k, q)
        value = lambda end: F.col("_values")[F.struct(F.lit(k).alias("_i"), end(to).cast("long").alias("_k"))]
        return F.when(F.floor(to) == F.ceil(to), value(F.floor)).otherwise((F.ceil(to) - to) * value(F.floor) + (to - F.floor(to)) * value(F.ceil))

    return large.join(values, "_g").select("_g", *[between(k, q).alias(n) for n, k, q in wanted])


def running(counts: DataFrame, order: list[str], n: str = "_n", by: str | None = None) -> DataFrame:
    """Rows with _upto, the sum of ``n`` up to and with a row in the order, and _all,
    the sum of its group. Rows are dealt into ranges of (group, order) as many as
    their number asks for; sums run inside ranges, and what a group has in earlier
    ranges (a row a range and group) is added. The ranges are stored with the rows,
    so that both readers see the same ones."""
    group = [by] if by else []
    ranged = stored(counts.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy("_part", *group).agg(F.sum(n).alias("_sum"))
    whole = Window.partitionBy(*group)
    starts = sums.select("_part", *group, F.coalesce(F.sum("_sum").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_sum").over(whole).alias("_all"))
    return ranged.withColumn("_in", F.sum(n).over(inside)).join(starts, ["_part", *group]).withColumn("_upto", F.col("_in") + F.col("_start")).drop("_part", "_in", "_start")
