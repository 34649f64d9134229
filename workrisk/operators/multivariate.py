"""Unusual combinations of features: an isolation forest, density noise, and the
tail of their blend."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workrisk.config import RiskConfig
from workrisk.functions.numeric import harmonic, ramp
from workrisk.operators.density import dbscan_noise
from workrisk.operators.peers import fill_with_medians, percent_rank
from workrisk.operators.ranks import quantiles
from workrisk.plans.storage import discard, stored

# What the models see, quantities without a scale.
FEATURES = (
    "cost_robust_z", "duration_ratio", "expenditure_ratio", "payment_count", "distinct_vendors", "vendor_district_share", "days_recommendation_to_sanction",
    "sanction_uplift_pct", "data_completeness",
)


def feature_matrix(df: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """The columns as doubles, nulls and infinities as the column's median."""
    there = [c for c in columns if c in df.columns]
    number = {c: F.when(F.abs(F.col(c).cast("double")) < F.lit(math.inf), F.col(c).cast("double")) for c in there}
    return fill_with_medians(df.withColumns(number), there)


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / interquartile range; a range of 0 counts as 1."""
    own = {c: F.col(c) for c in columns}
    one = stored(quantiles(df, None, {f"_q{k}_{c}": (own[c], share) for c in columns for k, share in enumerate((0.25, 0.5, 0.75))}))
    q = lambda c, k: F.col(f"_q{k}_{c}")
    spread = lambda c: F.when(q(c, 2) - q(c, 0) == 0, F.lit(1.0)).otherwise(q(c, 2) - q(c, 0))
    return df.crossJoin(F.broadcast(one)).withColumns({c: (F.col(c) - q(c, 1)) / spread(c) for c in columns}).drop(*one.columns)


class IsolationForest:
    """Trees of random splits on small samples (Liu, Ting and Zhou, 2008)."""

    def __init__(self, trees: int, sample: int, seed: int):
        self.trees, self.sample, self.seed = trees, sample, seed
        self.nodes: list[tuple[np.ndarray, ...]] = []
        self.held: list[np.ndarray] = []
        self.used = 0

    def fit(self, rows: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        self.used = min(self.sample, len(rows))
        depth = max(1, math.ceil(math.log2(max(2, self.used))))
        for _ in range(self.trees):
            own = rows[rng.choice(len(rows), self.used, replace=False)]
            feature, cut, left, right, length, held = [], [], [], [], [], []

            def grow(part: np.ndarray, level: int) -> int:
                at = len(feature)
                feature.append(-1), cut.append(0.0), left.append(-1), right.append(-1), length.append(level + harmonic(len(part))), held.append(len(part))
                spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(part.shape[1])
                open_ = np.flatnonzero(spread > 0)
                if level < depth and len(part) > 1 and len(open_):
                    f = int(rng.choice(open_))
                    c = float(rng.uniform(part[:, f].min(), part[:, f].max()))
                    feature[at], cut[at] = f, c
                    left[at] = grow(part[part[:, f] <= c], level + 1)
                    right[at] = grow(part[part[:, f] > c], level + 1)
                return at

            grow(own, 0)
            self.nodes.append(tuple(np.array(x) for x in (feature, cut, left, right, length)))
            self.held.append(np.array(held))
        return self

    def _laid(self) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Depth, and of every tree the features, cuts and lengths of a full binary tree
        (below a leaf all places say what the leaf says): k has the children 2k, where the
        feature is not within the cut, and 2k + 1, where it is."""
        if not hasattr(self, "_full"):
            depth = max(1, math.ceil(math.log2(max(2, self.used))))
            feature, cut, length = np.zeros((self.trees, 1 << depth), dtype=np.intp), np.zeros((self.trees, 1 << depth)), np.zeros((self.trees, 1 << depth))
            for k, (own, cuts, left, right, lengths) in enumerate(self.nodes):
                at = np.zeros(1, dtype=np.intp)
                for level in range(depth):
                    here = slice(1 << level, 2 << level)
                    leaf = own[at] < 0
                    feature[k, here], cut[k, here] = np.where(leaf, 0, own[at]), cuts[at]
                    at = np.stack([np.where(leaf, at, right[at]), np.where(leaf, at, left[at])], axis=1).ravel()
                length[k] = lengths[at]
            self._full = depth, feature, cut, length
        return self._full

    def scores(self, rows: np.ndarray, at_once: int = 4096) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 is easily isolated. All rows of a
        block go down a tree together, level by level, without looking for leaves."""
        depth, feature, cut, length = self._laid()
        total = np.zeros(len(rows))
        for start in range(0, len(rows), at_once):
            block = np.ascontiguousarray(rows[start : start + at_once].T)
            n = block.shape[1]
            flat, row, sums, offset = block.ravel(), np.arange(n), total[start : start + n], feature * n
            at, place = np.empty(n, dtype=np.intp), np.empty(n, dtype=np.intp)
            x, c, left = np.empty(n), np.empty(n), np.empty(n, dtype=bool)
            for k in range(len(self.nodes)):
                np.less_equal(block[feature[k, 1]], cut[k, 1], out=left)
                np.add(left, 2, out=at, casting="unsafe")
                for _ in range(depth - 1):
                    offset[k].take(at, out=place, mode="clip")  # no place lies outside: "raise" would copy
                    place += row
                    flat.take(place, out=x, mode="clip")
                    cut[k].take(at, out=c, mode="clip")
                    np.less_equal(x, c, out=left)
                    at += at
                    at += left
                at -= 1 << depth
                length[k].take(at, out=x, mode="clip")
                sums += x
        return 2 ** -(total / max(1, len(self.nodes)) / max(harmonic(self.used), 1e-9))


    def _paths(self) -> tuple[np.ndarray, ...]:
        """Of every leaf: the features on its way with the range that leads there and
        the share of rows that would go that way not knowing the feature (a place
        without one has the share 1 and no bounds), and its length."""
        found, most = [], 1
        for (feature, cut, left, right, length), held in zip(self.nodes, self.held, strict=True):
            todo = [(0, {})]
            while todo:
                at, way = todo.pop()
                f = int(feature[at])
                if f < 0:
                    found.append((way, length[at]))
                    most = max(most, len(way))
                    continue
                low, high, share = way.get(f, (-math.inf, math.inf, 1.0))
                for child, a, b in ((left[at], low, min(high, cut[at])), (right[at], max(low, cut[at]), high)):
                    todo.append((child, way | {f: (a, b, share * held[child] / held[at])}))
        shape = (len(found), most)
        feature, low, high, share = np.zeros(shape, dtype=int), np.full(shape, -math.inf), np.full(shape, math.inf), np.ones(shape)
        for k, (way, _) in enumerate(found):
            for n, (f, (a, b, z)) in enumerate(way.items()):
                feature[k, n], low[k, n], high[k, n], share[k, n] = f, a, b, z
        return feature, low, high, share, np.array([x for _, x in found])

    def attributions(self, rows: np.ndarray, at_once: int = 1 << 19) -> np.ndarray:
        """How much each feature shortens a row's mean path, as exact Shapley values:
        they sum to the expected path less the row's. Unusual is positive.

        To a leaf leads, for a set of known features, the product of indicators (is
        the row in the range?) of those and shares of the others. The Shapley value
        of a product is the integral over u from 0 to 1 of the others' u * indicator +
        (1 - u) * share, times the feature's indicator less its share: a polynomial,
        which Gauss' quadrature integrates exactly."""
        feature, low, high, share, length = self._paths()
        places = feature.shape[1]
        nodes, weights = np.polynomial.legendre.leggauss((places + 1) // 2)
        out = np.zeros(rows.shape)
        step = max(1, at_once // max(1, places * len(rows)))
        for at in range(0, len(length), step):
            part = slice(at, at + step)
            x = rows[:, feature[part]]
            inside = (x > low[part]) & (x <= high[part])
            total = np.zeros(inside.shape)
            for u, weight in zip((nodes + 1) / 2, weights / 2, strict=True):
                factor = inside * u + (1 - u) * share[part]
                total += weight * factor.prod(axis=2, keepdims=True) / factor
            total *= (inside - share[part]) * length[part][:, None]
            own = np.zeros((total.shape[1] * places, rows.shape[1]))
            own[np.arange(len(own)), feature[part].ravel()] = 1
            out -= total.reshape(len(rows), -1) @ own
        return out / max(1, len(self.nodes))


def isolation_scores(df: DataFrame, key: str, columns: list[str], config: RiskConfig, name: str = "forest_score", drivers: str | None = None) -> DataFrame:
    """Scores of all rows, and if asked for, in the column ``drivers``, the names of
    the two features that add most to a row's score. A tree draws tree_sample rows, so trees * tree_sample
    rows, chosen by a hash of the key, are as many as the forest can use; it is
    broadcast (a few MB)."""
    share = min(1.0, config.trees * config.tree_sample / max(1, df.count()))
    part = 1 << 40
    chosen = df.where(F.pmod(F.xxhash64(key), F.lit(part)) < F.lit(int(part * share)))
    sample = chosen.select(F.col(key).cast("string"), *columns).toPandas().sort_values(key)
    forest = df.sparkSession.sparkContext.broadcast(IsolationForest(config.trees, config.tree_sample, config.seed).fit(sample[columns].to_numpy(dtype=float)))

    @F.pandas_udf("double")
    def of(*parts: pd.Series) -> pd.Series:
        return pd.Series(forest.value.scores(np.column_stack([p.to_numpy(dtype=float) for p in parts])))

    @F.pandas_udf("string")
    def named(*parts: pd.Series) -> pd.Series:
        rows = np.column_stack([p.to_numpy(dtype=float) for p in parts])
        names = np.array([c.replace("_", " ") for c in columns])
        top = np.concatenate([np.argsort(-forest.value.attributions(rows[k : k + 500]), axis=1, kind="stable")[:, :2] for k in range(0, len(rows), 500)]) if len(rows) else np.zeros((0, 2), dtype=int)
        return pd.Series([", ".join(names[t]) for t in top], dtype=object)

    out = df.withColumn(name, of(*[F.col(c) for c in columns]))
    return out.withColumn(drivers, named(*[F.col(c) for c in columns])) if drivers else out


def tail_signal(df: DataFrame, forest: str = "forest_score", noise: str = "is_noise", tail: float = 0.85) -> DataFrame:
    """The forest's scores from 0 to 1, more where the row is noise, and of their
    ranks only the tail."""
    one = df.agg(F.min(forest).alias("_low"), F.max(forest).alias("_high"))
    scaled = F.coalesce(F.try_divide(F.col(forest) - F.col("_low"), F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))), F.lit(0.0))
    blend = F.least(F.lit(1.0), scaled + 0.25 * F.col(noise).cast("double"))
    ranked = percent_rank(df.crossJoin(F.broadcast(one)).withColumn("_scaled", scaled).withColumn("_blend", blend), "_blend", "_rank")
    return ranked.withColumn("signal_multivariate", ramp(F.col("_rank"), tail, 1.0)).drop("_low", "_high", "_blend", "_rank")


def multivariate(works: DataFrame, config: RiskConfig, key: str = "work_id", columns: tuple[str, ...] = FEATURES, drivers: str | None = None) -> DataFrame:
    """signal_multivariate of all works, null where there are too few to fit, and if
    asked for the names of its drivers (else empty) with the forest's score from 0 to
    1 and the density's verdict."""
    if works.count() < config.model_rows:
        out = works.withColumn("signal_multivariate", F.lit(None).cast("double"))
        return out.withColumns({drivers: F.lit(""), "isolation_forest_score": F.lit(None).cast("double"), "dbscan_is_noise": F.lit(None).cast("double")}) if drivers else out
    there = [c for c in columns if c in works.columns]
    own = works.select(F.col(key).alias("_key"), *there)
    scaled = stored(robust_scale(feature_matrix(own, tuple(there)), there))  # both models and the ranks read it
    judged = isolation_scores(scaled, "_key", there, config, drivers=drivers)
    noisy = dbscan_noise(judged, there, config.dbscan_eps, config.dbscan_neighbours, keep=["_key", "forest_score", *([drivers] if drivers else [])])
    found = noisy if hasattr(noisy, "_stored") else stored(noisy)
    discard(scaled)
    own = tail_signal(found, tail=config.tail).select("_key", "signal_multivariate", *([drivers, F.col("_scaled").alias("isolation_forest_score"), F.col("is_noise").cast("double").alias("dbscan_is_noise")] if drivers else []))
    return works.join(own, F.col(key) == F.col("_key"), "left").drop("_key")
