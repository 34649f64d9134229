"""From sources to a scored register: the engine's two entry points as plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from workrisk.config import PEER_LEVELS, RiskConfig
from workrisk.operators import build, detectors, multivariate, peers, scoring, similarity
from workrisk.plans import adapter
from workrisk.plans.storage import discard, kept, known, settled, stamp, stored, stored_in_parts

#: Tables that the register is built from.
TABLES = ("orders", "customer", "nation", "lineitem", "part")


def build_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched, _ = build.recommendations(adapter.recommended(spark, sf_dir))
    return build.unify(adapter.spine(spark, sf_dir), adapter.completed(spark, sf_dir), adapter.payments(spark, sf_dir), matched, adapter.AS_OF)


CONFIG = RiskConfig(min_peer_group=adapter.PEERS)


def features(works: DataFrame, config: RiskConfig, last: bool = False) -> DataFrame:
    """Peer groups and their statistics, of works to be read several times. They are
    made of the columns that they need; whole works travel once, to meet them. With
    ``last`` nothing else reads the stored works any more, and they go meanwhile."""
    read = dict.fromkeys([*peers.READ, *[c for _, columns in PEER_LEVELS for c in columns if c in works.columns]])
    grouped = stored(peers.assign_peers(works.select(*read), config.min_peer_group))
    found = peers.peer_statistics(grouped)
    discard(grouped)
    return stored_in_parts("work_id", lambda some: peers.with_columns_of(some(works), some(found)), (found, works) if last else (found,))


def evidence(featured: DataFrame, config: RiskConfig, full: bool = True, last: bool = False) -> DataFrame:
    """Signals, points, bands and confidence; all six detectors, or all but the
    models of unusual combinations. ``last`` as for features()."""
    has = lambda *names: [c for c in names if c in featured.columns]
    narrow = featured.select("work_id", *has("district", "description_normalised", "description_is_mojibake"))
    found = [settled(lambda: similarity.similarity(narrow, config.similarity_floor, config.similarity_block).select("work_id", "similarity_score", "similar_work_id", "signal_similarity"))]
    if full:
        own = featured.select("work_id", *has(*multivariate.FEATURES))
        found.append(settled(lambda: multivariate.multivariate(own, config).select("work_id", "signal_multivariate")))
    thresholds = stored(detectors.percentiles(featured, config))

    def joined(some) -> DataFrame:
        out = detectors.detect(some(featured), config, thresholds)
        for more in found:
            out = peers.with_columns_of(out, some(more))
        return scoring.score(out, config)

    return stored_in_parts("work_id", joined, (*found, thresholds, featured) if last else (*found, thresholds))


def score_works(works: DataFrame, config: RiskConfig = RiskConfig()) -> DataFrame:
    """All detectors, points, bands, confidence, explanations and briefings."""
    return scoring.narrate(evidence(features(stored(works), config, True), config, last=True))


def _key(spark: SparkSession, sf_dir: str, what: str) -> tuple:
    return what, *(stamp(spark, f"{sf_dir}/{t}.parquet") for t in TABLES)


def _shared(spark: SparkSession, sf_dir: str, what: str, make) -> DataFrame:
    """make(), stored once for all queries over the same files."""
    return kept(spark, _key(spark, sf_dir, what), make)


def shared_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and scored works are works with more columns, so works are stored only
    before them."""
    if _known(spark, sf_dir, "works") or not _known(spark, sf_dir, "features", "plain", "scored"):
        return _shared(spark, sf_dir, "works", lambda: build_works(spark, sf_dir))
    return shared_features(spark, sf_dir).drop(*peers.ADDED)


def shared_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of scored works, where there are such and no features."""
    there = _known(spark, sf_dir, "features", "plain", "scored")
    if there in ("plain", "scored"):
        found = _shared(spark, sf_dir, there, None)
        return found.select(*found.columns[: found.columns.index(peers.ADDED[-1]) + 1])
    return _shared(spark, sf_dir, "features", lambda: _make_features(spark, sf_dir))


def _make_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = _known(spark, sf_dir, "works")
    return features(shared_works(spark, sf_dir) if there else settled(lambda: build_works(spark, sf_dir)), CONFIG, not there)


def _known(spark: SparkSession, sf_dir: str, *names: str) -> str | None:
    """The first of the tables that is there already."""
    return next((n for n in names if known(spark, _key(spark, sf_dir, n))), None)


def _make_scored(spark: SparkSession, sf_dir: str, full: bool) -> DataFrame:
    """Features that nobody has asked for yet are on the way only, and go while scored
    works are written."""
    if _known(spark, sf_dir, "features", "plain", "scored"):
        return evidence(shared_features(spark, sf_dir), CONFIG, full)
    return evidence(settled(lambda: _make_features(spark, sf_dir)), CONFIG, full, True)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors."""
    return scoring.narrate(_shared(spark, sf_dir, "scored", lambda: _make_scored(spark, sf_dir, True)))


def plain_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the detector that SQL can't express."""
    return scoring.narrate(_shared(spark, sf_dir, "plain", lambda: _make_scored(spark, sf_dir, False)))
