"""From raw documents to token ids: quality, line rules, near duplicates, mixing,
encoding. Each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workrisk.llm import bpe_codec, fm_quality, hyperminhash, line_quality, soft_mix
from workrisk.llm.common import delete, work_dir


#: Target shares of the tokens of soft_mix.DOMAINS.
MIX_WEIGHTS = soft_mix.WEIGHTS
#: A clean document may be short; its lines decide.
LIMITS = line_quality.Limits(short_by_lines=True)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3."""
    return fm_quality.keep_good(docs, fm_quality.train(docs, _labels(spark, sf_dir)), threshold=0.3)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without their failing lines."""
    return line_quality.clean_documents(docs, LIMITS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return hyperminhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, with a target for every domain."""
    return soft_mix.mixed_documents(docs, _labels(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), weights=MIX_WEIGHTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of ids and decoded bytes, and
    what the mixing stage has left in its table's metadata: how far the mix ends
    from its targets, and the domains out of reach (null for other tables)."""
    report = docs.schema["doc_id"].metadata.get("mix", {}) if "doc_id" in docs.columns else {}
    encoded = bpe_codec.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    unreached = ",".join(report["unreached"]) if report else None
    columns = {"mix_residual": F.lit(report.get("residual")).cast("double"), "mix_unreached": F.lit(unreached).cast("string")}
    return bpe_codec.digests(encoded, keep_ids=True).withColumns(columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("quality_rules", clean_lines),
    ("near_dedup", deduplicate),
    ("mixing", mix),
    ("encoding", encode),
]

#: A trained model decides the first stage, which SQL can't express; the tests
#: hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder
    and read again by the next; then the one before it goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top, before = work_dir(spark, "pipeline"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before:
            delete(spark, f"{top}/{before}")
        before = name
    return docs
