"""A factorisation machine that scores documents for quality.

Inputs are hashed words, structure statistics of the text in bins, and the
length that the table states. Every input has a weight and a short vector; the
products of all pairs of vectors are summed in linear time as half of (square
of the sum - sum of the squares), by coordinate.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workrisk.llm.common import bounded_batches, field_ddl, only, trim

#: Buckets of words; bins of each statistic.
WORDS, BINS = 1 << 16, 16
STATISTICS = ("words", "characters", "stated", "symbols", "bars", "loud", "capitals", "distinct", "digits", "line_words", "word_length", "stops", "runs", "same_lines")
SIZE = WORDS + BINS * len(STATISTICS)
RANK = 8
#: Labelled rows that a model is fitted on, at most (chosen by a hash of doc_id).
SAMPLE = 12_000


def _level(x: float) -> int:
    """Bins of shares and sizes, four a power of ten from 0.001."""
    return 0 if x < 0.001 else min(BINS - 1, 1 + int(2.5 * np.log10(x * 1000)))


class Features:
    """Texts to (inputs, values)."""

    def __init__(self, limit: int = 300_000):
        self.known: dict[str, int] = {}
        self.limit = limit

    def of(self, text: str, stated: int | None) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        n, size = max(1, len(words)), max(1, len(text))
        lines = text.split("\n")
        distinct = dict.fromkeys(words)
        numbers = (
            len(words), len(text), stated if stated is not None else len(text),
            sum(map(text.count, "#*$%&|<>")) / n, words.count("|") / n, text.count("!!") / n, sum(map(str.isupper, words)) / n,
            len(distinct) / n, sum(map(text.count, "0123456789")) / size, n / len(lines), size / n, text.count(".") / n,
            sum(map(operator.eq, words, islice(words, 1, None))) / n, 1 - len(set(lines)) / len(lines),
        )
        bins = [WORDS + BINS * k + _level(x / 100 if k in (0, 1, 2, 9) else x) for k, x in enumerate(numbers)]
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        found = list(map(known.get, distinct))
        if None in found:
            for at, w in enumerate(distinct):
                if found[at] is None:
                    found[at] = known[w] = zlib.crc32(w.lower().encode()) % WORDS
        hashed = np.array(found, dtype=np.int32)
        values = np.full(len(hashed) + len(bins), 1 / np.sqrt(max(1, len(hashed))), dtype=np.float32)
        values[len(hashed) :] = 1 / np.sqrt(len(bins))
        return np.concatenate([hashed, np.array(bins, dtype=np.int32)]), values

    def batch(self, texts: list[str], stated: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs and values of all texts, and where each begins."""
        found = [self.of(t, s) for t, s in zip(texts, stated, strict=True)]
        starts = np.cumsum([0, *(len(i) for i, _ in found)])
        return np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found]), starts[:-1]


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, inputs: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        scaled = self.factors[inputs] * values[:, None]
        total = np.add.reduceat(scaled, starts)
        squares = np.add.reduceat(scaled * scaled, starts)
        linear = np.add.reduceat(self.weights[inputs] * values, starts)
        return self.bias + linear + 0.5 * (total * total - squares).sum(axis=1)

    def scores(self, inputs: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(inputs, values, starts), -30, 30).astype(np.float64)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 8, batch: int = 64, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss, Adam steps on the inputs of each batch. Without rows, or
    with one class alone, the machine gives the share of label 1 (0.5 if none)."""
    rng = np.random.default_rng(seed)
    share = float(np.mean([y for _, _, y in rows])) if rows else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3)
    out = Machine(float(np.log(share / (1 - share))), np.zeros(SIZE, dtype=np.float32), np.zeros((SIZE, RANK), dtype=np.float32))
    if not rows or len({y > 0.5 for _, _, y in rows}) < 2:
        return out
    out.factors = rng.normal(0, 0.05, (SIZE, RANK)).astype(np.float32)
    table = np.concatenate([out.weights[:, None], out.factors], axis=1)  # weight, then factors
    first, second = np.zeros_like(table), np.zeros_like(table)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = [rows[k] for k in order[at : at + batch]]
            inputs, values = np.concatenate([r[0] for r in some]), np.concatenate([r[1] for r in some])
            sizes = [len(r[0]) for r in some]
            starts = np.cumsum([0, *sizes[:-1]])
            own = table[inputs]
            scaled = own[:, 1:] * values[:, None]
            total = np.add.reduceat(scaled, starts)
            z = out.bias + np.add.reduceat(own[:, 0] * values, starts) + 0.5 * (total**2 - np.add.reduceat(scaled**2, starts)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - np.array([r[2] for r in some])) / len(some)
            each = np.repeat(error, sizes) * values
            grads = np.concatenate([each[:, None], each[:, None] * (np.repeat(total, sizes, axis=0) - scaled)], axis=1)
            used, back = np.unique(inputs, return_inverse=True)
            order_ = np.argsort(back, kind="stable")
            begins = np.searchsorted(back[order_], np.arange(len(used)))
            g = np.add.reduceat(grads[order_], begins) + decay * table[used]
            step += 1
            first[used] = 0.9 * first[used] + 0.1 * g
            second[used] = 0.99 * second[used] + 0.01 * g * g
            table[used] -= rate * (first[used] / (1 - 0.9**step)) / (np.sqrt(second[used] / (1 - 0.99**step)) + 1e-6)
            out.bias -= rate * float(error.sum())
    out.weights, out.factors = table[:, 0].copy(), table[:, 1:].copy()
    return out


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's digits, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int) -> DataFrame:
    """The documents that a model may learn from, with ``label`` (the mean over
    rows that repeat an id): not in the held-out fold, at most about ``most`` of
    them, chosen by a hash. The chosen ids are few, so they are broadcast."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    known = known.groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("label"))
    return chosen(docs, known, most)


def chosen(docs: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """``docs`` of at most about ``most`` ids of ``known`` (doc_id, label)."""
    parts, share = 1 << 30, min(1.0, most / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < F.lit(int(parts * share)))
    return docs.join(F.broadcast(some), "doc_id")


def _stated(docs: DataFrame) -> Column:
    numeric = {"int", "bigint", "smallint", "tinyint"}
    return F.col("n_chars").cast("long") if dict(docs.dtypes).get("n_chars") in numeric else F.lit(None).cast("long")


def inputs_of(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the stated length."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _stated(docs).alias("stated"))


def collect_inputs(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Inputs, values and label of a bounded sample; made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        features = Features()
        for batch in batches:
            if batch.num_rows:
                found = [features.of(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("stated").to_pylist(), strict=True)]
                raw = [pa.array([x.tobytes() for x in part], pa.binary()) for part in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *raw, batch.column("label")], ["doc_id", "inputs", "values", "label"])

    found = rows.mapInArrow(run, f"{field_ddl(rows, 'doc_id')}, inputs binary, values binary, label double").collect()
    found.sort(key=lambda r: (r.doc_id, r.inputs))
    return [(np.frombuffer(r.inputs, dtype=np.int32), np.frombuffer(r["values"], dtype=np.float32), r.label) for r in found]


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample: int = SAMPLE) -> Machine:
    """Fit on labelled documents outside the held-out fold. The features of the
    bounded sample are made on the executors; the driver holds only those."""
    bounded_batches(docs.sparkSession)
    out = fit(collect_inputs(labelled(inputs_of(docs), labels.select("doc_id", "quality"), "quality", folds, held, sample)))
    trim()
    return out


def _scorer(docs: DataFrame, machine: Machine):
    """A function of a batch's texts and stated lengths, for the workers."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # SIZE * (RANK + 1) floats: 2.4 MB

    def make():
        features = Features()

        def scores(texts: list[str], stated: list) -> np.ndarray:
            out = np.zeros(len(texts))
            for at in range(0, len(texts), 200):
                part = slice(at, at + 200)
                out[part] = shared.value.scores(*features.batch([t or "" for t in texts[part]], stated[part]))
            return out

        return scores

    return make


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every row.

    A null or empty text is scored by its statistics alone; a null n_chars is
    taken from the text. Rows that repeat are scored one by one; columns other
    than doc_id, text and n_chars are not read; an empty table gives an empty
    result. One pass without a shuffle.
    """
    bounded_batches(docs.sparkSession)
    make = _scorer(docs, machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        scores = make()
        for batch in batches:
            found = scores(batch.column("text").to_pylist(), batch.column("stated").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return inputs_of(docs).mapInArrow(run, f"{field_ddl(docs, 'doc_id')}, score double, predicted int")


def keep_good(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all columns."""
    bounded_batches(docs.sparkSession)
    make = _scorer(docs, machine)
    stated = dict(docs.dtypes).get("n_chars") in {"int", "bigint", "smallint", "tinyint"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        scores = make()
        for batch in batches:
            lengths = batch.column("n_chars").to_pylist() if stated else [None] * batch.num_rows
            yield batch.filter(pa.array(scores(batch.column("text").to_pylist(), lengths) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def score_held_out(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Train, then score all documents; held_out marks the fold that no label was
    learned from (false where doc_id is null)."""
    found = score(docs, train(docs, labels, folds, held))
    return found.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))).select("doc_id", "held_out", "score", "predicted")
