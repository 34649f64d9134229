"""Mixing by soft membership: how often each document should be used so that the
expected tokens of the domains match target weights.

The table of labels names the domains; a softmax classifier predicts each
document's posterior over them from the tokenizer's pieces, which the counter of
its tokens hashes as it reads them, and statistics of the text. With a[d, k] =
tokens of d times its posterior p[d, k], nonnegative rates r are fitted by least
squares of the K misses a' r - target, by projected gradient steps from rate 1.
Documents are measured by their tokens, so the gradient of a rate is p times the
misses in some metric, and what a document gets does not hang on its length. The
metric is the inverse of the sum of tokens p p' over the documents whose rate is
not at a bound: with it one step would be enough if no rate met a bound. Steps add
up before they are projected: r = max(0, 1 - p' s), which at the end are, of all
rates that meet the targets, the nearest to 1. A step is taken only where it
lowers the sum of squared misses, else halved. It needs K misses and K x K sums,
which one aggregation gives, and rates are an expression of s.

A target that no rates can reach is found before the fit: a share above (below) the
highest (lowest) posterior of any document, or tokens that the domain's own,
repeated REPEATS times, don't make. Such a domain is left alone: the others are
fitted, it keeps about what it has, and the result names it.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workrisk.llm.common import bounded_batches, field_ddl, id_text, only, trim, written
from workrisk.llm.count_transducer import TokenCounter, token_counter
from workrisk.llm.fm_quality import chosen

#: Domains of the labels, in the order of posteriors.
DOMAINS = ("good", "toxic", "poor")
#: Target shares of the tokens. The total is set so that the first keeps its own.
WEIGHTS = (0.90, 0.05, 0.05)
SAMPLE = 8_000
#: Buckets of pieces, bins of each statistic, and characters that are read at once.
WORDS, BINS, PART = 1 << 16, 16, 1 << 20
STATISTICS = ("pieces", "characters", "symbols", "bars", "loud", "distinct", "tokens", "digits", "line_pieces", "same_lines")
SIZE = WORDS + BINS * len(STATISTICS)
#: Rates are bounded by 0 alone.
MOST_RATE = float("inf")
TOLERANCE = 1e-3
#: A target of more than so many times a domain's tokens is out of its reach.
REPEATS = 20
#: Copies of a row that one task makes of it.
AT_ONCE = 64

_log = logging.getLogger(__name__)


def domain(quality: Column, toxic: Column) -> Column:
    """The place in DOMAINS that labels (or their means) stand for."""
    return F.when(toxic >= 0.5, 1).when(quality >= 0.5, 0).otherwise(2)


@dataclass
class Profile:
    """Of some texts: tokens, and the inputs of the classifier. ``owner`` and
    ``inputs`` have a place for each different piece of a text, ``bins`` a row of
    statistics for each text."""

    tokens: np.ndarray
    owner: np.ndarray
    inputs: np.ndarray
    bins: np.ndarray

    @property
    def weight(self) -> np.ndarray:
        """What an input of a text counts."""
        return 1 / np.sqrt(np.maximum(1, np.bincount(self.owner, minlength=len(self.tokens))))

    def rows(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Inputs and values of each text, the statistics last."""
        at = np.searchsorted(self.owner, np.arange(len(self.tokens) + 1))
        each, stat = self.weight, np.full(len(STATISTICS), 1 / np.sqrt(len(STATISTICS)))
        return [(np.concatenate([self.inputs[at[k] : at[k + 1]], self.bins[k]]), np.concatenate([np.full(at[k + 1] - at[k], each[k]), stat]).astype(np.float32)) for k in range(len(self.tokens))]


def profile(texts: list[str], counter: TokenCounter) -> Profile:
    """What a text's profile holds doesn't depend on the texts beside it."""
    n = len(texts)
    parts = list(counter.pieces(texts, hashed=True))
    owner, tokens, hashes = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=kind) for k, kind in enumerate((np.int64, np.int64, np.uint64)))
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = np.unique(owner.astype(np.uint64) << np.uint64(16) | hashes >> np.uint64(48))
    own, inputs = (keys >> np.uint64(16)).astype(np.int64), (keys & np.uint64(WORDS - 1)).astype(np.int32)
    pieces, total, distinct = np.bincount(owner, minlength=n), np.bincount(owner, tokens, n), np.bincount(own, minlength=n)
    some = np.maximum(1, pieces)
    lines = [t.split("\n") for t in texts]
    numbers = np.array([
        pieces / 100, np.array([len(t) for t in texts]) / 100, np.array([sum(map(t.count, "#*$%&|<>")) for t in texts]) / some, np.array([t.count("|") for t in texts]) / some, np.array([t.count("!!") for t in texts]) / some,
        distinct / some, total / some, np.array([sum(map(t.count, "0123456789")) for t in texts]) / some, pieces / np.array([len(x) for x in lines]) / 100, np.array([1 - len(set(x)) / len(x) for x in lines]),
    ]).reshape(len(STATISTICS), n)
    # bins of shares and sizes, five in two powers of ten from 0.001
    level = np.where(numbers < 0.001, 0, np.minimum(BINS - 1, 1 + np.floor(2.5 * np.log10(np.maximum(numbers, 0.001) * 1000)))).astype(np.int32)
    return Profile(total.astype(np.int64), own, inputs, (WORDS + BINS * np.arange(len(STATISTICS), dtype=np.int32)[:, None] + level).T)


def profiles(texts: list[str], counter: TokenCounter) -> Iterator[Profile]:
    """Of all texts in order, so many that about PART characters are read at once."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if k > at and size + len(t) > PART:
            yield profile(texts[at:k], counter)
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield profile(texts[at:], counter)


@dataclass
class Posterior:
    bias: np.ndarray
    weights: np.ndarray

    def of(self, inputs: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self._shares(self.bias + np.add.reduceat(self.weights[inputs] * values[:, None], starts).astype(np.float64))

    def of_profile(self, p: Profile) -> np.ndarray:
        n = len(p.tokens)
        words = np.stack([np.bincount(p.owner, w[p.inputs], n) for w in np.ascontiguousarray(self.weights.T)], axis=1) * p.weight[:, None]
        return self._shares(self.bias + words + self.weights[p.bins].astype(np.float64).sum(axis=1) / np.sqrt(len(STATISTICS)))

    @staticmethod
    def _shares(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit_posterior(rows: list[tuple[np.ndarray, np.ndarray, float]], kinds: int, epochs: int = 6, batch: int = 64, rate: float = 0.03, decay: float = 1e-4, seed: int = 7) -> Posterior:
    """Softmax regression by Adam steps. A domain without rows gets a prior of
    one row; without any rows all domains are as likely."""
    rng = np.random.default_rng(seed)
    counts = np.bincount([int(y) for _, _, y in rows], minlength=kinds) + 1.0
    out = Posterior(np.log(counts / counts.sum()), np.zeros((SIZE, kinds), dtype=np.float32))
    first, second, step = np.zeros_like(out.weights), np.zeros_like(out.weights), 0
    for _ in range(epochs if rows else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = [rows[k] for k in order[at : at + batch]]
            inputs, values = np.concatenate([r[0] for r in some]), np.concatenate([r[1] for r in some])
            sizes = [len(r[0]) for r in some]
            error = out.of(inputs, values, np.cumsum([0, *sizes[:-1]]))
            error[np.arange(len(some)), [int(r[2]) for r in some]] -= 1
            used, back = np.unique(inputs, return_inverse=True)
            sort = np.argsort(back, kind="stable")
            each = np.repeat(error / len(some), sizes, axis=0) * values[:, None]
            g = np.add.reduceat(each[sort], np.searchsorted(back[sort], np.arange(len(used)))) + decay * out.weights[used]
            step += 1
            first[used] = 0.9 * first[used] + 0.1 * g
            second[used] = 0.99 * second[used] + 0.01 * g * g
            out.weights[used] -= rate * (first[used] / (1 - 0.9**step)) / (np.sqrt(second[used] / (1 - 0.99**step)) + 1e-6)
            out.bias -= rate * error.mean(axis=0)
    return out


def train(docs: DataFrame, labels: DataFrame, vocabulary: str, sample: int = SAMPLE) -> Posterior:
    """Fit on a bounded sample of the labelled documents (by a hash of doc_id)."""
    bounded_batches(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t"))
    known = known.select("doc_id", domain(F.col("q"), F.col("t")).cast("double").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(token_counter)
        counter = token_counter(vocabulary)
        for batch in batches:
            found = [r for p in profiles(batch.column("text").to_pylist(), counter) for r in p.rows()]
            if found:
                raw = [pa.array([x.tobytes() for x in part], pa.binary()) for part in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *raw, batch.column("label")], ["doc_id", "inputs", "values", "label"])

    rows = chosen(id_text(docs), known, sample)
    found = rows.mapInArrow(run, f"{field_ddl(rows, 'doc_id')}, inputs binary, values binary, label double").collect()
    found.sort(key=lambda r: (r.doc_id, r.inputs))
    out = fit_posterior([(np.frombuffer(r.inputs, dtype=np.int32), np.frombuffer(r["values"], dtype=np.float32), r.label) for r in found], len(DOMAINS))
    del found
    trim()
    return out


def memberships(docs: DataFrame, model: Posterior, vocabulary: str) -> DataFrame:
    """doc_id, tokens (by the vocabulary, as count_transducer counts them) and
    posterior (array of shares) of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE * domains floats: 0.8 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(token_counter)
        counter = token_counter(vocabulary)
        for batch in batches:
            found = list(profiles(batch.column("text").to_pylist(), counter))
            rows = np.concatenate([shared.value.of_profile(p) for p in found]) if found else np.zeros((0, len(DOMAINS)))
            tokens = np.concatenate([p.tokens for p in found]) if found else np.zeros(0, dtype=np.int64)
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(DOMAINS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens), pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))], ["doc_id", "tokens", "posterior"])

    return id_text(docs).mapInArrow(run, f"{field_ddl(docs, 'doc_id')}, tokens long, posterior array<double>")


@dataclass
class Fit:
    """Targets, the sum of the steps, the expected tokens, the domains that have a
    target, and which of them (by place) are out of reach."""

    targets: np.ndarray
    steps: np.ndarray
    totals: np.ndarray
    wanted: list[int]
    unreached: list[int]

    @property
    def residual(self) -> float:
        """How far any domain is from its target, as a share of all tokens."""
        return float(np.abs(self.totals - self.targets).max() / self.targets.sum()) if self.targets.sum() else 0.0

    @property
    def fitted(self) -> np.ndarray:
        return np.array([k not in self.unreached for k in self.wanted])

    def miss(self) -> float:
        """As the residual, of the domains within reach."""
        return float(np.abs(self.totals - self.targets)[self.fitted].max(initial=0) / self.targets.sum())

    def objective(self) -> float:
        return float(((self.totals - self.targets)[self.fitted] ** 2).sum())

    def highest(self, most: float = MOST_RATE) -> float:
        """No rate is above this: posteriors are shares."""
        return float(min(most, 1 + max(0.0, *-self.steps)))

    def rate(self, tokens: Column, posterior: Column, most: float = MOST_RATE) -> Column:
        """A document's rate; one without tokens keeps the rate 1."""
        moved = F.lit(1.0)
        for k, step in zip(self.wanted, self.steps.tolist(), strict=True):
            moved = moved - posterior[k] * F.lit(step)
        return F.when(tokens > 0, F.least(F.lit(float(most)), F.greatest(F.lit(0.0), moved))).otherwise(1.0)


def fit_rates(members: DataFrame, weights: tuple[float | None, ...] = WEIGHTS, most: float = MOST_RATE, steps: int = 30, tolerance: float = TOLERANCE, repeats: float = REPEATS) -> Fit:
    """Projected gradient least squares over ``members`` (tokens, posterior).

    A domain whose weight is None has no target. What the driver holds is K
    numbers a step. Where targets can't be met together though each seems within
    reach, the domain that misses most is left alone, too, and the fit begins anew.
    """
    wanted = [k for k, w in enumerate(weights) if w is not None]
    shares, kinds = np.array([weights[k] for k in wanted], dtype=np.float64), len(wanted)
    shares /= shares.sum()
    share = [F.col("posterior")[k] for k in wanted]

    def measure(fit: Fit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Expected totals, the metric's sums over the documents that can move, and
        the lowest and highest posteriors; summed as decimals, so that no order of
        the rows changes a digit."""
        rate = fit.rate(F.col("tokens"), F.col("posterior"), most)
        rated = members.where("tokens > 0").select("tokens", rate.alias("rate"), *[p.alias(f"p{k}") for k, p in enumerate(share)])
        free = F.when((F.col("rate") > 0) & (F.col("rate") < most), F.col("tokens")).otherwise(0)
        exact = lambda x: F.sum(x.cast("decimal(38,9)"))
        sums = [exact(F.col("rate") * F.col("tokens") * F.col(f"p{k}")) for k in range(kinds)]
        sums += [exact(free * F.col(f"p{i}") * F.col(f"p{j}")) for i in range(kinds) for j in range(i, kinds)]
        sums += [f(f"p{k}") for f in (F.min, F.max) for k in range(kinds)]
        found = [float(x or 0) for x in rated.agg(*[x.alias(f"s{n}") for n, x in enumerate(sums)]).head()]
        square, n = np.zeros((kinds, kinds)), kinds + kinds * (kinds + 1) // 2
        square[np.triu_indices(kinds)] = found[kinds:n]
        return np.array(found[:kinds]), square + np.triu(square, 1).T, np.array(found[n : n + kinds]), np.array(found[n + kinds :])

    still = Fit(shares, np.zeros(kinds), shares, wanted, [])
    own, first, lowest, highest = measure(still)
    if not own.sum():
        return Fit(own, still.steps, own, wanted, [])
    targets = shares * (own[0] / shares[0] if own[0] and shares[0] else own.sum())
    beyond = (shares > highest) | (shares < lowest) | (targets > repeats * own)
    while True:
        start = out = Fit(targets, still.steps, own, wanted, [wanted[k] for k in np.flatnonzero(beyond)])
        square, length, some = first, 1.0, np.flatnonzero(~beyond)
        for _ in range(steps):
            if out.miss() <= tolerance or length < 1e-3:
                break
            # the domains' sums differ by magnitudes
            scale = 1 / np.sqrt(np.maximum(np.diag(square)[some], 1e-12))
            part = np.linalg.pinv(square[np.ix_(some, some)] * np.outer(scale, scale), rcond=1e-9, hermitian=True)
            step = np.zeros(kinds)
            step[some] = scale * (part @ (scale * (out.totals - targets)[some]))
            trial = Fit(targets, out.steps + length * step, own, wanted, out.unreached)
            trial.totals, moved, _, _ = measure(trial)
            if trial.objective() < out.objective():
                out, square, length = trial, moved, min(1.0, 2 * length)
            else:
                length /= 2
        if out.miss() <= tolerance or len(some) < 2:
            # no worse over all targets than what was there
            return out if ((out.totals - targets) ** 2).sum() <= ((own - targets) ** 2).sum() else start
        gap = np.abs(out.totals - targets) / np.maximum(targets, 1)
        gap[beyond] = gap[some[0]] = -1  # the first one's tokens set the scale
        beyond[int(gap.argmax())] = True


def copies(rate: Column, doc_id: Column) -> Column:
    """A whole number whose mean over documents is the rate, by a hash of the id."""
    chance = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit("copies")), 11).cast("double") / F.lit(float(1 << 53))
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("int")


def mix(docs: DataFrame, labels: DataFrame, vocabulary: str, weights: tuple[float | None, ...] = WEIGHTS, most: float = MOST_RATE, sample: int = SAMPLE) -> DataFrame:
    """doc_id, tokens, posterior, rate and copies of every row; residual, how far
    the expected tokens of any domain end from their target, as a share of all; and
    unreached, the domains whose target no rates reach.

    A null or empty text has no tokens and keeps the rate 1. Rows that repeat are
    rated one by one and alike. Columns other than doc_id and text are not read; an
    empty table gives an empty result. Without labels all domains are as likely for
    every document, so none can reach a target and all rates are 1. Where the fit
    ends away from the targets, a warning names the residual.
    """
    return _mixed(docs, labels, vocabulary, weights, most, sample)[0]


def _mixed(docs: DataFrame, labels: DataFrame, vocabulary: str, weights: tuple[float | None, ...], most: float, sample: int = SAMPLE) -> tuple[DataFrame, Fit]:
    members = written(memberships(docs, train(docs, labels, vocabulary, sample), vocabulary), "members")
    found = fit_rates(members, weights, most)
    unreached = ",".join(DOMAINS[k] for k in found.unreached)
    if found.residual > TOLERANCE:
        _log.warning("the mix misses its targets by up to %.4f of all tokens: expected %s, targets %s, out of reach: %s", found.residual, found.totals.round(1).tolist(), found.targets.round(1).tolist(), unreached)
    rated = members.withColumn("rate", found.rate(F.col("tokens"), F.col("posterior"), most))
    rated = rated.withColumn("copies", copies(F.col("rate"), F.col("doc_id")))
    return rated.select("doc_id", "tokens", "posterior", "rate", "copies", F.lit(found.residual).alias("residual"), F.lit(unreached).alias("unreached")), found


def _repeated(rows: DataFrame, count: str, highest: float, at_once: int = AT_ONCE) -> DataFrame:
    """Each row ``count`` times. Rows that may come more often than a task should
    make them are dealt out anew in parts."""
    if highest <= at_once:
        return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(count)))).drop("_copy")
    part = F.explode(F.sequence(F.lit(0), F.floor((F.col(count) - 1) / at_once)))
    dealt = rows.withColumn("_part", part).repartition("_part", F.xxhash64(*rows.columns))
    own = F.least(F.lit(at_once), F.col(count) - F.col("_part") * at_once).cast("int")
    return dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1), own))).drop("_copy", "_part")


def mixed_documents(docs: DataFrame, labels: DataFrame, vocabulary: str, weights: tuple[float | None, ...] = WEIGHTS, most: float = MOST_RATE) -> DataFrame:
    """The rows of ``docs``, all columns, as often as their copies say. Rows that
    repeat a doc_id have the same number; a row without one stays once. The
    metadata of the column doc_id say what mix() has in residual and unreached."""
    rated, fit = _mixed(docs, labels, vocabulary, weights, most)
    found = rated.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("copies").alias("n"))
    found = found.select(F.col("doc_id").alias("_mix_id"), F.col("n").alias("_mix_copies"))
    taken = docs.join(found, docs["doc_id"] == F.col("_mix_id"), "left").withColumn("_mix_copies", F.coalesce("_mix_copies", F.lit(1))).where("_mix_copies > 0")
    report = {"residual": fit.residual, "unreached": [DOMAINS[k] for k in fit.unreached]}
    again = _repeated(taken.drop("_mix_id"), "_mix_copies", np.ceil(fit.highest(most)))
    return again.select(*[F.col(c).alias(c, metadata={"mix": report}) if c == "doc_id" else F.col(c) for c in docs.columns])
