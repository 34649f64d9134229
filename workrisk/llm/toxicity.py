"""Toxicity by a fuzzy lexicon and the context of its hits.

A lexicon of terms and stems is learned from labelled documents and put into a
trie. Words are read by the intersection of the trie with the Levenshtein
automata of its entries: a state is a set of (node, errors), made when first
reached, so a word costs a few table look-ups and most words die after two or
three letters. Every hit gets a strength from its entry, its distance and its
context: quotation marks and words of reporting around it weaken it, direct
address and shouting strengthen it. A logistic model over the strengths gives
the score of a document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workrisk.llm.common import bounded_batches, field_ddl, id_text
from workrisk.llm.fm_quality import fold, labelled

#: Labelled rows that a model is learned from, at most (chosen by a hash of doc_id).
SAMPLE = 8_000
#: Words on each side of a hit that are its context.
WINDOW = 5
STEMS = range(3, 9)
#: Words from this length on are matched like all others, but not kept.
LONG = 64

# Words of context.
REPORTING = frozenset("said says say saying wrote writes quoted quote quotes called calls word words term terms so-called according reported reports".split())
ADDRESS = frozenset("you your yours youre you're u ur yourself".split())
QUOTES = "\"“”„«»‘’'"

_WORD = re.compile(r"\w+")


def errors_allowed(length: int) -> int:
    """Edits that an entry of so many letters may take."""
    return 0 if length < 5 else 1 if length < 9 else 2


@dataclass
class Lexicon:
    """Entries: (letters, is a stem, weight). ``clean``: words that look like an
    entry with an error but are known from documents that aren't toxic."""

    entries: list[tuple[str, bool, float]]
    clean: frozenset[str] = frozenset()


class Matcher:
    """The trie of a lexicon intersected with its Levenshtein automata, as a
    deterministic automaton that is compiled as far as words reach."""

    def __init__(self, lexicon: Lexicon, limit: int = 400_000):
        self.lexicon, self.limit = lexicon, limit
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.budget: list[int] = [0]  # most errors of an entry below
        for k, (letters, stem, _) in enumerate(lexicon.entries):
            allowed, at = 0 if stem else errors_allowed(len(letters)), 0
            self.budget[0] = max(self.budget[0], allowed)
            for c in letters:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.budget.append(0)
                at = self.children[at][c]
                self.budget[at] = max(self.budget[at], allowed)
            self.ends[at] = k
        self.reset()

    def reset(self) -> None:
        self.states: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.found: dict[str, tuple[int, int] | None] = {}
        self.dead = self._state(frozenset())
        self.first = self._state(self._closed({(0, 0)}))

    def _state(self, places: frozenset) -> int:
        number = self.numbers.get(places)
        if number is None:
            number = self.numbers[places] = len(self.states)
            self.states.append(places)
            self.moves.append({})
        return number

    def _closed(self, places: set[tuple[int, int]]) -> frozenset:
        """With the letters of an entry that a word may leave out."""
        todo = list(places)
        while todo:
            node, errors = todo.pop()
            for child in self.children[node].values():
                new = child, errors + 1
                if errors + 1 <= self.budget[child] and new not in places:
                    places.add(new)
                    todo.append(new)
        return frozenset(places)

    def _step(self, state: int, letter: str) -> int:
        new = set()
        for node, errors in self.states[state]:
            for c, child in self.children[node].items():
                cost = errors + (c != letter)
                if cost <= self.budget[child]:
                    new.add((child, cost))
            if errors + 1 <= self.budget[node]:
                new.add((node, errors + 1))  # a letter too many
        out = self.moves[state][letter] = self._state(self._closed(new))
        return out

    def _match(self, word: str) -> tuple[int, int] | None:
        state, node, stem = self.first, 0, None
        for k, letter in enumerate(word):
            if node is not None:  # stems are read exactly
                node = self.children[node].get(letter)
                if node is not None and (end := self.ends[node]) >= 0 and self.lexicon.entries[end][1]:
                    stem = end, 0
            if state != self.dead:
                state = self.moves[state].get(letter, -1)
                if state < 0:
                    state = self._step(self._before(word, k), letter)
            if state == self.dead and node is None:
                break
        best = None
        if state != self.dead:
            for at, errors in self.states[state]:
                end = self.ends[at]
                if end >= 0 and not self.lexicon.entries[end][1] and errors <= errors_allowed(len(self.lexicon.entries[end][0])):
                    if best is None or (errors, end) < (best[1], best[0]):
                        best = end, errors
        if best and best[1] and word in self.lexicon.clean:
            best = None
        return best if best and not best[1] else stem or best

    def _before(self, word: str, k: int) -> int:
        """The state after the first k letters."""
        state = self.first
        for letter in word[:k]:
            state = self.moves[state][letter]
        return state

    def match(self, word: str) -> tuple[int, int] | None:
        """(entry, errors) of the nearest entry, or None."""
        if len(word) >= LONG:
            return self._match(word)
        if word not in self.found:
            self.found[word] = self._match(word)
        return self.found[word]

    def hits(self, words: set[str]) -> set[str]:
        """Those that match an entry."""
        if len(self.found) > self.limit or len(self.states) > self.limit:
            self.reset()
        known = self.found
        for w in words:
            if w not in known and len(w) < LONG:
                known[w] = self._match(w)
        return {w for w in words if (known[w] if len(w) < LONG else self._match(w))}


FEATURES = ("open", "quoted", "density", "whole", "stems", "strongest", "errors", "words")


def features(text: str, matcher: Matcher) -> list[float]:
    """What a document's hits add up to."""
    low = text.lower()
    words = _WORD.findall(low)
    hit_words = matcher.hits(set(words))
    if not hit_words:
        return [0.0] * len(FEATURES)
    open_, quoted, whole, stems, strongest, wrong = 0.0, 0.0, 0, 0, 0.0, 0
    spans = [m.span() for m in _WORD.finditer(low)]
    for k, word in enumerate(words):
        if word not in hit_words:
            continue
        entry, errors = matcher.match(word)
        strength = matcher.lexicon.entries[entry][2] * 0.5**errors
        near = words[max(0, k - WINDOW) : k + WINDOW + 1]
        start, end = spans[k]
        marks = low[max(0, start - 2) : start] + low[end : end + 2]
        between = low[spans[max(0, k - WINDOW)][0] : start], low[end : spans[min(len(spans) - 1, k + WINDOW)][1]]
        in_quotes = all(any(q in side for q in QUOTES[:6]) for side in between) or sum(q in marks for q in QUOTES) > 1
        reported = not REPORTING.isdisjoint(near)
        addressed = not ADDRESS.isdisjoint(near) or "!" in marks
        if in_quotes and not addressed or in_quotes and reported:
            quoted += strength
        else:
            open_ += strength * (0.7 if reported else 1.3 if addressed else 1.0)
        stem = matcher.lexicon.entries[entry][1]
        stems += stem
        whole += not errors and not stem
        wrong += errors > 0
        strongest = max(strongest, strength)
    return [float(np.log1p(open_)), float(np.log1p(quoted)), float(min(1.0, 20 * open_ / len(words))), float(np.log1p(whole)), float(np.log1p(stems)), strongest, float(np.log1p(wrong)), float(np.log1p(len(words)) / 10)]


def learn_lexicon(grams: list[tuple[str, bool, int, int, int]], toxic: int, clean: int) -> Lexicon:
    """From (letters, whole word, toxic documents, clean ones, words) of the
    labelled sample: words and stems that are far commoner in toxic documents."""
    total = max(1, toxic + clean)

    def gain(a: int, b: int) -> float:
        """Log-likelihood ratio of the split; 0 where the term is not toxic."""
        n = a + b
        if a * total <= n * toxic or a < 0.85 * n:
            return 0.0
        expected = n * toxic / total
        return 2 * (a * np.log(a / expected) + (b * np.log(b / (n - expected)) if b else 0))

    def weight(a: int, b: int) -> float:
        odds = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))
        return float(min(max(odds, 0.5), 6) / 6)

    good = {(g, whole): (a, b, n) for g, whole, a, b, n in grams if gain(a, b) >= 13}
    entries, stems = [], []
    for (g, whole), (a, b, n) in sorted(good.items(), key=lambda x: (len(x[0][0]), x[0])):
        if not whole and n >= 3 and not any(g.startswith(s) for s in stems):
            stems.append(g)
            entries.append((g, True, weight(a, b)))
    for (g, whole), (a, b, _) in sorted(good.items()):
        if whole and not any(g.startswith(s) for s in stems):
            entries.append((g, False, weight(a, b)))
    return Lexicon(entries)


@dataclass
class Model:
    lexicon: Lexicon
    bias: float
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights + self.bias, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> tuple[float, np.ndarray]:
    """Newton's method; the bias is not shrunk."""
    full = np.column_stack([x, np.ones(len(x))])
    own = np.zeros(full.shape[1])
    keep = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ own, -30, 30)))
        slope = full.T @ (y - p) - keep @ own
        curve = (full * (p * (1 - p))[:, None]).T @ full + keep
        move = np.linalg.solve(curve, slope)
        own = own + move
        if np.abs(move).max() < 1e-8:
            break
    return float(own[-1]), own[:-1]


def _feature_rows(docs: DataFrame, lexicon: Lexicon, extra: list[str]) -> DataFrame:
    """The columns ``extra`` and the features of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the labelled sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            rows = np.array([features(t, matcher) for t in batch.column("text").to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in extra), pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))], [*extra, "features"])

    ddl = ", ".join([*(field_ddl(docs, c) for c in extra), "features array<double>"])
    return docs.select(*extra, "text").mapInArrow(run, ddl)


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, sample: int = SAMPLE) -> Model:
    """Learn lexicon and model from labelled documents outside the held-out fold.
    Without labels, or with one class, the score is the share of label 1 (0 if
    there are none)."""
    bounded_batches(docs.sparkSession)
    chosen = labelled(id_text(docs), labels.select("doc_id", "toxic"), "toxic", folds, held, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, bool], list[int]] = {}
        shapes: set[tuple[str, str]] = set()
        number = [0, 0]
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                bad = label > 0.5
                number[bad] += 1
                own = set(_WORD.findall(text.lower()))
                grams = {(w, True) for w in own if len(w) > 2}
                for w in own:
                    for n in STEMS:
                        if n < len(w):
                            grams.add((w[:n], False))
                            if bad:
                                shapes.add((w[:n], w))
                for g in grams:
                    seen.setdefault(g, [0, 0])[bad] += 1
        rows = [(g, whole, n[1], n[0], None) for (g, whole), n in seen.items()]
        rows.append(("", True, number[1], number[0], None))
        rows += [(g, False, 0, 0, w) for g, w in shapes]
        kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
        for at in range(0, len(rows), 10_000):
            columns = zip(*rows[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["gram", "whole", "toxic", "clean", "word"])

    # a stem's words are counted over the whole sample, however it is partitioned
    found = chosen.mapInArrow(count, "gram string, whole boolean, toxic long, clean long, word string").groupBy("gram", "whole")
    found = found.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count_distinct("word").alias("words"))
    # what toxic documents hardly have can't be an entry
    grams = [tuple(r) for r in found.where("gram = '' OR (toxic >= 3 AND toxic >= 0.85 * (toxic + clean))").collect()]
    toxic, clean = next(((r[2], r[3]) for r in grams if r[0] == ""), (0, 0))
    lexicon = learn_lexicon([r for r in grams if r[0]], toxic, clean)
    if not toxic or not clean:
        share = min(max(toxic / max(1, toxic + clean), 1e-3), 1 - 1e-3)
        return Model(Lexicon([]), float(np.log(share / (1 - share))))
    known = docs.sparkSession.sparkContext.broadcast(lexicon)

    def resembling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, words = Matcher(known.value), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                if label <= 0.5:
                    words.update(w for w in set(_WORD.findall(text.lower())) if (m := matcher.match(w)) and m[1])
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

    alike = chosen.mapInArrow(resembling, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2")
    lexicon.clean = frozenset(r.word for r in alike.collect())
    rows = _feature_rows(chosen, lexicon, ["doc_id", "label"]).collect()
    rows.sort(key=lambda r: (r.doc_id, r.features))
    bias, weights = _logistic(np.array([r.features for r in rows]), np.array([r.label for r in rows]))
    return Model(lexicon, bias, weights)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every row.

    A null or empty text has no hits and gets the score of such documents. Rows
    that repeat are scored one by one; columns other than doc_id and text are
    not read; an empty table gives an empty result. One pass without a shuffle.
    """
    bounded_batches(docs.sparkSession)
    rows = _feature_rows(id_text(docs), model.lexicon, ["doc_id"])
    logit = F.aggregate(F.zip_with("features", F.array(*[F.lit(float(w)) for w in model.weights]), lambda x, w: x * w), F.lit(float(model.bias)), lambda s, x: s + x)
    scored = rows.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_held_out(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Train, then score all documents; held_out marks the fold that no label was
    learned from (false where doc_id is null)."""
    found = score(docs, train(docs, labels, folds, held))
    return found.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))).select("doc_id", "held_out", "score", "predicted")
