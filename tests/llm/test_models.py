"""Quality, toxicity, line rules and mixing: brute force, properties and
held-out accuracy."""

import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from workrisk.llm import fm_quality, line_quality, soft_mix, toxicity
from workrisk.llm.count_transducer import CUTTER_PATTERN, token_counter
from workrisk.llm.queries import queries

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.01"


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


# ------------------------------------------------------------------ line rules


def test_base_statistics_by_another_way(documents, odd_texts):
    rows = [*odd_texts, (20, "a b c a b c d"), (21, "x y\nx y\n\nx y\nz"), (22, "the end. " * 40)]
    got = line_quality.judge_documents(documents(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        inside = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)} if len(windows) < 500 else None
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = by_id[i]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        assert r.n_dup_lines == sum(x in lines[:k] for k, x in enumerate(lines))
        if inside is not None:
            assert r.n_repeat_words == len(inside)
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words))
        assert not (r.base_failed and r.kept)
    assert line_quality.judge_documents(documents([])).count() == 0


@pytest.mark.parametrize(
    "line, fault",
    [
        ("Home | News | Contact", "navigation"), ("of*** the### and$$$", "symbols"), ("BUY!! NOW!! please", "shouting"), ("go " * 12, "monotone"), ("All rights reserved.", "boilerplate"),
        ("no end here", "punctuation"), ("A plain sentence of words.", None),
    ],
)
def test_line_rules(line, fault):
    assert line_quality.line_fault(line.split(), line, False) == fault
    assert line_quality.line_fault("a b c.".split(), "a b c.", True) == "repeated"
    long = " ".join(f"word{k}" for k in range(40)) + " reads the privacy policy"
    assert line_quality.line_fault(long.split(), long, False) is None


@pytest.mark.parametrize(("text", "kept"), [
    ("One plain sentence stands here.", True),
    ("The first line says this. Yes.\nAnother one.\nThe first line says this. Yes.", True),  # over half of it in repeated windows
    ("A sentence here. 19.37.233.111", True),  # breaks off after a sentence
    ("Les.", True),
    ("one one two two three three four four", False),  # no sentence
    ("Buy now. Buy now. Buy now. Buy now.", False),  # under half of its words differ
    ("home | about | news | shop |\nWords here.", False),
    ("Star*** word.###", False),
    ("Short one.\nAll rights reserved by the owner of it.", False),  # loses most of its text
    ("", False), (" \n\t", False),
])
def test_short_documents_by_their_lines(text, kept):
    assert line_quality.judge(text, line_quality.Limits(short_by_lines=True)).kept == kept
    assert not line_quality.judge(text).kept
    # no word more or less changes what a long text gets
    long = "\n".join(f"Sentence number {k} of this text has words{k} of its own{k}." for k in range(20)) + "\n" + text
    assert line_quality.judge(long, line_quality.Limits(short_by_lines=True)) == line_quality.judge(long)


def test_clean_documents_keeps_columns_and_good_lines(documents):
    good = " ".join(f"word{k}" for k in range(60)) + "."
    out = line_quality.clean_documents(documents([(1, good + "\nHome | News | Contact"), (2, "short"), (3, None)])).collect()
    assert [(r.doc_id, r.text, r.n_chars, r.kept) for r in out] == [(1, good, len(good), "x")]


# ------------------------------------------------------------- quality machine


def test_linear_time_interactions_equal_all_pairs():
    rng = np.random.default_rng(0)
    m = fm_quality.Machine(0.3, rng.normal(size=fm_quality.SIZE).astype(np.float32), rng.normal(size=(fm_quality.SIZE, fm_quality.RANK)).astype(np.float32))
    inputs, values = np.array([1, 5, 9, 70], dtype=np.int32), np.array([0.5, 1.0, 0.2, 0.7], dtype=np.float32)
    pairs = sum(float(m.factors[inputs[i]] @ m.factors[inputs[j]]) * values[i] * values[j] for i in range(4) for j in range(i))
    assert np.isclose(m.logits(inputs, values, np.array([0]))[0], 0.3 + float(m.weights[inputs] @ values) + pairs, atol=1e-4)


def test_quality_of_held_out_documents(tables):
    docs, labels = tables
    scored = fm_quality.score_held_out(docs, labels)
    rows = scored.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert auc([(r.score, r.quality) for r in rows if r.held_out]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    assert scored.count() == docs.count()


def test_quality_rows_equal_sums_over_pairs(spark):
    """The query's own rows against the machine's definition, document by document."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    m, make = fm_quality.train(docs, labels), fm_quality.Features()
    want = {}
    for r in docs.collect():
        inputs, values = make.of(r.text or "", r.n_chars)
        v = m.factors[inputs].astype(float) * values[:, None]
        products = v @ v.T
        z = m.bias + float(m.weights[inputs].astype(float) @ values) + (products.sum() - np.trace(products)) / 2
        want[r.doc_id] = 1 / (1 + np.exp(-z))
    got = queries()["op4_fm_quality"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-4 and r.predicted == (r.score >= 0.3)


def test_quality_edges(documents, odd_texts, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = documents(odd_texts)
    rows = fm_quality.score_held_out(docs, labels).collect()
    assert len(rows) == len(odd_texts) and all(0 <= r.score <= 1 for r in rows)
    assert fm_quality.score_held_out(documents([]), labels.limit(0)).count() == 0
    machine = fm_quality.fit([])
    kept = fm_quality.keep_good(docs, machine, threshold=0.3)
    assert kept.columns == docs.columns and kept.count() == len(odd_texts)
    assert fm_quality.keep_good(docs, machine, threshold=0.6).count() == 0


# -------------------------------------------------------------------- toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = ["worthless", "idiot", "scum", "pathetic", "disgusting"]
    matcher = toxicity.Matcher(toxicity.Lexicon([(t, False, 1.0) for t in terms] + [("réeux", True, 1.0)]))
    rng = np.random.default_rng(4)
    words = list(terms) + ["réeuxment", "réeu", "word", "", "idiots", "wrthless", "worthles", "w0rthl3ss", "pathetik"]
    for t in terms:
        for _ in range(60):
            w = list(t)
            for _ in range(int(rng.integers(1, 4))):
                k, kind = int(rng.integers(len(w) + 1)), int(rng.integers(3))
                w[k : k + (kind > 0)] = [] if kind == 2 else [str(rng.choice(list("abcdeilo")))]
            words.append("".join(w))
    for w in words:
        near = min(((distance(w, t), k) for k, t in enumerate(terms) if distance(w, t) <= toxicity.errors_allowed(len(t))), default=None)
        if near and near[0] == 0 or not w.startswith("réeux"):
            assert matcher.match(w) == ((near[1], near[0]) if near else None), w
        else:
            assert matcher.match(w) == (len(terms), 0)


def test_context_separates_quotation_from_abuse():
    matcher = toxicity.Matcher(toxicity.Lexicon([("idiot", False, 1.0)]))
    open_, quoted = toxicity.FEATURES.index("open"), toxicity.FEATURES.index("quoted")
    abuse, quote = toxicity.features("you are an idiot", matcher), toxicity.features('the word "idiot" was quoted', matcher)
    assert abuse[open_] > quote[open_] == 0 and quote[quoted] > 0


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_held_out(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    own = [r for r in rows if r.held_out]
    assert auc([(r.score, r.toxic) for r in own]) > 0.95
    assert sum(r.predicted and not r.toxic for r in own) < 0.01 * len(own) and sum(r.predicted for r in own if r.toxic) > 0.9 * sum(r.toxic for r in own)


class Plain:
    """Entries looked up one by one, by edit distance."""

    def __init__(self, lexicon):
        self.lexicon = lexicon

    def match(self, word):
        entries = self.lexicon.entries
        stem = next(((k, 0) for k, (term, is_stem, _) in enumerate(entries) if is_stem and word.startswith(term)), None)
        near = [(distance(word, t), k) for k, (t, is_stem, _) in enumerate(entries) if not is_stem and abs(len(t) - len(word)) < 4]
        near = min(((e, k) for e, k in near if e <= toxicity.errors_allowed(len(entries[k][0]))), default=None)
        if near and near[0] and word in self.lexicon.clean:
            near = None
        best = near and (near[1], near[0])
        return best if best and not best[1] else stem or best

    def hits(self, words):
        return {w for w in words if self.match(w)}


def test_toxicity_rows_equal_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    plain = Plain(model.lexicon)
    want = {r.doc_id: model.scores(np.array([toxicity.features(r.text or "", plain)]))[0] for r in docs.collect()}
    got = queries()["op6_toxicity"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-9 and r.predicted == (r.score >= 0.3)


def test_toxicity_edges(documents, odd_texts, spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_held_out(documents(odd_texts), labels).collect()
    assert len(rows) == len(odd_texts) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_held_out(documents([]), labels.limit(0)).count() == 0


# ---------------------------------------------------------------------- mixing


def test_rates_meet_targets_and_equal_numpy(spark):
    rng = np.random.default_rng(6)
    rows = [(int(t), [float(x) for x in p]) for t, p in zip(rng.integers(1, 900, 400), rng.dirichlet([2, 1, 1], 400), strict=True)]
    members = spark.createDataFrame(rows, "tokens long, posterior array<double>")
    found = soft_mix.fit_rates(members, (0.6, 0.2, 0.2), 3.0, tolerance=1e-4)
    a, p = np.array([[t * x for x in p] for t, p in rows]), np.array([p for _, p in rows])
    r = np.clip(1 - p @ found.steps, 0, 3.0)
    spark_rates = [x.r for x in members.select(found.rate(F.col("tokens"), F.col("posterior"), 3.0).alias("r")).collect()]
    assert np.allclose(np.sort(spark_rates), np.sort(r), atol=1e-9)
    assert np.abs(r @ a - found.targets).max() <= 1e-4 * found.targets.sum()
    assert r.min() >= 0


def test_mix_rows_equal_brute_force(spark):
    """Tokens by the library, posteriors document by document, rates replayed in
    Python, copies by the hash; and the same rows however they are dealt."""
    import tokenizers

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    library, model, counter = tokenizers.Tokenizer.from_file(VOCABULARY), soft_mix.train(docs, labels, VOCABULARY), token_counter(VOCABULARY)
    got = {r.doc_id: r for r in queries()["op7_soft_mix"](spark, "/root/testdata/sf0.001").collect()}
    fit = soft_mix.fit_rates(soft_mix.memberships(docs, model, VOCABULARY))
    known = {r.doc_id: 1 if r.toxic else 0 if r.quality else 2 for r in labels.collect()}
    assert np.mean([np.argmax(got[i].posterior) == k for i, k in known.items() if i in got]) > 0.9
    for r in docs.collect():
        g, text = got[r.doc_id], r.text or ""
        assert g.tokens == len(library.encode(text, add_special_tokens=False).ids)
        ((inputs, values),) = soft_mix.profile([text], counter).rows()
        pieces = {m.group().encode().lower().removeprefix(b" ") for m in regex.finditer(CUTTER_PATTERN, text)}
        assert len(inputs) - len(soft_mix.STATISTICS) <= len(pieces) and (len(text) > 3000 or len(inputs) - len(soft_mix.STATISTICS) >= 0.98 * len(pieces) - 1)
        z = model.bias + (model.weights[inputs] * values[:, None]).sum(axis=0)
        assert np.allclose(g.posterior, np.exp(z) / np.exp(z).sum(), atol=1e-5)
        rate = max(0.0, 1 - float(np.dot(g.posterior, fit.steps))) if g.tokens else 1.0
        h = xxhash.xxh64_intdigest(b"copies", seed=xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), seed=42))
        assert abs(g.rate - rate) < 1e-9 and g.copies == int(rate) + ((h >> 11) / (1 << 53) < g.rate - int(g.rate))
    total = sum(r.rate * r.tokens * np.array(r.posterior) for r in got.values())
    assert np.abs(total - fit.targets).max() / fit.targets.sum() <= next(iter(got.values())).residual + 1e-9
    other = soft_mix.mix(docs.repartition(7, "text"), labels.repartition(3), VOCABULARY)
    assert {r.doc_id: (r.rate, r.copies) for r in other.collect()} == {i: (r.rate, r.copies) for i, r in got.items()}


def nearest_rates(tokens, p, targets):
    """Brute force: of all rates of 0 or more that meet the targets, the nearest to
    1 by tokens, by projecting onto the targets and onto r >= 0 in turn (Dykstra)."""
    a = tokens[:, None] * p
    inverse = np.linalg.inv(a.T @ p)
    r, back = np.ones(len(tokens)), np.zeros(len(tokens))
    for _ in range(20_000):
        onto = r - p @ (inverse @ (a.T @ r - targets))
        r = np.maximum(0, onto + back)
        back = onto + back - r
    return r


def nonnegative_least_squares(a, targets):
    """Brute force: the least sum of squares, by accelerated projected gradient."""
    size = 1 / np.linalg.norm(a, 2) ** 2
    r = z = np.ones(len(a))
    t = 1.0
    for _ in range(40_000):
        new = np.maximum(0, z - size * (a @ (a.T @ z - targets)))
        again = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, r, t = new + (t - 1) / again * (new - r), new, again
    return float(((a.T @ r - targets) ** 2).sum())


@pytest.mark.parametrize("poor", [False, True])
def test_rates_are_the_nearest_and_unreachable_domains_left_alone(spark, poor):
    rng = np.random.default_rng(8)
    tokens = rng.integers(1, 900, 120).astype(float)
    p = rng.dirichlet([6, 1, 1e-4] if poor else [4, 2, 1], 120)
    if poor:
        p = p * [1, 1, 0] + [0, 0, 0.01]
        p /= p.sum(axis=1, keepdims=True)
    members = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p, strict=True)], "tokens long, posterior array<double>")
    weights = (0.92, 0.02, 0.06) if poor else (0.72, 0.11, 0.17)
    found = soft_mix.fit_rates(members, weights, tolerance=1e-7)
    a = tokens[:, None] * p
    own = a.sum(axis=0)
    assert found.unreached == ([2] if poor else [])
    targets = np.array(weights) * own[0] / weights[0]
    assert np.allclose(found.targets, targets)
    fitted = found.fitted
    got = np.array([x.r for x in members.select(found.rate(F.col("tokens"), F.col("posterior")).alias("r")).collect()])
    assert np.abs(a.T @ got - targets)[fitted].max() <= 1e-6 * own.sum()
    assert np.allclose(got, nearest_rates(tokens, p[:, fitted], targets[fitted]), atol=2e-3)
    assert (poor or (got == 0).any()) and got.max() <= found.highest()
    misses = lambda r: ((a.T @ r - targets) ** 2)
    assert misses(got).sum() <= misses(np.ones(len(a))).sum()
    least = nonnegative_least_squares(a[:, fitted] / own.sum(), targets[fitted] / own.sum())
    assert misses(got)[fitted].sum() / own.sum() ** 2 <= least + 1e-9


def test_real_rows_with_an_unreachable_domain(spark):
    """What the quality classifier keeps has no poor tokens to speak of: the domain
    is left alone, and no document goes for it."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    good = fm_quality.keep_good(docs, fm_quality.train(docs, labels), threshold=0.3)
    members = soft_mix.memberships(good, soft_mix.train(good, labels, VOCABULARY), VOCABULARY).cache()
    fit = soft_mix.fit_rates(members, repeats=5)
    assert fit.unreached == [2]
    assert np.abs(fit.totals - fit.targets)[:2].max() <= soft_mix.TOLERANCE * fit.targets.sum()
    rate = fit.rate(F.col("tokens"), F.col("posterior"))
    none, most = members.agg(F.count_if((F.col("tokens") > 0) & (rate == 0)), F.max(rate)).head()
    assert none == 0 and most <= fit.highest() < 5


def test_no_labels_and_many_copies(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = soft_mix.mix(documents([(1, "a b"), (2, "c d e")]), none, VOCABULARY).collect()
    assert [(r.rate, r.copies, r.unreached) for r in rows] == [(1.0, 1, "good,toxic,poor")] * 2
    table = spark.createDataFrame([(1, "x", 1), (2, "y", 200), (3, "z", 65)], "doc_id long, text string, n int")
    for highest in (10, 500):
        got = soft_mix._repeated(table, "n", highest).groupBy("doc_id").count().collect()
        assert {r.doc_id: r["count"] for r in got} == {1: 1, 2: 200, 3: 65}


def test_mix_edges(documents, odd_texts, spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    rows = soft_mix.mix(documents(odd_texts), labels, VOCABULARY).collect()
    assert len(rows) == len(odd_texts)
    assert all(r.rate == 1.0 and r.copies == 1 for r in rows if not r.tokens)
    assert all(abs(sum(r.posterior) - 1) < 1e-9 and r.rate >= 0 for r in rows)
    docs = documents([(1, "a b"), (1, "a b"), (None, "c")])
    out = soft_mix.mixed_documents(docs, labels, VOCABULARY, (0.96, 0.04, None))
    assert out.columns == docs.columns
    assert soft_mix.mixed_documents(documents([]), labels, VOCABULARY).count() == 0


def test_copies_average_to_the_rate(spark):
    n = spark.range(20_000).agg(F.avg(soft_mix.copies(F.lit(1.3), F.col("id"))).alias("m")).head().m
    assert abs(n - 1.3) < 0.02
