"""Trained operators do the whole job, however their sample is dealt."""

import logging

import corpus_pipeline

from workrisk.llm import soft_mix, toxicity


def test_stems_do_not_depend_on_partitions(spark):
    ends = ("ton", "ish", "ard", "ers")
    rows = [(k, f"grobble{ends[k % 4]} here now" if k % 3 == 0 else "plain words here now", int(k % 3 == 0)) for k in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = table.select("doc_id", "text"), table.select("doc_id", "toxic")
    one, many = (toxicity.train(docs.repartition(n, "doc_id"), labels).lexicon.entries for n in (1, 60))
    assert one == many and any(stem for _, stem, _ in many)


def test_rare_domain_reaches_its_target_and_misses_are_reported(spark, monkeypatch, caplog):
    assert None not in corpus_pipeline.MIX_WEIGHTS
    rows = [(100, [0.98, 0.01, 0.01])] * 95 + [(100, [0.05, 0.9, 0.05])] * 4 + [(100, [0.05, 0.05, 0.9])]
    kind = "tokens long, posterior array<double>"
    found = soft_mix.fit_rates(spark.createDataFrame(rows, kind))
    assert found.residual <= soft_mix.TOLERANCE
    out_of_reach = spark.createDataFrame([(1, 100, [0.97, 0.02, 0.01]), (2, 100, [0.5, 0.49, 0.01])], f"doc_id long, {kind}")
    monkeypatch.setattr(soft_mix, "train", lambda *a: None)
    monkeypatch.setattr(soft_mix, "memberships", lambda *a: out_of_reach)
    with caplog.at_level(logging.WARNING):
        found = soft_mix.mix(out_of_reach, out_of_reach, "").collect()
    assert "misses its targets" in caplog.text and all(r.residual > soft_mix.TOLERANCE for r in found)


def test_long_words_are_matched():
    matcher = toxicity.Matcher(toxicity.Lexicon([("idiot", True, 1.0)]))
    word = "idiot_" * 20
    assert matcher.match(word) == (0, 0) and matcher.hits({word, "x" * 99}) == {word}
    assert word not in matcher.found and toxicity.features(word, matcher)[toxicity.FEATURES.index("stems")] > 0
