"""The pipeline against its stages by other means, on small tables."""

import os

import numpy as np
import pytest

import corpus_pipeline
import public_tokenizers
from workrisk.llm import bpe_codec, fm_quality, hyperminhash, line_quality, soft_mix
from workrisk.llm.queries import oracle_sql, queries


VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").write.parquet(f"{out}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{out}/labels.parquet")
    return out


def test_run_equals_brute_force(spark, folder):
    """The same machine and rates, but rows decided one by one in Python."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    machine, features = fm_quality.train(docs, labels), fm_quality.Features()
    rows = []
    for r in docs.collect():
        if machine.scores(*features.batch([r.text], [r.n_chars]))[0] >= 0.3:
            report = line_quality.judge(r.text, corpus_pipeline.LIMITS)
            if report.kept:
                rows.append((r.doc_id, report.cleaned))
    sets = {i: frozenset(hyperminhash.Shingler().hashes(t).tolist()) for i, t in rows}
    low = {i: i for i in sets}
    for _ in range(20):
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low[a] = min(low[a], low[b])
    rows = [(i, t) for i, t in rows if low[i] == i]
    kept = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    copies = {r.doc_id: r.copies for r in soft_mix.mix(kept, labels, VOCABULARY, corpus_pipeline.MIX_WEIGHTS).collect()}
    codec = bpe_codec.Codec(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken"), corpus_pipeline.public_tokenizers.PATTERN)
    want = sorted((i, np.frombuffer(codec.encode([t])[0], dtype="<i4").tolist()) for i, t in rows for _ in range(copies[i]))
    rows = corpus_pipeline.run(spark, folder).collect()
    got = sorted((r.doc_id, list(r.ids)) for r in rows)
    assert got == want
    (report,) = {(r.residual, r.unreached) for r in soft_mix.mix(kept, labels, VOCABULARY, corpus_pipeline.MIX_WEIGHTS).collect()}
    assert {(r.mix_residual, r.mix_unreached) for r in rows} == {report}
    assert got == sorted((r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, folder).collect())


def test_stages_take_odd_rows(spark, documents, odd_texts, folder):
    docs = documents(odd_texts).select("doc_id", "text", "lang", "source", "n_chars", "kept")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == len(odd_texts)


def test_empty_labels_change_nothing(spark, documents, tmp_path):
    """Without labels every document is as good as any other: none is mixed away."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(k, f"Number {k} is a sentence of its own{k * 7}, and says so{k}.") for k in range(30)]
    documents(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == list(range(30))
    assert {r.mix_unreached for r in out} == {"good,toxic,poor"}


def test_every_operator_is_registered():
    names = sorted(queries())
    assert [n.split("_")[0] for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, 14)]
    assert set(oracle_sql()) <= set(names)
    assert os.path.exists(corpus_pipeline.__file__)
