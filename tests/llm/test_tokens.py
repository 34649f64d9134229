"""Encoding, token files and token counts against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from workrisk.llm import bpe_codec, count_transducer, token_store

RANKS = P.path("byte_bpe_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_codec.read_ranks(RANKS), special_tokens={})


def test_codec_equals_tiktoken(spark, documents, odd_texts):
    rows = odd_texts
    got = bpe_codec.digests(bpe_codec.encode(documents(rows), RANKS, P.PATTERN)).collect()
    enc = reference()
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe_codec.encode(documents([]), RANKS, P.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab's tredlmv!\n\t1 "), st.characters(codec="utf-8")), max_size=60))
def test_machines_equal_libraries(text):
    codec = bpe_codec.codec(RANKS, P.PATTERN)
    ids = np.frombuffer(codec.encode([text])[0], dtype="<i4")
    assert ids.tolist() == reference_cache().encode_ordinary(text)
    assert codec.decode(ids) == text.encode()
    want = library().encode(text, add_special_tokens=False).ids
    assert count_transducer.token_counter(JSON).counts([text])[0] == len(want)


_held = {}


def reference_cache():
    return _held.setdefault("r", reference())


def library():
    return _held.setdefault("l", Tokenizer.from_file(JSON))


def test_long_texts_in_pieces(monkeypatch):
    from workrisk.llm import common

    rng = random.Random(1)
    text = "".join(rng.choice(["word", " it's", "\n\n  ", "!!", "é", "12", " "]) for _ in range(4000))
    monkeypatch.setattr(common, "LONG_TEXT", 500)
    monkeypatch.setattr(count_transducer, "SEGMENT", 700)
    codec = bpe_codec.Codec(RANKS, P.PATTERN)
    assert np.frombuffer(codec.encode([text, "x", text])[2], dtype="<i4").tolist() == reference_cache().encode_ordinary(text)
    assert count_transducer.token_counter(JSON).counts([text, "x", text]).tolist() == [len(library().encode(t, add_special_tokens=False).ids) for t in (text, "x", text)]


def test_full_tables_start_anew():
    counter = count_transducer.TokenCounter(JSON)
    counter.counter.limit = 300
    counter.counter.reset()
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(30)]
    assert counter.counts(texts).tolist() == [len(library().encode(t, add_special_tokens=False).ids) for t in texts]


def test_state_maps_compose():
    rng = np.random.default_rng(3)
    maps = rng.integers(0, 8, (37, 8)).astype(np.uint8)
    scanned, state = count_transducer.scan_maps(maps), np.arange(8)
    for k in range(37):
        state = maps[k][state]
        assert (scanned[k] == state).all()


def test_piece_table_in_small_tables_and_parts(monkeypatch):
    from workrisk.llm import piece_table

    assert P.PATTERN == count_transducer.CUTTER_PATTERN
    rng = random.Random(4)
    texts = ["".join(rng.choice(["word", " it's", "\n\n\n", "\n  ", "!!", "é", "12", " ", "🙂", "東京", "x" * 30]) for _ in range(rng.randrange(600))) for _ in range(60)]
    want = [library().encode(t, add_special_tokens=False).ids for t in texts]
    encode = token_store.LibraryEncoder(JSON, P.PATTERN)._encode_many
    for segment, bits in ((1 << 20, 6), (150, 8), (900, 12)):
        monkeypatch.setattr(piece_table, "SEGMENT", segment)
        table = piece_table.PieceTable(encode, bits=bits)
        for _ in range(2):
            assert [np.frombuffer(x, dtype="<i4").tolist() for x in table.ids_many(texts)] == want


def test_counts_query(documents, odd_texts):
    got = count_transducer.count_tokens(documents(odd_texts), JSON, limit=10).collect()
    want = [(i, len((t or "").encode()), n := len(library().encode(t or "", add_special_tokens=False).ids), n > 10) for i, t in odd_texts]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert count_transducer.count_tokens(documents([]), JSON).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_256), st.integers(0, (1 << 60) - 1)), max_size=700))
def test_simple8b_round_trip(ids):
    own = np.array(ids, dtype=np.uint64)
    words, offsets = token_store.pack(own)
    assert token_store.unpack(words, offsets, len(own)).tolist() == ids


def test_token_files(spark, documents, odd_texts):
    rows = [r for r in odd_texts if r[0] is not None]
    got = {}
    for r in token_store.round_trip(documents(rows), JSON, P.PATTERN).collect():
        got.setdefault(r.doc_id, []).append(r)
    start = 0
    for i in sorted(got):
        texts = [t for j, t in rows if j == i]
        ids = library().encode(texts[0] or "", add_special_tokens=False).ids + [0]
        assert len(got[i]) == len(texts)
        for r in sorted(got[i], key=lambda r: r.start):
            assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
            start += len(ids)
    assert token_store.round_trip(documents([]), JSON, P.PATTERN).count() == 0


def test_damaged_file_is_noticed():
    raw = bytearray(token_store.to_bytes([1], np.array([3]), np.array([1, 2, 3], dtype=np.uint64)))
    raw[-6] ^= 1
    try:
        token_store.from_bytes(bytes(raw))
    except ValueError as e:
        assert "damaged" in str(e)
    else:
        raise AssertionError("a damaged file was read")
