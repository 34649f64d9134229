"""Byte-level BPE encoding and decoding through a sentencepiece model that is
serialised directly from a rank vocabulary.

Every token's bytes are mapped to printable characters (one character a byte),
each becomes a piece whose score is its negative rank, and normalisation is the
identity; sentencepiece's merge loop then takes the lowest rank first, leftmost
on ties, which is byte-level BPE. Texts are cut into pre-tokens, each encoded
separately; decoding maps ids back to bytes by table lookup.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workrisk.llm.common import PieceCache, bounded_batches, field_ddl, id_text, list_array, only, worker_cache

#: Field values of the sentencepiece model format (public protobuf schema).
NORMAL, UNKNOWN, UNUSED, BPE = 1, 2, 5, 2


def byte_characters() -> list[str]:
    """One visible character for each byte: printable Latin-1 bytes stand for
    themselves, the others for code points from 256 on, in byte order."""
    visible = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE}
    others = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes_field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The vocabulary as a sentencepiece model. Piece n is the token of rank n;
    gaps get unused placeholders, the unknown piece comes last."""
    chars = byte_characters()
    by_rank = {rank: token for token, rank in ranks.items()}
    size = max(by_rank, default=-1) + 1
    out = bytearray()

    def piece(text: str, score: float, kind: int) -> None:
        body = _bytes_field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _int_field(3, kind)
        out.extend(_bytes_field(1, body))

    for rank in range(size):
        token = by_rank.get(rank)
        if token is None:
            piece(f"<gap{rank}>", 0.0, UNUSED)
        else:
            piece("".join(chars[b] for b in token), -float(rank), NORMAL)
    piece("<unk>", 0.0, UNKNOWN)
    trainer = _int_field(3, BPE) + _int_field(4, size + 1) + _int_field(40, size)
    trainer += b"".join(_int_field(n, -1) for n in (41, 42, 43))  # no begin, end or padding piece
    normaliser = _bytes_field(1, b"identity") + b"".join(_int_field(n, 0) for n in (3, 4, 5))
    return bytes(out + _bytes_field(2, trainer) + _bytes_field(3, normaliser))


class Codec:
    """Encoder and decoder of one vocabulary; pattern cuts a text into pre-tokens."""

    def __init__(self, vocabulary: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(vocabulary)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        chars = byte_characters()
        whole = ["".join(chars[b] for b in token) for token in self.ranks]
        if self.model.encode(whole, num_threads=1) != [[rank] for rank in self.ranks.values()]:
            raise ValueError("a token of the vocabulary can't be reached by merges")
        self._to_chars = str.maketrans(dict(enumerate(chars)))
        found = regex.compile(pattern)
        self.cache = PieceCache(found.findall, found.finditer, self._encode_many)
        tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self._lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self._starts = np.concatenate([[0], np.cumsum(self._lengths)])
        self._bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def _encode_many(self, pieces: list[str]) -> list[list[int]]:
        mapped = [p.encode().decode("latin-1").translate(self._to_chars) for p in pieces]
        return self.model.encode(mapped, num_threads=1) if mapped else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian int32 bytes."""
        return self.cache.ids_many(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that a list of ids stands for."""
        out = []
        for at in range(0, len(ids), 1 << 18):
            part = ids[at : at + (1 << 18)]
            lengths = self._lengths[part]
            ends = np.cumsum(lengths)
            places = np.arange(ends[-1] if len(ends) else 0)
            out.append(self._bytes[places + np.repeat(self._starts[part] - (ends - lengths), lengths)].tobytes())
        return b"".join(out)


@worker_cache
def codec(vocabulary: str, pattern: str) -> Codec:
    """One codec a worker process."""
    return Codec(vocabulary, pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded (binary) for every row of ``docs``.

    Each whole text is encoded and the ids are decoded again. A null or empty
    text has no ids and decodes to no bytes; repeated rows are encoded row by
    row; columns other than doc_id and text are not read; an empty table gives
    an empty result. One pass without a shuffle.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(codec)
        own = codec(vocabulary, pattern)
        for batch in batches:
            ids = own.encode(batch.column(1).to_pylist())
            decoded = [own.decode(np.frombuffer(x, dtype="<i4")) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(ids), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return id_text(docs).mapInArrow(run, f"{field_ddl(docs, 'doc_id')}, ids array<int>, decoded binary")


def digests(encoded: DataFrame, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(["ids"] if keep_ids else []),
    )
