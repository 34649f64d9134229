"""Token ids on disk in Simple-8b: 64-bit words whose top four bits select how
many ids of which width the other sixty hold.

File ``part-PPPPP-FFFFF.s8b`` (little-endian)::

    8 bytes  magic "S8BTOK01"
    int64    documents, ids, ids of a block, blocks, words
    int64[]  doc_id of each document            (0 where null)
    uint8[]  1 where doc_id is null, padded to 8 bytes
    int64[]  number of ids of each document
    int64[]  first word of each block, and the number of words
    uint64[] words
    uint32   crc32 of the words

Blocks hold a fixed number of ids, and a word never crosses a block, so that
blocks are packed in lockstep and decoded independently. Ids wider than any
packed selector escape into a word of their own (selector 0).
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workrisk.llm.common import PieceCache, bounded_batches, id_text, only, work_dir, worker_cache, written
from workrisk.llm.count_transducer import CUTTER_PATTERN
from workrisk.llm.piece_table import PieceTable

MAGIC = b"S8BTOK01"
BLOCK = 256
BLOCKS_AT_ONCE = 2048
#: Bits of an id by selector, from 1 on; a word holds 60 // bits of them.
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30)
COUNTS = tuple(60 // w for w in WIDTHS)
ESCAPE = 0
#: Ids of one file, at most one document more.
FILE_IDS = 2_000_000


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of each block (with the total at the end); a
    bounded number of blocks at a time."""
    size = block * BLOCKS_AT_ONCE
    parts = [_pack(ids[at : at + size], block) for at in range(0, len(ids), size)] or [_pack(ids, block)]
    totals = np.cumsum([0, *(offsets[-1] for _, offsets in parts)])
    return np.concatenate([w for w, _ in parts]), np.concatenate([*(o[:-1] + t for (_, o), t in zip(parts, totals, strict=False)), totals[-1:]]).astype(np.int64)


def _pack(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids)
    blocks = -(-n // block)
    values = np.zeros(blocks * block, dtype=np.uint64)
    values[:n] = ids
    if n and int(values.max()) >> 60:
        raise ValueError("ids must be below 2**60")
    # smallest selector index that fits each id; len(WIDTHS): only an escape
    need = np.searchsorted(np.array([(1 << w) - 1 for w in WIDTHS], dtype=np.uint64), values).astype(np.int8)
    need[n:] = 0
    need = need.reshape(blocks, block)
    powers = {1: need}
    size = 1
    while 2 * size <= max(COUNTS):
        wider = powers[size].copy()
        wider[:, :-size] = np.maximum(wider[:, :-size], powers[size][:, size:]) if size < block else wider[:, :-size]
        powers[2 * size] = wider
        size *= 2
    best = np.full(need.shape, len(WIDTHS), dtype=np.int8)
    for index in reversed(range(len(WIDTHS))):  # the narrowest that fits holds the most
        count = COUNTS[index]
        p = 1 << (count.bit_length() - 1)
        most = powers[p].copy()
        shift = count - p
        if shift:
            most[:, :-shift] = np.maximum(most[:, :-shift], powers[p][:, shift:])
        best[most <= index] = index
    best = best.ravel()
    step = np.array([*COUNTS, 1])[best]
    starts = np.zeros(blocks * block, dtype=bool)
    at = np.arange(blocks, dtype=np.int64) * block
    ends = np.minimum(at + block, n)
    while len(at):
        starts[at] = True
        at = at + step[at]
        live = at < ends
        at, ends = at[live], ends[live]
    first = np.flatnonzero(starts)
    words = np.zeros(len(first), dtype=np.uint64)
    chosen = best[first]
    padded = np.concatenate([values, np.zeros(64, dtype=np.uint64)])
    for index in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == index)
        if index == len(WIDTHS):
            words[mine] = values[first[mine]]
            continue
        width, here = WIDTHS[index], first[mine]
        left = np.minimum((here // block + 1) * block, n) - here
        got = np.full(len(mine), (index + 1) << 60, dtype=np.uint64)
        for j in range(COUNTS[index]):
            got |= np.where(j < left, padded[here + j], 0).astype(np.uint64) << np.uint64(width * j)
        words[mine] = got
    offsets = np.zeros(blocks + 1, dtype=np.int64)
    np.cumsum(starts.reshape(blocks, block).sum(axis=1), out=offsets[1:])
    return words, offsets


def unpack(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ids of all blocks, of a bounded number of blocks at a time."""
    out = np.zeros(n, dtype=np.uint64)
    for first in range(0, len(offsets) - 1, BLOCKS_AT_ONCE):
        own = offsets[first : first + BLOCKS_AT_ONCE + 1]
        at = first * block
        held = min(n - at, (len(own) - 1) * block)
        out[at : at + held] = _unpack(words[own[0] : own[-1]], own - own[0], held, block)
    return out


def _unpack(words: np.ndarray, offsets: np.ndarray, n: int, block: int) -> np.ndarray:
    """Every selector's words at once."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([1, *COUNTS, 0, 0])[selector]
    # a block's last word may hold fewer: its end is the next block's start
    block_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    before = np.cumsum(counts) - counts
    base = before[offsets[:-1]] if len(words) else before
    place = block_of * block + before - base[block_of] if len(words) else before
    held = np.minimum(counts, np.minimum((block_of + 1) * block, n) - place)
    out = np.zeros(n, dtype=np.uint64)
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[place[mine]] = words[mine] & np.uint64((1 << 60) - 1)
            continue
        width = WIDTHS[s - 1]
        mask = np.uint64((1 << width) - 1)
        for j in range(COUNTS[s - 1]):
            some = mine[held[mine] > j]
            out[place[some] + j] = (words[some] >> np.uint64(width * j)) & mask
    return out


def to_bytes(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    words, offsets = pack(ids, block)
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    body = words.astype("<u8").tobytes()
    return b"".join([
        MAGIC, struct.pack("<5q", len(doc_ids), len(ids), block, len(offsets) - 1, len(words)),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), null.tobytes() + bytes(-len(null) % 8),
        lengths.astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), body, struct.pack("<I", zlib.crc32(body)),
    ])


def from_bytes(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, number of ids of each, all ids."""
    if raw[:8] != MAGIC:
        raise ValueError("not a Simple-8b token file")
    docs, n, block, blocks, n_words = struct.unpack_from("<5q", raw, 8)
    at = 48

    def take(kind: str, count: int, pad: int = 0) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, dtype=kind, count=count, offset=at)
        at += out.nbytes + pad
        return out

    doc_ids, null = take("<i8", docs), take("u1", docs, -docs % 8)
    lengths, offsets = take("<i8", docs), take("<i8", blocks + 1)
    start = at
    words = take("<u8", n_words)
    if zlib.crc32(raw[start:at]) != int(take("<u4", 1)[0]):
        raise ValueError("the words of a token file are damaged")
    return [None if x else int(d) for d, x in zip(doc_ids, null, strict=True)], lengths, unpack(words, offsets, n, block)


class LibraryEncoder:
    """Whole texts as the tokenizers library encodes them.

    Where the tokenizer is plain byte-level BPE over regex pieces, each distinct
    piece is encoded once and remembered; any other tokenizer gets whole texts.
    """

    def __init__(self, vocabulary: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        spec = json.loads(self.library.to_str())
        cut, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        self.plain = not spec["normalizer"] and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        self.plain = self.plain and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        self.added = {t["content"]: np.array([t["id"]], dtype="<i4").tobytes() for t in added}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        special = [t for t in added if t["special"]]
        self.mark, self.mark_id = (special[0]["content"], special[0]["id"]) if special else ("", -1)
        found = regex.compile(pattern)
        own = pattern == CUTTER_PATTERN
        self.cache = PieceTable(self._encode_many) if own else PieceCache(found.findall, found.finditer, self._encode_many)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_many(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece. Many pieces go in one call, kept apart by a special
        token, which always is a token of its own."""
        if not self.mark:
            return self._whole(pieces)
        groups = [pieces[at : at + 1000] for at in range(0, len(pieces), 1000)]
        out: list = []
        for ids in self._whole([self.mark.join(g) for g in groups]):
            flat = np.array([*ids, self.mark_id])
            ends = np.flatnonzero(flat == self.mark_id)
            out += [ids[a:b] for a, b in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True)]
        return out

    def ids_many(self, texts: list[str]) -> list[bytes]:
        if not self.plain:
            return [np.asarray(ids, dtype="<i4").tobytes() for ids in self._whole(texts)]
        if not self.split or not any(map(self.split.search, texts)):
            return self.cache.ids_many(texts)
        out = []
        for text in texts:
            between = self.cache.ids_many(self.split.split(text))
            special = [self.added[s] for s in self.split.findall(text)]
            out.append(b"".join(chain.from_iterable(zip(between, [*special, b""], strict=True))))
        return out


@worker_cache
def library_encoder(vocabulary: str, pattern: str) -> LibraryEncoder:
    return LibraryEncoder(vocabulary, pattern)


def open_folder(uri: str):
    """A pyarrow filesystem and the folder's path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, vocabulary: str, pattern: str, end_id: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode all texts and write them under ``folder`` in ascending doc_id order.

    Returns the manifest: part, file, path, n_docs, n_ids; files in the order of
    (part, file) hold the documents in order. Documents are dealt by ranges of
    doc_id (ties and nulls by the text's hash; nulls first), so one id cannot
    fill a task. A file is written under another name and moved into place,
    which makes a repeated task harmless. A null or empty text has only the end
    id. Columns other than doc_id and text are not read; an empty table writes
    no file.
    """
    bounded_batches(docs.sparkSession)
    filesystem, base = open_folder(folder)
    filesystem.create_dir(base, recursive=True)
    end = np.array([end_id], dtype="<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        only(library_encoder)
        encoder = library_encoder(vocabulary, pattern)
        store, top = open_folder(folder)
        manifest, doc_ids, encoded, size = [], [], [], 0

        def flush() -> None:
            nonlocal size
            name = f"part-{part:05d}-{len(manifest):05d}.s8b"
            ids = np.frombuffer(b"".join(encoded), dtype="<i4").astype(np.uint64)
            lengths = np.array([len(x) // 4 for x in encoded], dtype=np.int64)
            held = f"{top}/_{name}.{attempt}"
            with store.open_output_stream(held) as out:
                out.write(to_bytes(doc_ids, lengths, ids))
            store.move(held, f"{top}/{name}")
            manifest.append((part, len(manifest), f"{folder}/{name}", len(doc_ids), len(ids)))
            doc_ids.clear()
            encoded.clear()
            size = 0

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.ids_many(batch.column(1).to_pylist()), strict=True):
                doc_ids.append(doc_id)
                encoded.append(ids + end)
                size += len(encoded[-1]) // 4
                if size >= file_ids:
                    flush()
        if encoded:
            flush()
        if manifest:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*manifest, strict=True)], ["part", "file", "path", "n_docs", "n_ids"])

    # rows alike in both are interchangeable, so that a place of their own may part them
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("place")]
    placed = id_text(docs).withColumn("place", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("place")
    return written(ordered.mapInArrow(run, "part long, file long, path string, n_docs long, n_ids long"), "manifest")


def read(manifest: DataFrame, folder: str, doc_id_type: T.DataType) -> DataFrame:
    """doc_id, start, n_tokens, ids (array<int>) of every document in the files,
    start being the number of ids of all documents before it. The files are read
    with Spark's own binary reader, whatever store they are in."""
    spark = manifest.sparkSession
    bounded_batches(spark)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    # one row a part here; within a part one row a file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.join(parts, "part").select(
        F.substring_index("path", "/", -1).alias("name"),
        (F.col("part_start") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("file_start"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["name", "doc_id", "local_start", "n_tokens", "ids_crc32", "ids"]
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                doc_ids, lengths, ids = from_bytes(content.as_buffer().to_pybytes())
                ends = np.cumsum(lengths)
                small = ids.astype("<i4")
                for at in range(0, len(doc_ids), 500):
                    low, high = ends[at] - lengths[at], ends[min(at + 500, len(ends)) - 1]
                    part = slice(at, at + 500)
                    offsets = np.append(ends[part] - lengths[part], high) - low
                    crc = [zlib.crc32(small[e - k : e].tobytes()) for e, k in zip(ends[part], lengths[part], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name.as_py()] * len(crc)), pa.array(doc_ids[part], pa.int64()), pa.array(ends[part] - lengths[part]), pa.array(lengths[part]), pa.array(crc, pa.int64()),
                         pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(small[low:high]))],
                        names,
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder)
    found = files.select(F.substring_index("path", "/", -1).alias("name"), "content")
    rows = found.mapInArrow(run, "name string, doc_id long, local_start long, n_tokens long, ids_crc32 long, ids array<int>")
    return rows.join(starts, "name").select(
        F.col("doc_id").cast(doc_id_type).alias("doc_id"), (F.col("file_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, end_id: int = 0) -> DataFrame:
    """Write all documents' ids, then read the files back."""
    folder = work_dir(docs.sparkSession, "tokens")
    manifest = write(docs, folder, vocabulary, pattern, end_id)
    return read(manifest, folder, docs.schema["doc_id"].dataType)
