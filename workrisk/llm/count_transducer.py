"""Token counts from a byte-level BPE tokenizer compiled into transducers.

Two deterministic machines count a text's tokens without encoding it.

* The *cutter* reads classes of code points (with the look-ahead that the
  pre-token pattern needs folded into the class) and marks where pieces start.
  It has eight states. A text is dealt into chunks; every chunk's map from
  state to state is computed for all chunks at once, a prefix scan composes the
  maps, and with its true entry state each chunk then marks its boundaries.
* The *counter* reads the bytes of a piece; every transition carries the change
  in the number of tokens. A state holds the longest suffix that some token may
  still continue, and for each place in it the last token before that place and
  the relative count. Appending a byte, exactly one token ends the new prefix:
  the one that is compatible with the token before it. States are compiled when
  first reached and shared by all pieces; a full table starts anew.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from workrisk.llm.bpe_codec import byte_characters
from workrisk.llm.common import bounded_batches, field_ddl, id_text, only, worker_cache

# Classes of the cutter's input.
LETTER, NUMBER, OTHER, SPACE_RUN, BLANK_LAST, SPACE_LAST, QUOTE2, QUOTE3, BREAK, STAY = range(10)
# States: what the piece that is being read consists of; JOIN: a blank that the
# next run continues; REST1/REST2: letters left of a contraction.
START, LETTERS, NUMBERS, OTHERS, SPACES, JOIN, REST1, REST2 = range(8)
N_STATES, N_CLASSES = 8, 10
#: Fixed value: the pre-token pattern that the cutter is made for.
CUTTER_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 64
SEGMENT = 1 << 21
#: What a byte adds to its piece's hash: a blank nothing, A-Z what a-z do.
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_FOLDED = np.frombuffer(bytes(range(256)).lower().replace(b" ", b"\0"), dtype=np.uint8).astype(np.uint64)


def cutter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a piece starts here", by state and class."""
    move = np.zeros((N_STATES, N_CLASSES), dtype=np.uint8)
    mark = np.zeros((N_STATES, N_CLASSES), dtype=bool)
    for state in range(N_STATES):
        for kind, run in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS)):
            move[state, kind], mark[state, kind] = run, state not in (run, JOIN)
        move[state, SPACE_RUN], mark[state, SPACE_RUN] = SPACES, state != SPACES
        move[state, BLANK_LAST], mark[state, BLANK_LAST] = JOIN, True
        move[state, SPACE_LAST], mark[state, SPACE_LAST] = START, True
        for kind, rest in ((QUOTE2, REST1), (QUOTE3, REST2)):
            inside = state in (OTHERS, JOIN)  # a run of other characters goes on
            move[state, kind], mark[state, kind] = (OTHERS, False) if inside else (rest, True)
        move[state, STAY] = state
    move[REST1, LETTER], mark[REST1, LETTER] = START, False
    move[REST2, LETTER], mark[REST2, LETTER] = REST1, False
    return move, mark


@functools.lru_cache(maxsize=1)
def point_classes() -> np.ndarray:
    """The class of every code point without look-ahead; white space: SPACE_RUN."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE_RUN)):
        for m in regex.finditer(pattern, every):
            kinds[ord(m.group()[0]) : ord(m.group()[-1]) + 1] = kind
    return kinds


def with_look_ahead(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Classes in which white space knows whether more follows, and an
    apostrophe whether a contraction does. BREAK stands between texts."""
    out = classes.copy()
    after = np.append(classes[1:], BREAK)
    last = (classes == SPACE_RUN) & (after != SPACE_RUN) & (after != BREAK)
    out[last] = np.where(points[last] == 0x20, BLANK_LAST, SPACE_LAST)
    quotes = np.flatnonzero((points == 0x27) & (classes == OTHER))
    if len(quotes):
        padded = np.append(points, [0, 0])
        one, two = padded[quotes + 1], padded[quotes + 2]
        out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE2
        pairs = [(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")]
        out[quotes[np.logical_or.reduce(pairs)]] = QUOTE3
    return out


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps under composition, by doubling: row
    k becomes "all maps up to k, first to last"."""
    maps, reach = maps.copy(), 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
        reach *= 2
    return maps


class Cutter:
    def __init__(self) -> None:
        self.move, self.mark = cutter_tables()
        four = np.indices((N_CLASSES,) * 4).reshape(4, -1)
        steps = np.tile(np.arange(N_STATES, dtype=np.uint8)[:, None], (1, N_CLASSES**4))
        for kinds in four:
            steps = self.move[steps, kinds]
        self.move4 = steps.ravel()  # four classes at once

    def starts(self, classes: np.ndarray, entry: int = START) -> np.ndarray:
        """Where pieces start, in classes that with_look_ahead() made."""
        n = len(classes)
        dealt = np.full(-(-n // CHUNK) * CHUNK, STAY, dtype=np.uint8)
        dealt[:n] = classes
        dealt = dealt.reshape(-1, CHUNK)
        quads = dealt.reshape(len(dealt), CHUNK // 4, 4).astype(np.intp) @ np.array([1000, 100, 10, 1])
        maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (len(dealt), 1))
        for k in range(CHUNK // 4):
            maps = self.move4[maps * np.intp(N_CLASSES**4) + quads[:, k, None]]
        states = np.empty(len(dealt), dtype=np.intp)
        states[:1] = entry
        states[1:] = scan_maps(maps)[:-1, entry]
        flags = np.empty(dealt.shape, dtype=bool)
        move, mark = self.move.ravel(), self.mark.ravel()
        for k in range(CHUNK):
            at = states * N_CLASSES + dealt[:, k]
            flags[:, k] = mark[at]
            states = move[at].astype(np.intp)
        return flags.ravel()[:n]


class Transitions:
    """(state, byte) -> next state and gain: an open-addressed table in arrays,
    looked up for many keys at once."""

    def __init__(self, size: int):
        self.bits = max(4, (size - 1).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=np.int64)  # no key is 0
        self.move = np.zeros(1 << self.bits, dtype=np.int32)
        self.gain = np.zeros(1 << self.bits, dtype=np.int16)

    def put(self, key: int, move: int, gain: int) -> None:
        at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - self.bits
        while self.keys[at] and self.keys[at] != key:
            at = at + 1 & (1 << self.bits) - 1
        self.keys[at], self.move[at], self.gain[at] = key, move, gain

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states (0: not there) and gains."""
        at = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[at]
        wrong = np.flatnonzero(there != keys)
        while len(wrong):
            wrong = wrong[there[wrong] != 0]
            at[wrong] = at[wrong] + 1 & (1 << self.bits) - 1
            there[wrong] = self.keys[at[wrong]]
            wrong = wrong[there[wrong] != keys[wrong]]
        return np.where(there != 0, self.move[at], 0), np.where(there != 0, self.gain[at], 0)


class Counter:
    """The compiled counter; ``merges`` are pairs of byte strings in their order."""

    def __init__(self, merges: list[tuple[bytes, bytes]], limit: int = 1 << 18):
        self.tokens = [bytes([b]) for b in range(256)]
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.number = {t: n for n, t in enumerate(self.tokens)}
        self.joined: dict[tuple[int, int], int] = {}
        for left, right in merges:
            pair = self.number[left], self.number[right]
            if left + right in self.number:
                raise ValueError("two merges make the same token")
            self.joined[pair] = self.number[left + right] = len(self.tokens)
            self.tokens.append(left + right)
            self.halves.append(pair)
        self.prefixes = {p: p for p in {t[:k] for t in self.tokens for k in range(len(t))}}
        self.limit = limit
        self.fits = functools.lru_cache(maxsize=1 << 18)(self._fits)
        self.reset()

    def reset(self) -> None:
        # a state is known by its places: the bytes since then, which a token may
        # continue, the last token before (-1: none), and the count there less the
        # count now. State 0 stands for "not compiled", 1 for the start of a piece.
        self.table = Transitions(4 * self.limit)
        self.keys: list = [None]
        self.found: dict = {}
        self.state(((b"", -1, 0),))

    def state(self, key) -> int:
        out = self.found.get(key)
        if out is None:
            out = self.found[key] = len(self.keys)
            self.keys.append(key)
        return out

    def _fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes meet: undo
        merges, latest first, and see if an earlier one would have joined the
        parts on both sides of the boundary."""
        before = 1 << 62
        while True:
            made = self.joined.get((left, right))
            if made is not None and made < before:
                return False
            if left > right and left >= 256 or right < 256 <= left:
                before, left = left, self.halves[left][1]
            elif right >= 256:
                before, right = right + 1, self.halves[right][0]
            else:
                return True

    def compile(self, state: int, byte: int) -> None:
        letter, made, grown = bytes([byte]), None, []
        for suffix, last, count in self.keys[state]:
            longer = suffix + letter
            if made is None:
                token = self.number.get(longer)
                if token is not None and (last < 0 or self.fits(last, token)):
                    made = token, count + 1
            if (known := self.prefixes.get(longer)) is not None:
                grown.append((known, last, count))
        token, count = made
        places = [(suffix, last, before - count) for suffix, last, before in grown]
        self.table.put(state << 8 | byte, self.state((*places, (b"", token, 0))), count)

    def counts(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
        """Tokens of each piece raw[start : start + length], all pieces in step.
        Fills ``hashes``, where given, with numbers that pieces share which differ
        in the case of A-Z or a blank before them only."""
        out = np.zeros(len(starts), dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        for at in range(0, len(order), self.limit // 4):
            group = order[at : at + self.limit // 4]
            own = None if hashes is None else np.zeros(len(group), dtype=np.uint64)
            out[group] = self._group(raw, starts[group], lengths[group], own)
            if own is not None:
                hashes[group] = own
        return out

    def _group(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray | None) -> np.ndarray:
        """One group, longest first."""
        state, count = np.ones(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        # live[k]: how many pieces have a byte k
        live = len(lengths) - np.cumsum(np.bincount(lengths))[:-1] if len(lengths) else ()
        for k, n in enumerate(live):
            read = raw[starts[:n] + k]
            at = state[:n] << 8 | read
            if hashes is not None:
                hashes[:n] *= _FACTOR
                hashes[:n] += _FOLDED[read]
            moved, gained = self.table.get(at)
            if not moved.all():
                missing = np.unique(at[moved == 0])
                if len(self.keys) + len(missing) > self.limit:
                    seen, back = np.unique(state[:n], return_inverse=True)
                    held = [self.keys[s] for s in seen]
                    self.reset()
                    state[:n] = np.array([self.state(key) for key in held])[back]
                    at = state[:n] << 8 | read
                    missing = np.unique(at)
                for x in missing.tolist():
                    self.compile(x >> 8, x & 255)
                moved, gained = self.table.get(at)
            count[:n] += gained
            state[:n] = moved
        return count


class TokenCounter:
    """Counts of whole texts; special tokens in a text count one each and cut it."""

    def __init__(self, vocabulary: str):
        import regex

        spec = json.load(open(vocabulary, encoding="utf-8"))
        cut, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or cut.get("add_prefix_space"):
            raise ValueError("only byte-level BPE over regex pieces can be compiled")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens with options can't be compiled")
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        raw = lambda s: bytes(to_byte[c] for c in s)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.counter = Counter([(raw(a), raw(b)) for a, b in pairs])
        self.cutter = Cutter()
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), dtype=np.int64)
        for owner, tokens, _ in self.pieces(texts):
            out += np.bincount(owner, tokens, len(texts)).astype(np.int64)
        return out

    def pieces(self, texts: list[str], hashed: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """Of all pieces, in parts: the text that it is of, its tokens, and its hash
        if wanted. Texts go through the machines together, up to a bounded number
        of code points at a time."""
        held: list[str] = []
        owner: list[int] = []
        size = 0
        for n, text in enumerate(texts):
            parts = [text]
            if self.special and (found := self.special.findall(text)):
                yield np.full(len(found), n), np.ones(len(found), dtype=np.int64), np.zeros(len(found), dtype=np.uint64) if hashed else None
                parts = self.special.split(text)
            for part in parts:
                if size + len(part) > SEGMENT and held:
                    yield self._many(held, owner, hashed)
                    held, owner, size = [], [], 0
                if len(part) > SEGMENT:
                    yield from self._long(part, n, hashed)
                else:
                    held.append(part)
                    owner.append(n)
                    size += len(part) + 1
        if held:
            yield self._many(held, owner, hashed)

    def _pieces(self, text: str, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        kinds = point_classes()[points]
        kinds[breaks] = BREAK
        return points, kinds, self.cutter.starts(with_look_ahead(points, kinds))

    def _count(self, text: str, points: np.ndarray, first: np.ndarray, ends: np.ndarray, hashed: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Tokens and hashes of the pieces from code point first to ends."""
        wide = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        place = np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(wide, out=place[1:])
        hashes = np.zeros(len(first), dtype=np.uint64) if hashed else None
        return self.counter.counts(np.frombuffer(text.encode(), dtype=np.uint8), place[first], place[ends] - place[first], hashes), hashes

    def _many(self, texts: list[str], owner: list[int], hashed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        lengths = np.array([len(t) + 1 for t in texts])
        breaks = np.cumsum(lengths) - 1
        text = "\0".join([*texts, ""])
        points, kinds, flags = self._pieces(text, breaks)
        flags[breaks] = True  # a piece ends where its text does
        every = np.flatnonzero(flags)
        ends = np.append(every[1:], len(points))
        real = kinds[every] != BREAK
        first, ends = every[real], ends[real]
        return np.array(owner)[np.searchsorted(breaks, first)], *self._count(text, points, first, ends, hashed)

    def _long(self, text: str, owner: int, hashed: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """A text beyond the bound, in segments that begin where a piece does."""
        at, size = 0, SEGMENT
        while at < len(text):
            part = text[at : at + size]
            points, _, flags = self._pieces(part, np.zeros(0, dtype=np.intp))
            first = np.flatnonzero(flags)
            if at + size < len(text):  # the last marks may hang on what follows
                first = first[first < len(part) - 3]
                if len(first) < 2:
                    size *= 2
                    continue
                ends, first = first[1:], first[:-1]
            else:
                ends = np.append(first[1:], len(part))
            yield np.full(len(first), owner), *self._count(part, points, first, ends, hashed)
            at, size = at + int(ends[-1]), SEGMENT


@worker_cache
def token_counter(vocabulary: str) -> TokenCounter:
    return TokenCounter(vocabulary)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row.

    A null or empty text has no bytes and no tokens. Repeated rows are counted
    row by row; columns other than doc_id and text are not read; an empty table
    gives an empty result. One pass without a shuffle.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(token_counter)
        own = token_counter(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = own.counts(texts)
            sizes = pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_text(docs).mapInArrow(run, f"{field_ddl(docs, 'doc_id')}, n_bytes long, n_tokens long, over_limit boolean")
