"""Ids of distinct pieces in arrays, looked up for all pieces of many texts at once.

The cutter of the token counter marks the pieces; a piece of up to 24 bytes is its
three zero-filled 64-bit words and its length, an exact key of an open-addressed
table. Pieces met for the first time go to the encoder together; longer ones are
kept in a dictionary. A full table starts anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

from workrisk.llm.count_transducer import BREAK, SPACE_RUN, Cutter, point_classes, with_look_ahead

WORDS = 3
#: Code points that are cut at once.
SEGMENT = 1 << 18
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class PieceTable:
    def __init__(self, encode_many: Callable[[list[str]], list], bits: int = 21):
        self.encode_many, self.bits, self.cutter = encode_many, bits, Cutter()
        self.limit = 1 << bits - 1
        self.reset()

    def reset(self) -> None:
        size = 1 << self.bits
        self.keys = np.zeros((WORDS, size), dtype=np.uint64)
        self.sizes = np.zeros(size, dtype=np.int16)  # bytes of the piece; 0: free
        self.first, self.counts = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32)
        self.pool, self.used, self.held = np.zeros(1 << 16, dtype="<i4"), 0, 0
        self.long: dict[bytes, tuple[int, int]] = {}

    def _keys(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The words of pieces; raw has 8 * WORDS spare bytes at its end."""
        eight = np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1))
        out = np.empty((WORDS, len(starts)), dtype=np.uint64)
        for k in range(WORDS):
            left = np.clip(sizes - 8 * k, 0, 8)
            word = eight[starts + 8 * k].view("<u8").ravel()
            keep = np.where(left == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1))
            out[k] = word & keep
        return out

    def _home(self, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        h = sizes.astype(np.uint64) * _ODD[3]
        for k in range(WORDS):
            h = (h ^ keys[k]) * _ODD[k]
            h ^= h >> np.uint64(29)
        return h

    def _find(self, keys: np.ndarray, sizes: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Slots of pieces; -1 where a piece isn't there."""
        mask = np.int64((1 << self.bits) - 1)
        at = (home >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(at))
        while len(todo):
            p = at[todo]
            there = self.sizes[p]
            same = there == sizes[todo]
            for k in range(WORDS):
                same &= self.keys[k, p] == keys[k, todo]
            at[todo[there == 0]] = -1
            todo = todo[~same & (there != 0)]
            at[todo] = at[todo] + 1 & mask
        return at

    def _put(self, keys: np.ndarray, sizes: np.ndarray, home: np.ndarray, first: np.ndarray, counts: np.ndarray) -> None:
        """New distinct pieces, all at once: of those that want a free slot one gets it."""
        mask = np.int64((1 << self.bits) - 1)
        at = (home >> np.uint64(64 - self.bits)).astype(np.int64)
        todo, owner = np.arange(len(at)), np.full(1 << self.bits, -1, dtype=np.int32) if len(at) > 50_000 else None
        while len(todo):
            free = todo[self.sizes[at[todo]] == 0]
            if owner is not None:
                owner[at[free]] = free
                won = free[owner[at[free]] == free]
            else:
                _, index = np.unique(at[free], return_index=True)
                won = free[index]
            p = at[won]
            self.keys[:, p], self.sizes[p], self.first[p], self.counts[p] = keys[:, won], sizes[won], first[won], counts[won]
            rest = np.ones(len(at), dtype=bool)
            rest[won] = False
            todo = todo[rest[todo]]
            at[todo] = at[todo] + 1 & mask

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Their ids go to the pool: first place and number of each."""
        found = self.encode_many(pieces)
        counts = np.fromiter(map(len, found), dtype=np.int32, count=len(found))
        total = int(counts.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), dtype="<i4")])
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), dtype="<i4", count=total)
        first = (self.used + np.cumsum(counts) - counts).astype(np.int32)
        self.used += total
        return first, counts

    def ids_many(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, as int32 bytes."""
        out: list[bytes] = []
        held: list[str] = []
        size = 0
        for text in texts:
            if held and size + len(text) > SEGMENT:
                out += self._ids(held)
                held, size = [], 0
            if len(text) > SEGMENT:
                out.append(b"".join(self._ids([part])[0] for part in self._parts(text)))
                continue
            held.append(text)
            size += len(text) + 1
        return out + self._ids(held)

    def _parts(self, text: str) -> Iterator[str]:
        """A long text in parts that begin where a piece does, not after white
        space, whose cut hangs on what follows."""
        at, size = 0, SEGMENT
        while at < len(text):
            part = text[at : at + size]
            if at + size < len(text):
                points = np.frombuffer(part.encode("utf-32-le"), dtype="<u4")
                kinds = point_classes()[points]
                first = np.flatnonzero(self.cutter.starts(with_look_ahead(points, kinds))[: len(part) - 3])
                first = first[first > 0]
                first = first[kinds[first - 1] != SPACE_RUN]
                if not len(first):
                    size *= 2
                    continue
                part = part[: int(first[-1])]
            yield part
            at, size = at + len(part), SEGMENT

    def _ids(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        breaks = np.cumsum([len(t) + 1 for t in texts]) - 1
        text = "\0".join([*texts, ""])
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        kinds = point_classes()[points]
        kinds[breaks] = BREAK
        flags = self.cutter.starts(with_look_ahead(points, kinds))
        flags[breaks] = True
        every = np.flatnonzero(flags)
        real = kinds[every] != BREAK
        begin, end = every[real], np.append(every[1:], len(points))[real]
        wide = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        place = np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(wide, out=place[1:])
        encoded = text.encode()
        raw = np.frombuffer(encoded + bytes(8 * WORDS + 8), dtype=np.uint8)
        starts, sizes = place[begin], place[end] - place[begin]
        first, counts = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        short = np.flatnonzero(sizes <= 8 * WORDS)
        keys = self._keys(raw, starts[short], sizes[short])
        small = sizes[short].astype(np.int16)
        home = self._home(keys, small)
        slots = self._find(keys, small, home)
        missing = np.flatnonzero(slots < 0)
        while len(missing):
            # pieces with one hash are nearly always one piece; others come in the next round
            _, index = np.unique(home[missing], return_index=True)
            new = missing[index]
            if self.held + len(new) > self.limit or self.used > 1 << 25:
                self.reset()
                missing = np.arange(len(short))
                _, index = np.unique(home, return_index=True)
                new = missing[index]
                while len(new) > self.limit:  # one batch that a whole table can't hold
                    self.bits += 1
                    self.limit = 1 << self.bits - 1
                    self.reset()
            at, n = starts[short[new]].tolist(), small[new].tolist()
            learned = self._learn([encoded[a : a + k].decode() for a, k in zip(at, n, strict=True)])
            self._put(keys[:, new], small[new], home[new], *learned)
            self.held += len(new)
            slots[missing] = self._find(keys[:, missing], small[missing], home[missing])
            missing = missing[slots[missing] < 0]
        first[short], counts[short] = self.first[slots], self.counts[slots]
        over = np.flatnonzero(sizes > 8 * WORDS).tolist()
        if over:
            pieces = [encoded[starts[k] : starts[k] + sizes[k]] for k in over]
            new = [p for p in dict.fromkeys(pieces) if p not in self.long]
            if len(self.long) + len(new) > 50_000:
                self.long, new = {}, list(dict.fromkeys(pieces))
            if new:
                self.long.update(zip(new, zip(*(x.tolist() for x in self._learn([p.decode() for p in new])), strict=True), strict=True))
            first[over], counts[over] = np.array([self.long[p] for p in pieces]).T
        total = np.cumsum(counts)
        where = np.repeat(first - (total - counts), counts) + np.arange(total[-1] if len(total) else 0)
        ids = self.pool[where]
        # pieces before each text's end, so ids before it
        ends = np.concatenate([[0], total])[np.searchsorted(begin, breaks)]
        return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
