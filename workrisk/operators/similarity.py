"""Similar descriptions within a block (a district): TF-IDF of character n-grams
inside word bounds, cosine, best partner. Blocks of any size are compared whole.

A block is dealt into tiles of items: a task holds the index of one tile, and what
has to meet the tile passes by it (``alike`` for whole blocks; here for items that
have places). The best of each tile are merged by an aggregate, so no pair becomes a
row and no task holds a block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workrisk.functions.numeric import EARTH_KM, ramp
from workrisk.operators import alike
from workrisk.plans.storage import discard, stored

#: Items of a tile, and n-grams of a block that one row holds.
TILE, CHUNK = 2000, 20_000
#: Of a vector, the heaviest n-grams that leave so much of its norm come first.
REST = 0.5
#: Candidates that are finished one by one.
FEW = 24
#: Similarities count to nine places.
ROOM = 2e-9
#: Items of a group that is compared as one, without cells; items of a tile that
#: share texts.
SMALL = ITEMS = 20_000


def vectors(items: DataFrame, tile: int = TILE) -> DataFrame:
    """``items`` (block, text, n, first and others) with the unit vector of each text:
    grams (64-bit hashes of its n-grams), the heaviest first, and weights. A text that
    n rows share counts n times. Weights are (1 + ln tf) * (ln((1 + N) / (1 + df)) +
    1) with the block's own N and df over rows. An n-gram's df comes to the items in
    rows of CHUNK n-grams, for parts of ``tile`` items of a block."""
    others = [c for c in items.columns if c not in ("block", "text", "n")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                grams, tf = [], []
                for text in part.column(part.schema.get_field_index("text")).to_pylist():
                    c = Counter(_grams(text))
                    if len(known) > 500_000:
                        known.clear()
                    for g in c:
                        if g not in known:
                            known[g] = xxhash.xxh64_intdigest(g)
                    grams.append(np.fromiter((known[g] for g in c), dtype=np.uint64, count=len(c)).view(np.int64))
                    tf.append(np.fromiter(c.values(), dtype=np.int32, count=len(c)))
                rest = [part.column(part.schema.get_field_index(n)) for n in ("block", "n", *others)]
                yield pa.RecordBatch.from_arrays([*rest, alike.listed(grams, pa.int64()), alike.listed(tf, pa.int32())], ["block", "n", *others, "grams", "tf"])

    def ddl(names: list[str]) -> str:
        return ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in names)

    counted = stored(items.mapInArrow(count, f"{ddl(['block', 'n', *others])}, grams array<long>, tf array<int>"))
    known = counted.select("block", "n", F.explode("grams").alias("gram")).groupBy("block", "gram").agg(F.sum("n").alias("df"))
    sizes = counted.groupBy("block").agg(F.sum("n").alias("all"), F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("parts"))
    known = known.withColumn("chunk", F.shiftrightunsigned("gram", 32) % 64)  # then by size
    lists = known.groupBy("block", "chunk").agg(F.collect_list("gram").alias("g"), F.collect_list("df").alias("d"))
    pieces = F.explode(F.sequence(F.lit(0), F.floor((F.size("g") - 1) / CHUNK)))
    lists = lists.withColumn("k", pieces).select("block", F.slice("g", F.col("k") * CHUNK + 1, F.lit(CHUNK)).alias("grams"), F.slice("d", F.col("k") * CHUNK + 1, F.lit(CHUNK)).alias("df"))
    none = [F.lit(None).cast(items.schema[c].dataType).alias(c) for c in others]
    sent = lists.join(sizes, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("block", "part", F.lit(0).alias("role"), "all", "grams", F.col("df").cast("array<long>").alias("x"), *none)
    own = counted.join(sizes, "block").select("block", F.pmod(F.xxhash64("first"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), "all", "grams", F.col("tf").cast("array<long>").alias("x"), *others)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, names, number = None, [], None, None
        out: list[tuple] = []

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            fields = [pa.array(c, k) for c, k in zip(columns[:-2], kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*fields, alike.listed(list(columns[-2]), pa.int64()), alike.listed(list(columns[-1]), pa.float64())], ["block", *others, "grams", "weights"])

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for batch in batches:
                kinds = [batch.schema.field(n).type for n in ("block", *others)]
                yield batch

        kinds: list = []
        for block, part, role, total, grams, x, *rest in alike.rows_of(typed()):
            if (block, part) != at:
                at, held, names = (block, part), [], None
            if not role:
                held.append((grams.copy(), x.copy()))
                continue
            if names is None and held:
                names, number = (np.concatenate(c) for c in zip(*held, strict=True))
                order = np.argsort(names)
                names, number, held = names[order], number[order], []
            w = (1 + np.log(x)) * (np.log((1 + total) / (1 + number[np.searchsorted(names, grams)])) + 1) if len(grams) else np.zeros(0)
            w = w / max(math.sqrt(float(w @ w)), 1e-300)
            order = np.lexsort((grams, -w))
            out.append((block, *rest, grams[order], w[order]))
            if len(out) >= 500:
                yield rows()
        if out:
            yield rows()

    dealt = sent.unionByName(own).repartition("block", "part").sortWithinPartitions("block", "part", "role")
    made = stored(dealt.mapInArrow(weigh, f"{ddl(['block', *others])}, grams array<long>, weights array<double>"))
    discard(counted)
    return made


class Tile:
    """The inverted index of some vectors, in the order of their names."""

    def __init__(self, rows: list[tuple]):
        rows.sort(key=lambda r: r[0])
        self.firsts = [r[0] for r in rows]
        self.place = {f: k for k, f in enumerate(self.firsts)}
        grams = np.concatenate([r[1] for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
        order = np.argsort(grams, kind="stable")
        self.owner, self.weight = owner[order], np.concatenate([r[2] for r in rows])[order]
        self.grams, starts = np.unique(grams[order], return_index=True)
        self.starts = np.append(starts, len(order))
        self.latitude, self.longitude = (np.radians(np.array([np.nan if r[k] is None else r[k] for r in rows], dtype=float)) for k in (3, 4))
        self.seen = 0

    def _add(self, lists: np.ndarray, w: np.ndarray) -> np.ndarray:
        many = self.starts[lists + 1] - self.starts[lists]
        at = np.repeat(self.starts[lists] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        self.seen += len(at)
        return np.bincount(self.owner[at], self.weight[at] * np.repeat(w, many), len(self.firsts))

    def best(self, first, grams: np.ndarray, w: np.ndarray, place: tuple | None, km: float | None) -> tuple | None:
        """(similarity, name) of the most similar other vector that is not too far
        away, the smallest name on ties; None where none has anything in common.

        The heaviest n-grams are looked up first. What the others can add to any
        vector is at most the norm that they leave (both norms are 1); if only few
        vectors can still be best, these alone are finished, else all."""
        there = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        found = self.grams[there] == grams
        lists, own = there[found], w[found]
        if not len(lists):
            return None
        away = np.zeros(len(self.firsts), dtype=bool)
        if first in self.place:
            away[self.place[first]] = True
        if km is not None and place[0] is not None and place[1] is not None:
            lat, lon = math.radians(place[0]), math.radians(place[1])
            a = np.sin((self.latitude - lat) / 2) ** 2 + np.cos(self.latitude) * math.cos(lat) * np.sin((self.longitude - lon) / 2) ** 2
            away |= 2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(a, 0, 1))) > km  # NaN where a place is missing, which isn't far
        left = np.sqrt(np.maximum(np.cumsum((own**2)[::-1])[::-1], 0))
        cut = int(np.searchsorted(-left, -REST))
        score = self._add(lists[:cut], own[:cut])
        score[away] = -1
        if cut < len(lists):
            top = int(score.argmax())
            rest = float(left[cut])
            full = lambda some: self._finish(some, lists[cut:], own[cut:])
            low = score[top] + full(np.array([top]))[0] - ROOM
            some = np.flatnonzero((score >= low - rest) & ~away)
            if len(some) <= FEW:
                done = np.full(len(score), -1.0)
                done[some] = score[some] + full(some)
                score = done
            else:
                score = score + self._add(lists[cut:], own[cut:])
                score[away] = -1
        score = np.round(score, 9)
        top = int(score.argmax())
        return (float(score[top]), self.firsts[top]) if score[top] > 0 else None

    def _finish(self, some: np.ndarray, lists: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What further lists add to a few vectors: looked up in each list, which is
        in the order of its vectors."""
        out = np.zeros(len(some))
        starts, ends = self.starts[lists], self.starts[lists + 1]
        for n, k in enumerate(some.tolist()):
            low, high = starts.copy(), ends.copy()
            while True:  # all lists are halved at once
                open_ = low < high
                if not open_.any():
                    break
                middle = (low + high) // 2
                less = open_ & (self.owner[np.minimum(middle, len(self.owner) - 1)] < k)
                low = np.where(less, middle + 1, low)
                high = np.where(open_ & ~less, middle, high)
            hit = (low < ends) & (self.owner[np.minimum(low, len(self.owner) - 1)] == k)
            out[n] = float(w[hit] @ self.weight[low[hit]])
            self.seen += len(lists)
        return out


class Shared:
    """A tile's texts and the items that share them, in the order of their names."""

    def __init__(self, texts: list[tuple], items: list[tuple]):
        self.texts = Tile(texts)
        items.sort(key=lambda r: r[0])
        self.firsts = [r[0] for r in items]
        self.place = {f: k for k, f in enumerate(self.firsts)}
        self.text = np.array([self.texts.place[r[1]] for r in items])
        self.latitude, self.longitude = (np.radians(np.array([np.nan if r[k] is None else r[k] for r in items], dtype=float)) for k in (2, 3))
        self.cosine = np.cos(self.latitude)

    def scores(self, grams: np.ndarray, w: np.ndarray) -> np.ndarray:
        """How similar a text is to the tile's items, to nine places."""
        own = self.texts
        there = np.minimum(np.searchsorted(own.grams, grams), len(own.grams) - 1) if len(own.grams) else np.zeros(0, dtype=int)
        found = own.grams[there] == grams if len(there) else np.zeros(0, dtype=bool)
        if not found.any():
            return np.zeros(len(self.firsts))
        return np.round(own._add(there[found], w[found]), 9)[self.text]

    def nearest(self, score: np.ndarray, first, lat: float | None, lon: float | None, km: float) -> tuple | None:
        """(similarity, name) of the best other item within km, or without a place."""
        score = score.copy()
        if first in self.place:
            score[self.place[first]] = -1
        if lat is not None and lon is not None:
            y, x = math.radians(lat), math.radians(lon)
            a = np.sin((self.latitude - y) / 2) ** 2 + self.cosine * math.cos(y) * np.sin((self.longitude - x) / 2) ** 2
            score[2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(a, 0, 1))) > km] = -1
        top = int(score.argmax())
        return (float(score[top]), self.firsts[top]) if score[top] > 0 else None


def partners(rows: DataFrame, tile: int | None = None) -> DataFrame:
    """(block, first, partner, similarity): the most similar other item of the
    block, the smallest on ties to nine places; partner null and 0 where no other has
    anything in common, no row where the block has no other.

    ``rows`` are items (block, text, n, first): a text that n rows share, the
    smallest of which is ``first``, which names the item."""
    return _with_rest(rows, alike.best_others(rows, tile))


def _with_rest(rows: DataFrame, found: DataFrame) -> DataFrame:
    shared = rows.groupBy("block").agg(F.count(F.lit(1)).alias("_items")).where("_items > 1").select("block")
    return rows.select("block", "first").join(shared, "block", "left_semi").join(found, ["block", "first"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def _cells(latitude: Column, longitude: Column, km: float) -> tuple[Column, Column]:
    """The cell of a place, and all cells that hold places within ``km`` of it.

    Bands of latitude are km high; a band is cut into as many cells of longitude as
    are km wide where it is narrowest, one where it touches a pole. What lies within
    km is in the band, the one above or below, and there within the widest difference
    of longitude that the distance spans; longitudes go round."""
    high = math.degrees(km / EARTH_KM) * (1 + 1e-9)
    bands = math.ceil(180 / high)
    band = F.least(F.lit(bands - 1), F.greatest(F.lit(0), F.floor((latitude + 90) / high))).cast("int")

    def cells(b: Column) -> Column:
        edge = F.greatest(F.abs(b * high - 90), F.abs((b + 1) * high - 90))
        return F.when(edge >= 90, 1).otherwise(F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge)) / high))).cast("int")

    turned = F.pmod(longitude + 180, F.lit(360.0))

    def name(b: Column, c: Column) -> Column:
        return F.concat(b.cast("string"), F.lit(":"), c.cast("string"))

    own = name(band, F.least(cells(band) - 1, F.floor(turned / 360 * cells(band))).cast("int"))
    reach = math.sin(min(km / EARTH_KM, math.pi / 2))
    cosine = F.cos(F.radians(latitude))
    # beyond that a circle goes round a pole
    span = F.when(cosine > reach, F.degrees(F.asin(F.least(F.lit(1.0), F.lit(reach) / cosine))) * (1 + 1e-9) + 1e-9).otherwise(180.0)

    def within(b: Column) -> Column:
        n = cells(b)
        low, far = F.floor((turned - span) / 360 * n).cast("int"), F.floor((turned + span) / 360 * n).cast("int")
        some = F.sequence(low, F.least(far, low + n - 1))
        return F.when((b >= 0) & (b < bands), F.array_distinct(F.transform(some, lambda c: name(b, F.pmod(c, n))))).otherwise(F.array().cast("array<string>"))

    return own, F.flatten(F.array(within(band - 1), within(band), within(band + 1)))


def partners_nearby(rows: DataFrame, km: float, tile: int = TILE) -> DataFrame:
    """As partners(), for items (block, text, n, first, category, latitude,
    longitude): only items of the same category, and where both have a place no
    farther apart than km, count.

    Each text has one vector, whoever shares it. A category's items meet as one group
    where it is small; those of others meet through the cells of their places, and one
    without a place meets all of its category."""
    texts = stored(rows.groupBy("block", "text").agg(F.sum("n").alias("n"), F.min("first").alias("first")))
    known_texts = vectors(texts, tile).withColumnRenamed("first", "name")
    named = rows.join(texts.select("block", "text", F.col("first").alias("name")), ["block", "text"]).select("block", "first", "name", "category", "latitude", "longitude")
    group = F.concat_ws("|", F.md5(F.col("block").cast("binary")), F.md5(F.col("category").cast("binary")))
    own = named.withColumn("group", group)
    own = stored(own.join(own.groupBy("group").agg(F.count(F.lit(1)).alias("_size")), "group"))
    small = own.where(F.col("_size") <= SMALL).withColumn("home", F.col("group")).withColumn("asks", F.array("group"))
    known = F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & ~F.isnan("latitude") & ~F.isnan("longitude")
    cell, near = _cells(F.col("latitude"), F.col("longitude"), km)
    nowhere = F.lit("none")
    large = own.where(F.col("_size") > SMALL).withColumn("cell", F.when(known, cell).otherwise(nowhere)).withColumn("home", F.concat_ws("|", "group", "cell"))
    # where the items without a place have to look: the cells that a group has
    every = large.select("group", "home").distinct().join(large.where(~known).select("group").distinct(), "group", "left_semi")
    loose = large.where(~known).join(every.withColumnRenamed("home", "ask"), "group").withColumn("asks", F.array("ask")).drop("ask")
    there = F.transform(F.concat(near, F.array(nowhere)), lambda c: F.concat_ws("|", F.col("group"), c))
    placed = large.where(known).withColumn("asks", there)
    home = large.where(~known).withColumn("asks", F.array().cast("array<string>"))  # held once, asking one by one
    columns = ["block", "first", "name", "latitude", "longitude", "home", "asks"]
    asked = loose.withColumn("home", F.lit(None).cast("string"))
    met = reduce(DataFrame.union, [part.select(columns) for part in (small, placed, home, asked)])
    return _with_rest(rows, _best_by_text(met, known_texts, tile, km))


def _best_by_text(rows: DataFrame, texts: DataFrame, tile: int, km: float) -> DataFrame:
    """(block, first, partner, similarity) of rows (block, first, name, latitude,
    longitude, home, asks) that share the vectors of ``texts`` (block, name, grams,
    weights): the best other item among the homes that an item asks, its own included,
    no farther than ``km`` where both have a place. A tile has about ``tile`` texts and
    ITEMS items at most; a text that asks is compared with the tile's texts once, and
    its items look for the best that is near enough."""
    kind, called = (rows.schema[c].dataType.simpleString() for c in ("first", "name"))
    sizes = rows.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / ITEMS).cast("int").alias("_many"), F.ceil(F.count_distinct("name") / tile).cast("int").alias("_wide"))
    columns = ["block", "name", "first", "latitude", "longitude"]
    number = F.pmod(F.xxhash64("first"), F.col("_many")) * F.col("_wide") + F.pmod(F.xxhash64("name", F.lit(1)), F.col("_wide"))
    held = rows.join(sizes, "home").select("home", number.cast("int").alias("tile"), F.lit(1).alias("role"), *columns)
    asking = rows.select(F.explode("asks").alias("home"), *columns).join(sizes, "home")
    asking = asking.select("home", F.explode(F.sequence(F.lit(0), F.col("_many") * F.col("_wide") - 1)).alias("tile"), F.lit(2).alias("role"), *columns)
    items = held.union(asking)
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("grams", "array<bigint>"), ("weights", "array<double>"))]
    place = [F.lit(None).cast(t).alias(c) for c, t in (("first", kind), ("latitude", "double"), ("longitude", "double"))]
    at = ["home", "tile", "role", "name"]
    sent = items.select("block", *at).distinct().join(texts, ["block", "name"]).select(*at, F.lit(0).alias("what"), "block", *place, "grams", "weights")
    sent = sent.union(items.select(*at, F.lit(1).alias("what"), "block", "first", "latitude", "longitude", *empty))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, index, score, out, kinds = None, None, None, [], []

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for batch in batches:
                kinds = [batch.schema.field(n).type for n in ("block", "first", "first")] + [pa.float64()]
                yield batch

        def made() -> pa.RecordBatch:
            found = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(found, ["block", "first", "partner", "similarity"])

        for home, number, role, name, what, block, first, lat, lon, grams, w in alike.rows_of(typed()):
            if (home, number) != here:
                here, index, score = (home, number), None, None
                held_texts: list[tuple] = []
                held_items: list[tuple] = []
            if role == 1:
                if what:
                    held_items.append((first, name, lat, lon))
                else:
                    held_texts.append((name, grams.copy(), w.copy(), None, None))
            elif held_items:
                if index is None:
                    index = Shared(held_texts, held_items)
                if what:
                    best = index.nearest(score, first, lat, lon, km)
                    if best:
                        out.append((block, first, best[1], best[0]))
                        if len(out) >= 2000:
                            yield made()
                else:
                    score = index.scores(grams, w)
        if out:
            yield made()

    dealt = sent.repartition("home", "tile").sortWithinPartitions(*at, "what")
    found = dealt.mapInArrow(run, f"block string, first {kind}, partner {kind}, similarity double")
    top = found.groupBy("block", "first").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "partner")).alias("top"))
    return top.select("block", "first", F.col("top.partner").alias("partner"), (-F.col("top.s")).alias("similarity"))


def best_partner(df: DataFrame, key: str, block: str, text: str, floor: float, most: int | None = None) -> DataFrame:
    """similar_work_id, similarity_score and signal_similarity of every row: the
    most similar other row of the block (smallest id on ties). Rows without a text
    have no signal; rows that were compared with no other have signal 0 and no
    score. Blocks of any size are compared, or those up to ``most`` rows.

    Rows of a block with the same text are one item with a count, and each other's
    partners."""
    code = lambda c: F.unhex(F.sha2(c, 256))  # noqa: E731  texts are joined by their digests
    usable = df.where(F.col(block).isNotNull() & F.col(text).isNotNull()).select(F.col(block).cast("string").alias("block"), F.col(text).alias("text"), F.col(key).alias("id"))
    items = usable.groupBy("block", "text").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    if most:
        sizes = usable.groupBy(F.col("block").alias("_b")).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") <= most)
        items = items.join(sizes, F.col("block") == F.col("_b"), "left_semi")
    items = stored(items)
    names = items.select("block", code("text").alias("code"), "n", "first")
    # the second smallest id of a text that several rows share
    again = usable.select("block", code("text").alias("code"), "id").join(names.where("n > 1").select("block", "code", "first"), ["block", "code"]).where("id > first")
    second = again.groupBy("block", "code").agg(F.min("id").alias("second"))
    met = names.join(partners(items), ["block", "first"], "left").join(second, ["block", "code"], "left")
    met = met.select(F.col("block").alias("_b"), F.col("code").alias("_c"), F.col("first").alias("_first"), F.col("second").alias("_second"), F.col("partner").alias("_other"), F.col("similarity").alias("_s"))
    # stored, so that few texts are known to be few, and many rows needn't travel
    met = stored(met)
    discard(items)
    own = df.withColumns({"_own": F.col(block).cast("string"), "_code": code(text), "_has": F.col(text).isNotNull()})
    out = own.join(met, (F.col("_own") == F.col("_b")) & (F.col("_code") == F.col("_c")), "left")
    twin = F.when(F.col("_second").isNotNull(), F.when(F.col(key) == F.col("_first"), F.col("_second")).otherwise(F.col("_first")))
    best = F.when(twin.isNotNull(), F.lit(1.0)).otherwise(F.col("_s"))
    partner = F.when(twin.isNotNull() & (F.col("_s") >= 1.0), F.least(twin, F.col("_other"))).otherwise(F.coalesce(twin, F.col("_other")))
    return out.withColumns({
        "similarity_score": F.round(best, 3),
        "similar_work_id": F.when(best >= floor, partner),
        "signal_similarity": F.when(F.col("_has"), F.coalesce(ramp(best, floor, 1.0), F.lit(0.0))),
    }).drop("_own", "_code", "_has", "_b", "_c", "_first", "_second", "_other", "_s")


def similarity(works: DataFrame, floor: float = 0.62, most: int | None = None, block: str = "district", text: str = "description_normalised") -> DataFrame:
    """The detector over all works; a text that lost its script isn't compared."""
    readable = F.when(~F.coalesce("description_is_mojibake", F.lit(False)), F.col(text)) if "description_is_mojibake" in works.columns else F.col(text)
    return best_partner(works.withColumn("_text", readable), "work_id", block, "_text", floor, most).drop("_text")


def _grams(text: str) -> list[str]:
    return [g for w in text.split() for g in alike.word_grams(w)]


def similarity_nearby(works: DataFrame, floor: float = 0.55, km: float = 12.0) -> DataFrame:
    """The benchmark's duplicates: the best partner of the same district and
    category, within reach where both works have a place. similar_project_id,
    similarity_score (0 where nothing was compared) and signal_similarity."""
    there = works.where("district IS NOT NULL").select(
        F.col("district").alias("block"), F.lower(F.coalesce("work_description", F.lit(""))).alias("text"), F.lit(1).cast("long").alias("n"), F.col("project_id").alias("first"),
        F.coalesce("work_category", F.lit("nan")).alias("category"), F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"),
    )
    top = partners_nearby(stored(there), km).select(F.col("first").alias("_first"), F.col("partner").alias("_partner"), F.col("similarity").alias("_best"))
    out = works.join(top, F.col("project_id") == F.col("_first"), "left")
    best = F.coalesce("_best", F.lit(0.0))
    return out.withColumns({
        "similarity_score": best,
        "similar_project_id": F.when(best >= floor, F.col("_partner")).otherwise(F.lit("")),
        "signal_similarity": ramp(best, floor, 1.0),
    }).drop("_first", "_partner", "_best")


def top_pairs(scored: DataFrame, most: int = 200, more: tuple[str, ...] = ("district", "risk_score")) -> DataFrame:
    """Each unordered pair once, the most similar first, with ``more`` columns of its
    first work, as far as there are such."""
    some = scored.where("similar_work_id IS NOT NULL").select("work_id", "similar_work_id", "similarity_score", *[c for c in more if c in scored.columns])
    key = F.concat_ws("||", F.least("work_id", "similar_work_id"), F.greatest("work_id", "similar_work_id"))
    w = Window.partitionBy("pair_key").orderBy(F.desc("similarity_score"), "work_id")
    first = some.withColumn("pair_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.orderBy(F.desc("similarity_score"), "pair_key").limit(most)
