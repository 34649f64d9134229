"""Near-duplicate documents by HyperMinHash sketches.

A document is its set of five-word shingles. The sketch deals the shingles'
hashes into buckets and keeps, of the smallest hash of each, the number of
leading zeros and a few bits of mantissa: 16 bits a bucket. Bands of these
compressed registers select candidates, the sketches of candidates estimate
their similarity less the chance collisions of registers, and what may reach
the threshold is decided on the full sets.

A group of copies never becomes all its pairs. Equal sets are one class. Twice,
every document is compared with one hub of its buckets, the member that shares
most of them; the verified links give components. Only buckets in which more than
one component is left are compared further, and only across components, so that
no link between them is lost: their sketches are compared where they lie, which
tells the members that may be near another component, and the full sets of these
are compared in groups of bounded size. Rows that are shuffled stand for members,
never for pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workrisk.llm.common import bounded_batches, discard, id_text, only, written
from workrisk.llm.components import components

SHINGLE = 5
#: 128 buckets of 6 bits of leading zeros and 10 of mantissa; 32 bands of four
#: buckets, each band being 64 bits. Two sets of similarity 0.75 agree in no band
#: with a chance of (1 - 0.75**4)**32 < 6e-6.
BUCKETS, MANTISSA, BANDS = 128, 10, 32
BUCKET_BITS = 7
#: More buckets, of 4 and 4 bits, for the estimates alone.
FINE, FINE_MANTISSA, FINE_BITS = 256, 4, 8
LONGS = BANDS + FINE // 8
#: Estimates so many standard deviations below the threshold are still verified.
DEVIATIONS = 4.7
#: Members of a hub, or of a block of a bucket, that one group of rows holds, and
#: shingles of a block's members.
GROUP, GROUP_WEIGHT = 2000, 1_000_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted 64-bit hashes of their distinct shingles."""

    def __init__(self, limit: int = 200_000):
        self.words: dict[bytes, int] = {}
        self.limit = limit

    def hashes(self, text: str) -> np.ndarray:
        # bytes.lower() touches A-Z alone; bytes.split() cuts at \\x20 and \\x09-\\x0D
        words = text.encode().lower().split()
        if len(self.words) > self.limit:
            self.words.clear()
        known = self.words
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        n = len(words)
        one = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=n)
        if not n:
            return one
        if n < SHINGLE:
            return _mix((one * _ODD[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
        rows = one[: n - SHINGLE + 1] * _ODD[0]
        for k in range(1, SHINGLE):
            rows = rows + one[k : n - SHINGLE + 1 + k] * _ODD[k]
        return np.unique(_mix(rows))


def _smallest(hashes: np.ndarray, bits: int, mantissa_bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted hashes: the buckets (their top bits) that have one, and the
    smallest rest in each as leading zeros (``most`` at most) and mantissa."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = hashes[first] << np.uint64(bits) | np.uint64(1)  # never 0
    zeros = (63 - np.floor(np.log2(rest.astype(np.float64))).astype(np.int64)).clip(0, 63)
    zeros += (rest << zeros.astype(np.uint64)) >> np.uint64(63) == 0  # a double rounded up
    mantissa = (rest << zeros.astype(np.uint64) << np.uint64(1)) >> np.uint64(64 - mantissa_bits)
    return bucket[first], (zeros.clip(0, most) + 1 << mantissa_bits) | mantissa.astype(np.int64)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of sorted hashes as LONGS longs; an empty bucket is 0."""
    bands, fine = np.zeros(BUCKETS, dtype=np.uint16), np.zeros(FINE, dtype=np.uint8)
    if len(hashes):
        at, values = _smallest(hashes, BUCKET_BITS, MANTISSA, 62)
        bands[at] = values
        at, values = _smallest(np.sort(_mix(hashes ^ _ODD[0])), FINE_BITS, FINE_MANTISSA, 14)
        fine[at] = values
    return np.concatenate([bands.view(np.int64), fine.view(np.int64)])


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, at: float = 0.75) -> tuple[np.ndarray, np.ndarray]:
    """Similarities of rows of sketches of sets of sizes n and m, and the
    standard deviation that the estimate has where the similarity is ``at``.

    The similarity is the share of equal registers, less those that different
    minima are expected to make. The buckets of either kind draw from the union
    without putting back, so a small union is drawn nearly whole."""
    # Yu and Weber, 2017: collisions of large sets, by the ratio of their sizes
    ratio = 0.169919487159739093975 * 4 * n * m / np.maximum((n + m) ** 2.0, 1)
    union = np.maximum((n + m) / (1 + at), 1)
    same = seen = chance = spread = 0
    for kind, part, bits in ((np.uint16, slice(0, BANDS), MANTISSA), (np.uint8, slice(BANDS, LONGS), FINE_MANTISSA)):
        x, y = (np.ascontiguousarray(z[..., part]).view(kind) for z in (a, b))
        here = ((x | y) != 0).sum(axis=-1)
        same, seen, chance = same + ((x == y) & (x != 0)).sum(axis=-1), seen + here, chance + here * ratio / 2**bits
        spread = spread + here * (at * (1 - at) * np.clip(1 - (here - 1) / union, 0, 1) + ratio / 2**bits)
    seen = np.maximum(seen, 1)
    chance = chance / seen
    return np.clip((same / seen - chance) / (1 - chance), 0, 1), np.sqrt(spread) / seen


def may_reach(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the sets may be as similar as the threshold."""
    found, deviation = estimate(a, b, n, m, threshold)
    sizes = np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9
    return sizes & (found >= threshold - DEVIATIONS * deviation - 1 / np.maximum(n + m, 1))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fingerprint (of the set; null where it is empty or the
    row has no id) and sketch (one long a band, then the fine registers)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        shingler = Shingler()
        for batch in batches:
            sizes, prints, rows = [], [], np.zeros((batch.num_rows, LONGS), dtype=np.int64)
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = shingler.hashes(text)
                sizes.append(len(found))
                prints.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                rows[k] = registers(found)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * LONGS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))],
                ["doc_id", "n_shingles", "fingerprint", "sketch"],
            )

    rows = id_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(run, "doc_id long, n_shingles long, fingerprint binary, sketch array<long>")
    return found.withColumn("fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("fingerprint")))


def _likely(pairs: DataFrame, kinds: DataFrame, threshold: float) -> DataFrame:
    """The pairs (hub, id) whose sketches may reach the threshold."""
    one = kinds.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("sketch").alias("hub_sketch"))
    both = pairs.join(kinds, "id").join(one, "hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).flatten().to_numpy().reshape(-1, LONGS) for c in ("sketch", "hub_sketch"))
            good = may_reach(a, b, batch.column("n").to_numpy(), batch.column("hub_n").to_numpy(), threshold)
            yield batch.select(["hub", "id"]).filter(pa.array(good))

    return both.mapInArrow(run, "hub long, id long")


def _texts(docs: DataFrame) -> DataFrame:
    # dealt by id whatever the sizes are: what is joined to them grows too
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).hint("merge")


def verify(pairs: DataFrame, docs: DataFrame, threshold_percent: int) -> DataFrame:
    """Of the distinct pairs (hub, id), those whose full sets have 100 * |both| >=
    threshold_percent * |either|.

    A hub's row, then those of its pairs, come one after the other, so one set
    and one text are held at a time; a hub of many pairs is dealt into groups,
    each with the hub's text again.
    """
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP)).cast("int").alias("groups"))
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(0).alias("order"), F.col("hub").alias("id"))
    members = pairs.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("group"), F.lit(1).alias("order"), "id")
    dealt = hubs.union(members).join(_texts(docs), "id").repartition("hub", "group").sortWithinPartitions("hub", "group", "order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        shingler, at, held = Shingler(), None, []
        for batch in batches:
            hubs, ids = [], []
            for hub, group, order, doc, text in zip(*(batch.column(c).to_pylist() for c in ("hub", "group", "order", "id", "text")), strict=True):
                if (hub, group) != at:
                    at, held = (hub, group), []
                found = shingler.hashes(text)
                if not order:
                    held.append(found)  # more than one only where rows repeat an id
                    continue
                for one in held:
                    both = len(np.intersect1d(one, found, assume_unique=True))
                    if 100 * both >= threshold_percent * (len(one) + len(found) - both) and both:
                        hubs.append(hub)
                        ids.append(doc)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(ids, pa.int64())], ["hub", "id"])

    return dealt.mapInArrow(run, "hub long, id long")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the component of their id."""
    return rows.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def _dealt(rows: DataFrame, key: list[str], weight: str | None = None) -> DataFrame:
    """``rows`` (id, root, ...) of keys that have more than one root, dealt into
    groups (x, y) in which any two rows of a key and of different roots meet.

    A key's largest root is cut into blocks x, all its others into blocks y of
    GROUP rows (or GROUP_WEIGHT). A group x >= 0 has a block of either, and holds
    them against each other (and, where x is 0, y's rows among themselves); x < 0
    stands for the block -1 - x of the others, which meets their block y. ``side``
    is -1 for the largest root, else the row's own block."""
    heavy = F.sum(weight) if weight else F.lit(0)
    parts = rows.groupBy(*key, "root").agg(F.count(F.lit(1)).alias("_n"), heavy.alias("_w"))
    top = F.max(F.struct("_n", "root", "_w"))
    mixed = parts.groupBy(*key).agg(top.alias("_top"), F.sum("_n").alias("_n"), F.sum("_w").alias("_w"), F.count(F.lit(1)).alias("_parts")).where("_parts > 1")
    blocks = lambda n, w: F.greatest(F.ceil(n / F.lit(GROUP)), F.ceil(w / F.lit(GROUP_WEIGHT))).cast("int")
    cut = mixed.select(
        *key, F.col("_top.root").alias("_major"), blocks(F.col("_top._n"), F.col("_top._w")).alias("_xs"), blocks(F.col("_n") - F.col("_top._n"), F.col("_w") - F.col("_top._w")).alias("_ys"),
    )
    of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    sided = rows.join(cut, key).withColumn("side", F.when(F.col("root") == F.col("_major"), F.lit(-1)).otherwise(of("_ys")))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    major = F.transform(upto("_ys"), lambda y: F.struct(of("_xs").alias("x"), y.alias("y")))
    crossed = F.transform(upto("_xs"), lambda x: F.struct(x.alias("x"), F.col("side").alias("y")))
    others = F.filter(upto("_ys"), lambda y: y != F.col("side"))
    among = F.transform(others, lambda y: F.struct((-1 - F.least(y, F.col("side"))).alias("x"), F.greatest(y, F.col("side")).alias("y")))
    groups = F.explode(F.when(F.col("side") < 0, major).otherwise(F.concat(crossed, among)))
    out = sided.withColumn("_at", groups).withColumns({"x": F.col("_at.x"), "y": F.col("_at.y")})
    return out.drop("_at", "_major", "_xs", "_ys")


def _foes(k: int, x: int, roots: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """The rows of a group that its row k, not of the largest root, is held against."""
    if x < 0:
        return np.flatnonzero((sides > sides[k]) & (roots != roots[k]))
    later = np.arange(len(roots)) > k
    return np.flatnonzero((roots != roots[k]) & ((sides < 0) | (later & (x == 0))))


def _by_group(batches: Iterator[pa.RecordBatch], key: int, names: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Sorted rows as (values of the first ``key`` columns, list of the others)."""
    at, held = None, []
    for batch in (b for b in batches if b.num_rows):
        columns = (batch.column(c) for c in names)
        lists = [c.flatten().to_numpy().reshape(len(c), -1) if pa.types.is_list(c.type) else c.to_pylist() for c in columns]
        for row in zip(*lists, strict=True):
            if row[:key] != at:
                if held:
                    yield at, held
                at, held = row[:key], []
            held.append(row[key:])
    if held:
        yield at, held


class _Sets:
    """Disjoint sets of a task's components."""

    def __init__(self):
        self.over: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (up := self.over.get(x, x)) != x:
            self.over[x] = self.over.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.top(x), self.top(y)
        self.over[max(x, y)] = min(x, y)


def _clusters(members: DataFrame, roots: DataFrame, kinds: DataFrame, threshold: float) -> DataFrame:
    """(id, root, peer): every member of a bucket that may reach the threshold
    with one of another component, its component, and one of those components
    that such pairs of its group of rows connect it with.

    Pairs of sketches are compared where they lie; a row of the result stands for
    a member, never for a pair."""
    rows = _dealt(_rooted(members, roots), ["band", "key"])
    order = ["band", "key", "x", "y"]
    dealt = rows.join(kinds, "id").repartition(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, _, x, _), held in _by_group(batches, 4, [*order, "id", "root", "side", "n", "sketch"]):
            ids, own, sides, sizes = (np.array([r[k] for r in held], dtype=np.int64) for k in range(4))
            bands = np.array([r[4] for r in held], dtype=np.int64)
            near, joint = np.zeros(len(held), dtype=bool), _Sets()
            for k in np.flatnonzero(sides >= 0).tolist():
                foes = _foes(k, x, own, sides)
                foes = foes[np.minimum(sizes[foes], sizes[k]) >= threshold * np.maximum(sizes[foes], sizes[k]) - 1e-9]
                if len(foes) and band:  # an earlier band has compared those
                    foes = foes[~((bands[foes, :band] == bands[k, :band]) & (bands[k, :band] != 0)).any(axis=1)]
                if len(foes):
                    foes = foes[may_reach(bands[foes], bands[k], sizes[foes], sizes[k], threshold)]
                if len(foes):
                    near[foes] = near[k] = True
                    for r in np.unique(own[foes]).tolist():
                        joint.join(int(own[k]), r)
            found = np.flatnonzero(near)
            peers = [joint.top(r) for r in own[found].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(own[found]), pa.array(peers, pa.int64())], ["id", "root", "peer"])

    return dealt.mapInArrow(run, "id long, root long, peer long").distinct()


def _shared_counts(sets: list[np.ndarray]) -> Callable[[int], np.ndarray]:
    """A function of k: how many elements set k shares with each of the other sets."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    by_value = owner[np.argsort(where, kind="stable")]
    ends = np.cumsum(counts)
    starts = ends - counts
    bounds = np.concatenate([[0], np.cumsum(sizes)])

    def shared(k: int) -> np.ndarray:
        own = where[bounds[k] : bounds[k + 1]]
        own = own[counts[own] > 1]
        many = counts[own]
        at = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(own) else own
        return np.bincount(by_value[at], minlength=len(sets))

    return shared


def _settled(near: DataFrame, kinds: DataFrame, docs: DataFrame, threshold_percent: int) -> DataFrame:
    """Links (hub, id) between members of different components, found on their
    full sets; any two members that _clusters found near each other are decided,
    unless links found before already connect their components.

    Components that such members connect form a cluster; a cluster's members come
    with their texts once a group, and only the links that connect are returned."""
    clusters = components(near, "root", "peer").select(F.col("node").alias("root"), F.col("root").alias("cluster"))
    flagged = near.select("id", "root").distinct().join(clusters, "root").join(kinds.select("id", "n"), "id")
    order = ["cluster", "x", "y"]
    dealt = _dealt(flagged, ["cluster"], "n").join(_texts(docs), "id").repartition(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        shingler = Shingler()

        def with_sets() -> Iterator[pa.RecordBatch]:
            """Texts become sets as they come, so that no group of texts is held."""
            for batch in batches:
                sets = [shingler.hashes(t).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(sets, pa.binary())], names)

        names = [*order, "id", "root", "side", "set"]
        for (_, x, _), held in _by_group(with_sets(), 3, names):
            ids, own, sides = (np.array([r[k] for r in held], dtype=np.int64) for k in range(3))
            sets = [np.frombuffer(r[3], dtype=np.uint64) for r in held]
            shared, sizes, joint, hubs, others = _shared_counts(sets), np.array([len(s) for s in sets]), _Sets(), [], []
            for k in np.flatnonzero(sides >= 0).tolist():
                foes = _foes(k, x, own, sides)
                if not len(foes):
                    continue
                both = shared(k)[foes]
                linked = foes[(100 * both >= threshold_percent * (sizes[foes] + sizes[k] - both)) & (both > 0)]
                for j in linked.tolist():
                    if joint.top(int(own[k])) != joint.top(int(own[j])):
                        joint.join(int(own[k]), int(own[j]))
                        hubs.append(ids[k])
                        others.append(ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(others, pa.int64())], ["hub", "id"])

    return dealt.mapInArrow(run, "hub long, id long")


def _starred(members: DataFrame) -> DataFrame:
    """``members`` with the hub of their bucket, the member that has the most
    neighbours over all bands, and how many it has."""
    mass = members.groupBy("id").agg(F.sum("size").alias("mass"))
    hubs = members.join(mass, "id").groupBy("band", "key").agg(F.max(F.struct("mass", (-F.col("id")).alias("minus"))).alias("top"))
    return members.join(hubs, ["band", "key"]).select("band", "key", "id", F.col("top.mass").alias("mass"), (-F.col("top.minus")).alias("hub"))


def _one_hub(rows: DataFrame) -> DataFrame:
    """Of each id, the pair (hub, id) with the hub of the most neighbours: as many
    pairs as ids at most, whatever the buckets' sizes."""
    best = rows.where("id <> hub").groupBy("id").agg(F.max(F.struct("mass", (-F.col("hub")).alias("minus"))).alias("top"))
    return best.select((-F.col("top.minus")).alias("hub"), "id")


def near_duplicates(docs: DataFrame, threshold_percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``.

    Documents are linked where 100 * |intersection| >= threshold_percent *
    |union| of their sets. A document with fewer than five words has one shingle,
    all its words; a null or empty text, or one without words, has an empty set
    and links with nothing, nor does a row without an id (component null, kept).
    Rows that repeat a doc_id are one document: they share a component and stay
    or go together. Columns other than doc_id and text are not read; an empty
    table gives an empty result.
    """
    threshold = threshold_percent / 100
    all_rows = written(sketches(docs), "sketches")
    grouped = all_rows.where("fingerprint IS NOT NULL").groupBy("fingerprint")
    kinds = written(grouped.agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")
    sets = kinds.select("id", "n", "sketch")
    banded = kinds.select("id", F.posexplode(F.slice("sketch", 1, BANDS)).alias("band", "key")).where("key <> 0")
    shared = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(banded.join(shared, ["band", "key"]), "members")
    starred = written(_starred(members), "starred")
    discard(members)
    texts = id_text(docs)

    def confirmed(pairs: DataFrame) -> DataFrame:
        likely = written(_likely(pairs, sets, threshold), "stars")
        found = written(verify(likely, texts, threshold_percent), "links")
        discard(likely)
        return found

    # classes of different texts may have the same smallest id: rows repeat it
    same = all_rows.where("fingerprint IS NOT NULL").join(kinds.select("fingerprint", "id"), "fingerprint").where("doc_id <> id").select(F.col("id").alias("hub"), F.col("doc_id").alias("id")).distinct()
    first = written(_one_hub(starred), "pairs")
    linked = confirmed(first)
    # once more, with the hubs of other components
    placed = _rooted(starred, components(linked, "hub", "id"))
    over = placed.groupBy("band", "key").agg(F.max(F.when(F.col("id") == F.col("hub"), F.col("root"))).alias("hub_root"), F.min("root").alias("_least"), F.max("root").alias("_most"))
    apart = placed.join(over.where("_least < _most").select("band", "key", "hub_root"), ["band", "key"]).where("root <> hub_root")
    second = apart.join(first.select("id", F.col("hub").alias("_first")), "id", "left").where("NOT hub <=> _first")
    linked = linked.union(confirmed(_one_hub(second)))
    near = written(_clusters(starred.select("band", "key", "id"), components(linked, "hub", "id"), sets, threshold), "near")
    more = written(_settled(near, sets, texts, threshold_percent), "links")
    for df in (starred, first, near):
        discard(df)
    roots = components(linked.union(more).union(same), "hub", "id")
    found = all_rows.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = found.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, threshold_percent: int = 75) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates of a document
    with a smaller id. Only the ids that go are joined."""
    gone = near_duplicates(docs, threshold_percent).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("_gone"), "left_anti")
