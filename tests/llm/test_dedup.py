"""Near duplicates of documents and vectors against brute force."""

import numpy as np
import pytest

from workrisk.llm import hyperminhash as h
from workrisk.llm import pca_neighbours as p
from workrisk.llm.components import components


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def roots(nodes, linked):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def near_texts(n=60):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    out = []
    for base in range(n // 6):
        words = [word() for _ in range(int(rng.integers(6, 120)))]
        out.append(" ".join(words))
        for k in range(5):
            copy = list(words)
            for _ in range(k * len(words) // 60 + (k > 2)):
                copy[int(rng.integers(len(copy)))] = word()
            out.append(" ".join(copy).upper() if k == 1 else " ".join(copy))
    return out


def test_near_duplicates_equal_brute_force(spark, documents):
    texts = [*near_texts(), None, "", " \n", "one two", "one two", "one two three", "x " * 3000]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    sets = {i: shingles(t) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    low = roots(sets, linked)
    got = h.near_duplicates(documents(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), low[r.doc_id], low[r.doc_id] == r.doc_id)
    kept = h.one_of_each(documents(rows))
    assert set(kept.columns) == set(documents([]).columns)
    assert {r.doc_id for r in kept.collect()} == {i for i in sets if low[i] == i}


def under_the_threshold(n, seed=8):
    """Copies of one text with two words changed: most pairs lie a little below
    0.75, some reach it."""
    rng = np.random.default_rng(seed)
    base = [f"b{k}" for k in range(80)]
    out = []
    for k in range(n):
        words = list(base)
        for at in rng.integers(0, 80, 2):
            words[int(at)] = f"n{k}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("group", [15, 2000])
def test_group_under_the_threshold_equals_brute_force(documents, monkeypatch, group):
    monkeypatch.setattr(h, "GROUP", group)
    rows = list(enumerate(under_the_threshold(150)))
    sets = {i: shingles(t) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    low = roots(sets, linked)
    assert 10 < len(set(low.values())) < 150
    assert {r.doc_id: r.component_id for r in h.near_duplicates(documents(rows)).collect()} == low


@pytest.mark.parametrize("group", [3, 50])
def test_rows_of_other_roots_meet_once(spark, monkeypatch, group):
    monkeypatch.setattr(h, "GROUP", group)
    rows = [(1, k, min(k, 12) if k < 30 else 99) for k in range(40)] + [(2, k, 5) for k in range(9)]
    dealt = h._dealt(spark.createDataFrame(rows, "key long, id long, root long"), ["key"]).collect()
    met, groups = [], {}
    for r in dealt:
        groups.setdefault((r.key, r.x, r.y), []).append(r)
    for (_, x, _), held in groups.items():
        ids, own, sides = (np.array([r[c] for r in held]) for c in ("id", "root", "side"))
        met += [tuple(sorted((int(ids[k]), int(ids[j])))) for k in np.flatnonzero(sides >= 0) for j in h._foes(k, x, own, sides)]
    root = {i: r for key, i, r in rows if key == 1}
    assert sorted(met) == [(a, b) for a in range(40) for b in range(a + 1, 40) if root[a] != root[b]]
    assert max(map(len, groups.values())) < 8 * group


def test_counts_of_shared_elements():
    sets = [np.array(s, dtype=np.uint64) for s in ([1, 2, 3], [3], [], [2, 3, 9], [7])]
    shared = h._shared_counts(sets)
    for k, a in enumerate(sets):
        assert [n for j, n in enumerate(shared(k).tolist()) if j != k] == [len(np.intersect1d(a, b)) for j, b in enumerate(sets) if j != k]


def test_rows_without_id_and_empty_tables(documents):
    got = h.near_duplicates(documents([(None, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (2, 1, False)]
    assert h.near_duplicates(documents([])).count() == 0


def test_chain_is_one_component_although_its_hub_reaches_no_end(documents):
    words = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join([*words[8 * k :], *[f"x{j}" for j in range(8 * k)]])) for k in range(5)]
    sets = {i: shingles(t) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    low = roots(sets, linked)
    assert {r.doc_id: r.component_id for r in h.near_duplicates(documents(rows)).collect()} == low


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        pool = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * 2)
        both = int(len(pool) * share)
        rest = (len(pool) - both) // 2
        a, b = np.sort(pool[: both + rest]), np.sort(np.concatenate([pool[:both], pool[both + rest : both + 2 * rest]]))
        found, deviation = h.estimate(h.registers(a)[None], h.registers(b)[None], np.array([len(a)]), np.array([len(b)]))
        assert abs(found[0] - share) < 4 * max(deviation[0], 0.02)


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 9), (6, 6), (None, 1)] + [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(200, 230)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if x is not None and e[0] is not None and e[0] != e[1]}
    assert got == roots(nodes, [e for e in edges if e[0] is not None and e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    ok = [v is not None and label is not None and i is not None and None not in v and np.isfinite(v).all() and any(v) for i, v, label in rows]
    out, linked = [0] * len(rows), []
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], dtype=np.float32).astype(float), np.array(rows[b][1], dtype=np.float32).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    out[a] += 1
                    linked.append((rows[a][0], rows[b][0]))
    return out, linked


@pytest.mark.parametrize("block", [4, 512])
def test_vectors_equal_brute_force(spark, block):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(12):
            base = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 5))):
                rows.append((n, (base + 0.05 * rng.normal(size=16)).tolist(), label))
                n += 1
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 1), (n + 2, None, 0), (n + 3, [0.0] * 16, 0), (n + 4, [float("nan")] * 16, 0), (n + 5, [None] * 16, 0), (n + 6, rows[0][1], None), (n + 7, rows[0][1][:8], 0), (n + 8, [-0.0, 1.0], 0), (n + 9, [0.0, 2.0], 0)]
    got = {r.vec_id: r for r in p.link(spark.createDataFrame(rows, VECTORS), block=block).collect()}
    counts, linked = brute(rows)
    low = roots([r[0] for r in rows], linked)
    for (i, _, _), c in zip(rows, counts, strict=True):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (c, low[i], low[i] == i), i


@pytest.mark.parametrize(("dims", "block"), [(12, 64), (2, 50)])
def test_one_label_of_many_near_vectors(spark, dims, block):
    """A label that holds nearly all rows, crowded in a few directions."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, dims))
    rows = [(k, (centres[int(rng.integers(40)) ** 2 // 40] + (0.16 if dims > 2 else 0.01) * rng.normal(size=dims)).tolist(), 0 if k % 50 else 1) for k in range(2500)]
    got = {r.vec_id: r for r in p.link(spark.createDataFrame(rows, VECTORS), block=block).collect()}
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (v @ v.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    assert 2500 < near.sum() and (dims == 2 or near.sum() < 2500 * 600)
    low = np.arange(len(rows))
    while True:
        new = np.minimum(low, np.where(near, low, len(rows)).min(axis=1))
        if (new == low).all():
            break
        low = new
    assert all((got[k].n_links, got[k].component_id) == (int(near[k].sum()), int(low[k])) for k in range(len(rows)))


def test_blocks_are_small_in_all_leading_coordinates(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=5).tolist(), 0) for k in range(4000)]
    kinds = p.classes(spark.createDataFrame(rows, VECTORS))[1].cache()
    blocks = p.make_blocks(kinds, p.axes(kinds), 50).select("low", "high").collect()
    sides = np.array([np.array(b.high) - np.array(b.low) for b in blocks])
    assert np.median(sides[:, :4], axis=0).max() < 1


@pytest.mark.parametrize("dims", [3, 64, 300])
def test_rotations_keep_lengths_and_follow_the_axes(dims):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(200, dims)) * np.linspace(3, 0.1, dims)
    own = p.principal(rows, p.LEAD)
    new = p.Rotation.along(own).turn(rows)
    k = own.shape[1]
    assert np.allclose(new @ new.T, rows @ rows.T) and np.allclose(np.abs(new[:, :k]), np.abs(rows @ own), atol=1e-8)
    assert (np.diff((new[:, :3] ** 2).sum(axis=0)) < 1e-6).all()


@pytest.mark.parametrize("kind", ["double", "date", "decimal(10,2)", "string", "boolean"])
def test_labels_of_any_type(spark, kind):
    value = {"double": "0.5", "date": "2001-02-03", "decimal(10,2)": "1.25", "string": "a,1", "boolean": "true"}[kind]
    other = {"double": "1.5", "date": "2001-02-04", "decimal(10,2)": "1.5", "string": "a", "boolean": "false"}[kind]
    rows = [(1, [1.0, 2.0], value), (2, [2.0, 4.0], value), (3, [1.0, 2.0], other), (4, [1.0, 1.0, 2.0], other)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, text string").selectExpr("vec_id", "embedding", f"CAST(text AS {kind}) AS label")
    assert {r.vec_id: r.component_id for r in p.link(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_one_label_of_many_dimensions_and_extra_columns(spark):
    """400 dimensions, a repeated vec_id, many copies, and columns that clash."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(12, 400))
    rows = [(k, (base[k % 12] + 0.03 * rng.normal(size=400)).tolist(), 1) for k in range(60)]
    rows += [(100 + k, rows[0][1], 1) for k in range(40)] + [(5, rows[7][1], 1)]
    counts, linked = brute(rows)
    low = roots([r[0] for r in rows], linked)
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' AS key", "1 AS links", "2 AS root", "3 AS home")
    got = p.link(df, block=7).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted((r[0], c, low[r[0]]) for r, c in zip(rows, counts, strict=True))


def test_no_vectors(spark):
    assert p.link(spark.createDataFrame([], VECTORS)).count() == 0


def test_tiles_stop_early():
    a, b = np.eye(64, dtype=np.float32)[:1], np.eye(64, dtype=np.float32)[1:2]
    assert p.near(a, b, 0.98)[2] < 64
