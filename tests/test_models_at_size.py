"""The models' inner loops: the same results with less work a row."""

import numpy as np
import pytest

from workrisk.operators import density, multivariate


@pytest.mark.parametrize("n, trees, sample", [(1, 3, 8), (2, 3, 8), (500, 40, 64), (3000, 25, 256)])
def test_forest_says_what_its_nodes_say(n, trees, sample):
    rng = np.random.default_rng(n)
    rows = np.round(rng.normal(size=(n, 4)), 1)
    rows[:, 3] = 1.0
    forest = multivariate.IsolationForest(trees, sample, 7).fit(rows)
    asked = np.concatenate([rows, rng.normal(0, 5, (50, 4)), [[np.nan] * 4, [np.inf] * 4, [-np.inf] * 4]])
    total = np.zeros(len(asked))
    for feature, cut, left, right, length in forest.nodes:
        for k, row in enumerate(asked):
            at = 0
            while feature[at] >= 0:
                at = left[at] if row[feature[at]] <= cut[at] else right[at]
            total[k] += length[at]
    want = 2 ** -(total / trees / max(multivariate.harmonic(forest.used), 1e-9))
    assert np.array_equal(forest.scores(asked), want) and np.array_equal(forest.scores(asked, 7), want)
    depth, feature, cut, length = forest._laid()
    assert feature.shape == cut.shape == length.shape == (trees, 1 << depth)


def test_a_piece_compares_few_of_its_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.1, (1500, 5)), rng.uniform(-20, 20, (1500, 5)), rng.normal(6, 1, (1000, 5))])[rng.permutation(4000)]
    weights = rng.integers(1, 3, len(x))
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= 1.44
    want, seen, within = near @ weights, [], density.within
    monkeypatch.setattr(density, "within", lambda a, b, eps: seen.append(len(a) * len(b)) or within(a, b, eps))
    got = density.Cells(x, weights).own(1.2, 10)
    assert np.array_equal(got >= 10, want >= 10) and np.array_equal(got[want < 10], want[want < 10])
    assert sum(seen) < len(x) ** 2 / 5
    dense = want >= 10
    got, reached = density.Cells(x, np.where(dense, -weights, weights)).met(x, 1.2, 10)
    assert np.array_equal(got >= 10, dense) and np.array_equal(got[~dense], want[~dense])
    assert np.array_equal(reached[~dense], (near & dense[None]).any(axis=1)[~dense])


def test_boxes_out_of_reach_are_left_out():
    low, high = np.array([[0.0, 0.0], [5.0, np.nan]]), np.array([[1.0, 1.0], [6.0, np.nan]])
    found = density.in_reach(np.array([[0.5, 0.5], [2.0, 2.0], [4.0, 99.0], [1.5, 1.5]]), low, high, 1.2)
    assert found.tolist() == [[True, False], [False, False], [False, True], [True, False]]
