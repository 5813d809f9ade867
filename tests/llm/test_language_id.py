"""Mixed texts whose best path avoids the overall best label."""

import numpy as np
import pytest

from textloom.llm import language_id


def test_a_path_may_avoid_the_best_label():
    s = np.array([[0.0, -5.0, -20.0], [-20.0, -5.0, 0.0]])
    assert list(language_id.viterbi(s, np.array([0]), np.array([2]), np.zeros(3), 8.0)) == [0, 2]


def test_viterbi_of_short_mixed_texts():
    g = np.random.default_rng(2)
    sizes = g.integers(1, 5, 2000)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    s, prior = g.normal(0, 5, (sizes.sum(), 3)), np.zeros(3)
    got = language_id.viterbi(s, starts, sizes, prior, 8.0)
    for a, n in zip(starts, sizes):
        x, labels = s[a : a + n], got[a : a + n]
        have = x[0]
        for row in x[1:]:
            have = np.maximum(have, have.max() - 8.0) + row
        assert x[np.arange(n), labels].sum() - 8.0 * (np.diff(labels) != 0).sum() == pytest.approx(have.max())
