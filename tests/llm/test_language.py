"""Paths over word scores against Viterbi written out."""

import numpy as np
import pytest

from setwise.llm import language


def path_by_force(scores, switch):
    k = scores.shape[1]
    best, came = [list(scores[0])], []
    for row in scores[1:]:
        steps = [max((best[-1][j] - (switch if j != i else 0), j == i, -j) for j in range(k)) for i in range(k)]
        came.append([-s[2] for s in steps])
        best.append([row[i] + steps[i][0] for i in range(k)])
    value = max(best[-1])
    return value


def value_of(scores, path, switch):
    return sum(scores[i, s] for i, s in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:], strict=False))


@pytest.mark.parametrize("switch", [0.0, 0.5, 3.0, 100.0])
def test_best_paths(switch):
    rng = np.random.default_rng(int(switch * 10))
    for _ in range(30):
        sizes = rng.integers(1, 40, rng.integers(1, 12))
        scores = rng.normal(0, 2, (sizes.sum(), rng.integers(1, 6)))
        text = np.repeat(np.arange(len(sizes)), sizes)
        path = language.best_paths(scores, text, switch)
        for i in range(len(sizes)):
            own = scores[text == i]
            assert np.isclose(value_of(own, path[text == i], switch), path_by_force(own, switch))
    assert language.best_paths(np.zeros((0, 3)), np.zeros(0, int), switch).tolist() == []
