"""Hard negatives against brute force."""

import math
import random

import pytest

from quillspark.llm import pivots


def plain(rows, anchors, n_positives=5, n_negatives=3):
    """rows: (vec_id, label, vector); of rows that share an id the smallest counts."""
    least = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(256 * x) for x in v])
        least[i] = min(least.get(i, row), row)
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a, (label, v) in least.items():
        if not anchors(a):
            continue
        s = sorted((-score(v, y), i, k) for i, (k, y) in least.items() if i != a)
        for ps, p, _ in [x for x in s if x[2] == label][:n_positives]:
            hard = [x for x in s if x[2] != label and -50 * ps <= -100 * x[0] <= -95 * ps][:n_negatives]
            out += [(a, p, r, i, -ps, -ns) for r, (ns, i, _) in enumerate(hard, 1)]
    return sorted(out)


def vectors(seed, n, labels, dim=6, whole=False):
    r = random.Random(seed)
    one = lambda: r.choice([-0.5, 0.0, 0.25, 1.0]) if whole else r.gauss(0, 1)
    return [(k, r.choice(labels), [one() for _ in range(dim)]) for k in range(n)]


def run(spark, rows, anchors):
    d = spark.createDataFrame([(*x, 1, "x") for x in rows], "vec_id long, label int, embedding array<double>, v int, block string")
    return sorted(tuple(r) for r in pivots.mine(pivots.clean(d), anchors).collect())


@pytest.mark.parametrize("whole", [False, True])
def test_negatives_are_those_of_brute_force(spark, monkeypatch, whole):
    monkeypatch.setattr(pivots, "BLOCK", 32)
    monkeypatch.setattr(pivots, "ANCHORS", 8)
    monkeypatch.setattr(pivots, "TURN", 3)
    monkeypatch.setattr(pivots, "TILE", 24)
    # a hot label, ties, copies, vectors that share an id, nulls, other lengths
    rows = vectors(2, 500, [1, 1, 1, 2, 3, 9], whole=whole) + [(600 + k, 1 + k % 2, [1.0] * 6) for k in range(60)]
    rows += [(10, 1, [1.0] * 6), (10, 2, [0.5] * 6), (700, None, [1.0] * 6), (None, 1, [1.0] * 6), (702, 1, None), (704, 1, [1.0, None]), (706, 1, [float("nan")]), (708, 2, [float("inf")] * 6)]
    rows += [(710, 1, []), (720, 2, [2.0]), (730, 3, [0.1] * 6), (740, 77, [0.3] * 6)]
    found = run(spark, rows, "vec_id % 5 = 0")
    assert found == plain(rows, lambda a: a % 5 == 0) and len(found) > 300


def test_few_rows_and_none(spark):
    assert run(spark, [], "true") == []
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.1]), (2, 2, [0.9, 0.0])]
    assert run(spark, rows, "true") == plain(rows, lambda a: True) != []
    assert run(spark, rows, "vec_id = 9") == []
    assert run(spark, [(0, 1, [0.0]), (1, 1, [0.0]), (2, 2, [0.0])], "true") == plain([(0, 1, [0.0]), (1, 1, [0.0]), (2, 2, [0.0])], lambda a: True)
    large = [(k, k % 2, [1e5 * (1 + k % 7), -2e4]) for k in range(30)]
    assert run(spark, large, "vec_id < 9") == plain(large, lambda a: a < 9)
    with pytest.raises(ValueError, match="56 bits"):
        run(spark, [(0, 1, [1e30])], "true")


def test_brackets_hold_and_rule_most_pairs_out():
    import numpy as np

    r = np.random.default_rng(1)
    centres = r.normal(0, 200, (12, 16))
    x = np.rint(centres[r.integers(0, 12, 2000)] + r.normal(0, 6, (2000, 16)))
    q = x[::50]
    space = pivots.Space(x[r.integers(0, 2000, 8)], float((x**2).sum(1).max()), 16, int(abs(x).max()))
    low, high = space.brackets((q**2).sum(1), space.distances(q, True), space.distances(x, False))
    score = q @ x.T
    assert (low <= score).all() and (score <= high).all()
    fifth = np.sort(score, 1)[:, -5]
    assert (high >= fifth[:, None]).mean() < 0.35
