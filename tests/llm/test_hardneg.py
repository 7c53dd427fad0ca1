import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecraft.llm import hardneg


def brute(rows, anchors=lambda i: i % 10 == 0):
    ok = [
        (i, tuple(math.floor(256 * v) for v in x), label)
        for i, x, label in rows
        if i is not None and label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)
    ]
    result = []
    for a, (i, x, label) in enumerate(ok):
        if not anchors(i):
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), j, other) for b, (j, y, other) in enumerate(ok) if b != a and len(y) == len(x)]
        for score, j, _ in sorted(s for s in scored if s[2] == label)[:5]:
            inside = sorted(s for s in scored if s[2] != label and -30 * score <= -100 * s[0] <= -90 * score)[:10]
            result += [(i, j, rank, n, -score, -s) for rank, (s, n, _) in enumerate(inside, 1)]
    return sorted(result)


def vectors(count, dims, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dims))
    label = rng.choice([0, 1, 1, 1, 2], count)
    x = centers[rng.integers(0, 6, count)] + rng.normal(scale=0.6, size=(count, dims))
    x[rng.random(count) < 0.2] = x[0]  # many equal vectors, under all labels
    return [(i, [float(v) for v in np.float32(row)], int(c)) for i, row, c in zip(range(count), x, label)]


def found(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, shard string, uid int")
    return sorted(tuple(r) for r in hardneg.hard_negatives(df, F.col("id") % 10 == 0, **settings).collect())


@pytest.mark.parametrize("settings", [{}, {"shard": 100, "block": 7}])
def test_against_all_rows(spark, settings, monkeypatch):
    monkeypatch.setattr(hardneg, "LEAF", 16)
    rows = vectors(700, 5)
    assert found(spark, rows, **settings) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(60, 3) + [(100, None, 1), (110, [1.0, None, 2.0], 1), (120, [float("nan"), 0.0, 1.0], 1), (130, [float("inf"), 0.0, 1.0], 1)]
    rows += [(140, [1.0, 2.0, 3.0], None), (None, [1.0, 2.0, 3.0], 1), (150, [1.0, 2.0], 1), (151, [1.0, 1.5], 1), (152, [0.5, 0.5], 2), (160, [], 0)]
    rows += [(170, [0.0, 0.0, 0.0], 1), (161, [], 0), (162, [], 2), rows[10], rows[10], rows[3]]
    assert found(spark, rows) == brute(rows)


def test_empty_and_lone_anchor(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0], 1), (1, [0.5], 2)]) == []


@pytest.mark.parametrize("scale", [1, 2**20, 2**26])
def test_tree_drops_boxes_but_no_result(scale):
    """Large components go beyond what doubles hold exactly."""
    rng = np.random.default_rng(3)
    x = np.sort(rng.integers(-9, 9, (400, 4)), axis=0) * scale + rng.integers(0, 2, (400, 4))
    labels, ids = rng.integers(0, 3, 400), rng.permutation(400)
    tree = hardneg.Tree(labels, ids, np.arange(400), x, leaf=8, fan=4)
    seen = []
    scores = tree.scores
    tree.scores = lambda a, at: seen.append(at) or scores(a, at)
    exact = [[int(p) for p in row] for row in x]
    for a in range(0, 400, 20):
        every = sorted((-sum(p * q for p, q in zip(exact[a], exact[b])), int(ids[b]), b) for b in range(400) if labels[b] != labels[a])
        middle = -every[len(every) // 4][0]
        windows = [(-(2**62), 2**62), (middle - 50 * scale, middle), (5, 4)]
        got = tree.best(x[a], windows, 7, lambda part, a=a: tree.labels[part] != labels[a])
        assert [[g[:2] for g in w] for w in got] == [[e[:2] for e in every if lo <= -e[0] <= hi][:7] for lo, hi in windows]
    assert len(seen) < 0.7 * 20 * 50


def test_query(spark):
    from tablecraft.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = QUERIES["op12_hardneg"](spark, folder)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i % 100 == 0)
