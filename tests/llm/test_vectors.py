import warnings

import numpy as np
import pytest

from tablecraft.llm import ann, nearvectors, nndescent

SCHEMA = "vec_id long, embedding array<float>, label int, node long, score double"


def rows_of(seed=1, n=700, dim=12, spread=False):
    """Random vectors, pairs and a dense group of near copies, exact copies, and vectors that take no part."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    center = rng.standard_normal(dim)
    dense = center + 0.02 * rng.standard_normal((150, dim))
    pairs = base[:40] + 0.03 * rng.standard_normal((40, dim))
    matrix = np.concatenate([base, dense, pairs, np.repeat(base[50:52], [30, 5], axis=0)])
    if spread:
        matrix *= rng.uniform(0.2, 3.0, len(matrix))[:, None]
    matrix = matrix.astype(np.float32)
    ids = rng.permutation(len(matrix) * 3)[: len(matrix)]
    rows = [(int(i), [float(x) for x in v], 0, 1, 0.5) for i, v in zip(ids, matrix)]
    odd = [None, [], [0.0] * dim, [1.0] * (dim + 1), [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1)]
    rows += [(10_000 + 20 * i, v, 0, 1, 0.5) for i, v in enumerate(odd)]
    return rows + [rows[3], rows[3]]


def usable(rows, dim=None):
    """Rows that take part, of one length: their ids and vectors, repeated ones as often as they occur."""
    dim = len(rows[0][1]) if dim is None else dim
    good = [(i, v) for i, v, *_ in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = sorted(good, key=repr)
    return [g[0] for g in good], np.array([g[1] for g in good])


def test_links_and_components(spark):
    rows = rows_of()
    ids, x = usable(rows)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    label = np.array(ids)
    while (lower := np.where(near, label[None], 1 << 60).min(axis=1)).tolist() != label.tolist():
        label = lower
    expected = {i: (int(n) - 1, int(c)) for i, n, c in zip(ids, near.sum(axis=1), label)}
    expected |= {r[0]: (0, r[0]) for r in rows if r[0] not in expected}
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = nearvectors.vector_components(docs).collect()
    assert len(found) == len(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in found}
    exact = sum(got[i] == e for i, e in expected.items())
    assert exact >= 0.99 * len(expected)
    assert sum(got[i][0] for i in got) <= sum(e[0] for e in expected.values())
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert max(n for n, _ in got.values()) >= 149  # the dense group, beyond any list's length


def test_nearest_by_inner_product(spark):
    rows = rows_of(2, spread=True)
    ids, x = usable(rows)
    found = {}
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i in ids if i % 20 == 0}
    hits = 0
    for q, pairs in found.items():
        at = ids.index(q)
        scores = x @ x[at]
        order = sorted((j for j in range(len(ids)) if j != at), key=lambda j: (-scores[j], ids[j]))[:20]
        pairs.sort()
        assert [p[0] for p in pairs] == list(range(1, 21))
        assert pairs == sorted(pairs, key=lambda p: (-p[2], p[1]))
        assert all(abs(s - scores[ids.index(v)]) < 1e-9 for _, v, s in pairs)
        # Scores, as copies tie in them but for rounding.
        hits += sum(s >= scores[order[-1]] - 1e-9 for _, _, s in pairs)
    assert hits / (20 * len(found)) >= 0.95


def linked(rows):
    """Id, links and component of each row, by comparing all rows of a length."""
    out = []
    for dim in {len(r[1] or []) for r in rows}:
        ids, x = usable(rows, dim)
        if ids:
            x = x / np.linalg.norm(x, axis=1)[:, None]
            near = x @ x.T >= 0.95
            label = np.array(ids)
            while (lower := np.where(near, label[None], 1 << 60).min(axis=1)).tolist() != label.tolist():
                label = lower
            out += [(i, int(n) - 1, int(c), i == c) for i, n, c in zip(ids, near.sum(axis=1), label)]
    taking_part = {(i, tuple(v)) for d in {len(r[1] or []) for r in rows} for i, v in zip(*usable(rows, d))}
    return sorted(out + [(r[0], 0, r[0], True) for r in rows if (r[0], tuple(r[1] or [])) not in taking_part])


def searched(rows):
    """Queries, ranks, ids and scores, by comparing all rows of a length."""
    out = set()
    for dim in {len(r[1] or []) for r in rows}:
        ids, x = usable(rows, dim)
        for at, q in enumerate(ids):
            if q % 20 == 0:
                scores = x @ x[at]
                order = sorted((j for j in range(len(ids)) if j != at), key=lambda j: (-round(scores[j], 9), ids[j]))[:20]
                out |= {(q, tuple(x[at]), k, ids[j], round(float(scores[j]), 9)) for k, j in enumerate(order, 1)}
    return sorted((q, k, v, s) for q, _, k, v, s in out)


def test_vectors_of_all_lengths_and_repeated_rows(spark):
    rng = np.random.default_rng(11)
    vectors = [rng.integers(-8, 9, d).astype(float).tolist() for d in [4] * 30 + [6] * 12 + [3] * 2 + [5]]
    rows = [(i, v, 0, 0, 0.0) for i, v in enumerate(vectors)]
    rows += [rows[20]] * 2 + [rows[0], rows[31], rows[40], (200, vectors[40], 0, 0, 0.0), (60, vectors[35], 0, 0, 0.0)]
    # One id with two vectors, more equal rows than a query lists, and vectors of no length.
    rows += [(20, vectors[5], 0, 0, 0.0), (20, vectors[36], 0, 0, 0.0), (7, [], 0, 0, 0.0), (8, None, 0, 0, 0.0), (9, [0.0] * 9, 0, 0, 0.0)]
    rows += [(340, vectors[8], 0, 0, 0.0)] * 25 + [(360 + i, vectors[8], 0, 0, 0.0) for i in range(25)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(tuple(r) for r in nearvectors.vector_components(frame).collect()) == linked(rows)
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.nearest(frame).collect())
    assert got == searched(rows)


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert nearvectors.vector_components(frame).collect() == [] and ann.nearest(frame).collect() == []


def test_recall_without_links_is_not_taken_for_measured(spark):
    x = np.eye(200)
    rows = [(i, v.tolist(), 0, 0, 0.0) for i, v in enumerate(x)]
    with pytest.warns(UserWarning, match="not measured"):
        found = nearvectors.vector_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.n_links == 0 and r.kept for r in found) and len(found) == 200


def test_few_links_among_many_vectors_are_audited(spark):
    """Planted copies, one vector in a hundred: the audit meets them, and all are linked."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((10_000, 24))
    x[:100] = x[100:200] + 0.02 * rng.standard_normal((100, 24))
    rows = [(i, v.tolist(), 0, 0, 0.0) for i, v in enumerate(x.astype(np.float32))]
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        found = nearvectors.vector_components(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    hits = sum(r.component_id == r.vec_id - 100 for r in found if 100 <= r.vec_id < 200)
    assert hits >= 97 and len(found) == 10_000


@pytest.mark.parametrize("n", [1, 5])
def test_few_rows(spark, n):
    rows = [(i * 20, [1.0, float(i)], 0, 0, 0.0) for i in range(n)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert ann.nearest(frame).count() == n * (n - 1)
    links = {r.vec_id: r.n_links for r in nearvectors.vector_components(frame).collect()}
    x = np.array([r[1] for r in rows]).reshape(n, 2)
    cosine = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    assert links == {i * 20: int((cosine[i] >= 0.95).sum()) - 1 for i in range(n)}


def test_only_unusable_rows(spark):
    frame = spark.createDataFrame([(20, None, 0, 0, 0.0), (40, [0.0], 0, 0, 0.0), (None, [float("nan")], 0, 0, 0.0)], SCHEMA)
    assert ann.nearest(frame).count() == 0
    assert {(r.vec_id, r.n_links, r.component_id) for r in nearvectors.vector_components(frame).collect()} == {
        (20, 0, 20),
        (40, 0, 40),
        (None, 0, None),
    }


def test_best_keeps_the_most_similar():
    owners, ids = np.array([2, 1, 1, 1, 2, 1]), np.array([7, 5, 6, 5, 8, 9])
    sims = np.array([0.1, 0.5, 0.9, 0.5, 0.3, 0.7], np.float32)
    got = nndescent.best(owners, ids, sims, 2, np.arange(6))
    assert [g.tolist() for g in got[:2]] == [[1, 1, 2, 2], [6, 9, 8, 7]] and got[3].tolist() == [2, 5, 4, 0]


def test_links_between_dense_groups(spark):
    """Two groups, nearer within than to each other, but linked; each longer than lists become."""
    rng = np.random.default_rng(7)
    one, two = np.eye(64)[:2]
    centers = np.repeat([one, 0.9666 * one + (1 - 0.9666**2) ** 0.5 * two], 300, axis=0)
    x = (centers + 0.1 / 8 * rng.standard_normal((600, 64))).astype(np.float32)
    rows = [(i, [float(c) for c in v], 0, 0, 0.0) for i, v in enumerate(x)]
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    links = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert links.min() > 299
    found = nearvectors.vector_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {i: (int(n), 0) for i, n in enumerate(links)}


def reached(spark, matrix):
    """Share of the true 20 nearest, by score, that every 20th vector gets."""
    x = matrix.astype(np.float32).astype(np.float64)
    rows = [(i, [float(c) for c in v], 0, 0, 0.0) for i, v in enumerate(x)]
    hits = 0
    for r in ann.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        scores = x @ x[r.query_id]
        scores[r.query_id] = -np.inf
        hits += r.score >= np.sort(scores)[-20] - 1e-12 * np.linalg.norm(x[r.query_id]) * np.linalg.norm(x[r.vec_id])
    return hits / (20 * len(x[::20]))


def test_nearest_within_a_dense_group(spark):
    """Near copies of unit length, alike in half precision and more than a pool holds."""
    rng = np.random.default_rng(5)
    center = rng.standard_normal(32)
    x = center / np.linalg.norm(center) + 0.005 / 32**0.5 * rng.standard_normal((1_200, 32))
    assert reached(spark, x / np.linalg.norm(x, axis=1)[:, None]) >= 0.93


def test_nearest_beside_a_very_long_vector(spark):
    x = np.random.default_rng(6).standard_normal((1_000, 16))
    x[7] *= 1e7
    assert reached(spark, x) >= 0.93


def test_nearest_rows_of_a_block():
    """All pairs of a block are compared, whether its rows differ or are copies of each other."""
    rng = np.random.default_rng(13)
    x = rng.standard_normal((1_300, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[400:] = x[400]
    for size, part in ((7, x), (7, x[:400]), (7, x[:5]), (40, x[:2])):
        rows, near, sims = nndescent._closest(part, size, rows=100)
        every = part @ part.T
        np.fill_diagonal(every, -np.inf)
        count = min(size, len(part) - 1)
        assert rows.tolist() == np.repeat(np.arange(len(part)), count).tolist() and (rows != near).all()
        assert len(set(zip(rows.tolist(), near.tolist()))) == len(rows)
        assert np.allclose(sims.reshape(-1, count), -np.sort(-every, axis=1)[:, :count], atol=1e-5)


@pytest.mark.parametrize("dense", [False, True])
def test_proposals_do_not_grow_with_the_buckets(spark, monkeypatch, dense):
    """Rows out of the joins of all rounds, in four buckets: only entries that lists lack leave, and few are lacking."""
    monkeypatch.setattr(nndescent, "BUCKET", 800)
    rng = np.random.default_rng(14)
    x = rng.standard_normal((1_600, 24))
    if dense:
        x[:700] = x[0] + 0.05 * rng.standard_normal((700, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    join, made = nndescent._joined, []

    def joined(gathered, lists, *rest):
        proposals = nndescent.settle(join(gathered, lists, *rest), "proposals")
        entries = proposals.select("node", nndescent.F.explode("ids").alias("id"))
        assert entries.join(lists.select("node", nndescent.F.explode("ids").alias("id")), ["node", "id"]).isEmpty()
        made.append(proposals.count())
        return proposals

    monkeypatch.setattr(nndescent, "_joined", joined)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, vector array<double>")
    nodes = nndescent.settle(vectors.select("node", nndescent.lifted_column("f4")("vector", nndescent.F.lit(1.0)).alias("x")), "nodes")
    assert nndescent.buckets_for(len(x), ann.GRAPH) == 4
    lists = {r.node: r.ids for r in nndescent.neighbour_graph(nodes, len(x), ann.GRAPH).select("node", "ids").collect()}
    every = x @ x.T
    np.fill_diagonal(every, -np.inf)
    truth = np.argsort(-every, axis=1)[:, :40]
    assert made and sum(made) <= 2 * len(x)
    assert np.mean([len(set(t) & set(lists[i])) / 40 for i, t in enumerate(truth.tolist())]) >= 0.95
