import hashlib
import random
import re

import pytest

from tablecraft.llm import mixing

WEIGHTS, REPEATS = (5, 2, 1), 3


def targets(sizes):
    """Shares by weight, capped and reshared until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_, target = sum(sizes.values()), list(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if level * weight[s] > REPEATS * sizes[s]]
        if not above:
            return target | {s: level * weight[s] for s in open_}
        for s in above:
            target[s] = REPEATS * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def plain(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sums = {}
    for (_, _, source), n in zip(rows, size):
        sums[source] = sums.get(source, 0) + n
    goal = targets(sums)
    units = {}
    for (doc, _, source), n in zip(rows, size):
        units[source, doc, n] = units.get((source, doc, n), 0) + 1
    key = lambda d: hashlib.md5(str(d).encode()).hexdigest() if d is not None else "~"
    taken, at = {}, dict.fromkeys(sums, 0)
    for (source, doc, n), copies in sorted(units.items(), key=lambda u: (str(u[0][0]), key(u[0][1]), u[0][2])):
        total = 0
        for p in range(REPEATS):
            start = at[source] + p * sums[source]
            total += max(0, min(n * copies, round(goal[source]) - start)) // copies
        taken[source, doc, n] = total
        at[source] += n * copies
    return [(d, n, sums[s], goal[s], taken[s, d, n]) for (d, _, s), n in zip(rows, size)]


def data(seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 30, 400])), rng.choice(["big"] * 6 + ["b", "é", "Z", None, "z"])) for i in range(200)]
    rows += [(900, "a\x0bb\xa0c", "tiny"), (901, None, "tiny"), (902, "", "none"), (None, "x y", "big"), (None, "x y", "big")]
    return rows + [(903, "same words", "big")] * 3 + [(904, "long " * 60_000, "big")] * (seed % 2)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_plain_mix(spark, seed):
    rows = data(seed)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size long, rank long")
    plan = mixing.mix_plan(docs.repartition(5)).collect()
    got = sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in plan), key=repr)
    assert got == sorted(((d, n, s, round(t, 6), k) for d, n, s, t, k in plain(rows)), key=repr)
    for source in {r.source for r in plan}:
        own = [r for r in plan if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3
        assert all(r.taken <= 3 * r.size for r in own)


def test_positions_follow_the_demand(spark):
    """Numeric integration of each schedule up to a document's position gives its place in the line."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    plan = mixing.mix_plan(docs).collect()
    for rank, source in enumerate(["s0", "s1", "s2"]):
        curve = mixing.CURRICULA[rank]

        def area(until):
            steps = 20_000
            total = 0.0
            for i in range(steps):
                t = until * (i + 0.5) / steps
                (t0, w0), (t1, w1) = next((a, b) for a, b in zip(curve, curve[1:]) if t <= b[0])
                total += (w0 + (w1 - w0) * (t - t0) / (t1 - t0)) * until / steps
            return total

        passes = sorted((p.position, p.words) for r in plan if r.source == source for p in r["passes"])
        target, upto = next(r.target for r in plan if r.source == source), 0
        for position, words in passes[:: len(passes) // 5 or 1]:
            upto = sum(w for p, w in passes if p < position) + words / 2
            assert abs(area(position) / area(1.0) - upto / target) < 1e-3


def test_documents_in_order(spark):
    docs = spark.createDataFrame(data(2), "doc_id long, text string, source string")
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    words = sum(len((r.text or "").split()) for r in mixed.collect())
    whole = sum(len((t or "").split()) for _, t, _ in data(2))
    assert abs(words - whole) < 0.02 * whole + 400
    again = mixing.mix_documents(docs)
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, again.collect()))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_plan(none).count() == 0 and mixing.mix_documents(none).count() == 0


def test_bad_curricula():
    for curve in [((0.0, 1.0), (0.5, 1.0)), ((0.0, -1.0), (1.0, 1.0)), ((0.0, 0.0), (1.0, 0.0))]:
        with pytest.raises(ValueError):
            mixing._segments(curve)
