import random

import numpy as np
import pytest
import xxhash

from tablecraft.llm import simhash
from tablecraft.llm.components import components


def plain(text):
    words = (text or "").encode().lower().split()
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    """Component of each row by comparing all pairs."""
    marks = [plain(t) for _, t in rows]
    label = {i: i for i in range(len(rows))}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 3:
                label[find(i)] = find(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[find(i)] = min(doc, smallest.get(find(i), doc))
    return [(doc, f"{marks[i]:016x}", smallest.get(find(i))) for i, (doc, _) in enumerate(rows)]


def test_every_anchor_in_reach():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 23, 200)
    index, anchor, beyond = simhash.anchors(values)
    low, high, _, _ = simhash._golay()
    words = np.flatnonzero((low[None] ^ high[:2048, None]).ravel() == 0)
    assert len(words) == 4096
    for i, value in enumerate(values):
        distance = np.bitwise_count(words ^ value)
        assert set(words[distance <= 6]) == set(anchor[index == i])
        assert (np.maximum(np.bitwise_count(anchor[index == i] ^ value).astype(int) - 3, 0) == beyond[index == i]).all()


@pytest.mark.parametrize("split", [2048, 3])
def test_links_equal_all_pairs(spark, split):
    """With few homes per anchor, refined anchors and chunks of homes are used as well."""
    rng = random.Random(5)
    marks = set()
    for _ in range(40):
        center = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            marks.add(center ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(4))}))
    marks = sorted(marks)
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    got = {r.node: r.component for r in components(simhash.links(spark.createDataFrame([(m,) for m in signed], "fingerprint long"), split)).collect()}
    near = np.bitwise_count(np.array(marks, np.uint64)[:, None] ^ np.array(marks, np.uint64)[None]) <= 3
    label = np.arange(len(marks))
    while (lower := np.where(near, label[None], len(marks)).min(axis=1)).tolist() != label.tolist():
        label = lower
    assert len({(i, got.get(m, m)) for i, m in zip(label.tolist(), signed)}) == len(set(label.tolist()))


def test_documents_against_all_pairs(spark, rows):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=400)) for _ in range(12)]
    data = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (4, "one TWO"), (None, "one two"), (None, "alone"), (5, "É é x"), (6, "é é x")]
    for i in range(60):
        text = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text))] = "changed"
        data.append((100 + rng.randrange(50), " ".join(text)))
    data.append((7, "long " * 50_000))
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in data], "doc_id long, text string, fingerprint string, rep int")
    assert rows(simhash.simhash_components(docs)) == sorted(brute(data), key=repr)


def test_empty(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(9, 9), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 5 for i in range(200, 260)} | {5: 5}
