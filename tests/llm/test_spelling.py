import random
import re
import zlib
from collections import Counter

import pytest

from tablecraft.llm import spelling


def counts(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    form, result = {}, []
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        result.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(result, key=repr)


def texts():
    rng = random.Random(4)
    stems = ["".join(rng.choices("abcdeé", k=rng.randrange(4, 9))) for _ in range(30)] + ["Éclat", "école", "ÀÀÀÀÀÀ", "x" * 1500]
    rows = [(1, None), (2, ""), (3, "12 -- 4"), (None, "Lonely lonely LONELY lonelY"), (4, "Ünder ünder Ünder"), (4, "Ünder ünder Ünder")]
    for i in range(500):
        words = []
        for _ in range(rng.choice([3, 20])):
            w = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + rng.choice("abcé") + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice("abcE") + w[at + 1 :]])
            words.append(w)
        rows.append((100 + i, rng.choice([" ", ", ", "9"]).join(words)))
    rows.append((7, "very long text " * 20_000))
    return rows


def test_documents_against_all_pairs(spark, rows):
    data = texts()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in data], "doc_id long, text string, word string, n int")
    expected = brute(counts(data))
    assert sum(r[1] is not None for r in expected) > 20 and any(len(r[0]) >= 1499 for r in expected)
    assert rows(spelling.document_variants(docs)) == expected


@pytest.mark.parametrize("groups, split", [(2, 3), (5, 2048), (9, 3)])
def test_blocks_and_chunks_lose_no_pair(spark, rows, monkeypatch, groups, split):
    monkeypatch.setattr(spelling, "groups_for", lambda words: groups)
    words = counts(texts())
    words = {w: n for w, n in words.items() if len(w) < 100}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    expected = sorted([(a, b, words[b]) for a in words for b in words if one_edit(a, b)], key=repr)
    assert rows(spelling.near_words(df, split)) == expected


def test_chain_of_forms_and_ties(spark, rows):
    words = {"aaaaaaaa": 3, "aaaaaaab": 6, "aaaaaabb": 12, "aaaaabbb": 24, "aaaabbbb": 48, "zzzzz": 5, "zzzzy": 10, "zzzzx": 10}
    got = spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n int"))
    assert rows(got) == brute(words)


def test_empty(spark):
    assert spelling.document_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
