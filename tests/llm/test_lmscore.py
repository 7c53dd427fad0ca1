import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablecraft.llm import lmscore
from tablecraft.llm.lmscore import Model, lm_scores

#: So many bits per entry that a wrong answer of the filter is out of the question.
SURE = Model(hashes=24)


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def level(n, base):
    q = 0
    while base**q <= n:
        q += 1
    return q


def brute(rows, teaches, model):
    """Plain counts, quantised the same way, without hashes and filter."""
    one, grams = Counter(), Counter()
    for doc, text in rows:
        if teaches(doc):
            t = tokens(text)
            one.update(t)
            padded = ["start", *t]
            grams["start",] += 1
            for order in range(1, model.order + 1):
                grams.update(tuple(padded[max(i - order + 1, 0) : i + 1]) for i in range(1, len(padded)) if order == 1 or i >= order - 1)
    total, distinct = sum(one.values()), len(one)
    ends = [math.ceil(model.base**q) for q in range(97)]

    def value(gram):
        q = level(grams[gram], model.base)
        return (ends[q - 1] + max(ends[q] - 1, ends[q - 1])) / 2 if q else 0.0

    result = []
    for doc, text in rows:
        t = tokens(text)
        base = sum(math.log10((one[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t)
        score, padded = 0.0, ["start", *t]
        for i in range(1, len(padded)):
            share = min((value((padded[i],)) + 0.1) / (total + 0.1 * (distinct + 1)), 1)
            for order in range(2, model.order + 1):
                if i >= order - 1:
                    gram = tuple(padded[i - order + 1 : i + 1])
                    seen = value(gram[:-1])
                    share = (min(value(gram), seen) + model.strength * share) / (seen + model.strength)
            score += math.log10(share)
        result.append((doc, teaches(doc), len(t), sum(one[w] > 0 for w in t), total, base, score))
    return sorted(result, key=repr)


def teaches(doc):
    return doc is None or zlib.crc32(str(doc).encode()) % 10 != 0


def column():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, F.lit(True))


def texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "x" * 100]
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "W1 w1 É"), (4, "w2 w2 w2"), (4, "w2 w2 w2"), (5, "nowhere else seen")]
    rows += [(100 + i, " ".join(rng.choices(words, weights=range(1, 64), k=rng.randrange(40)))) for i in range(200)]
    return rows + [(7, "again and again " * 30_000)]


def close(got, expected):
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert g[:5] == e[:5] and g[5] == pytest.approx(e[5], rel=1e-9) and g[6] == pytest.approx(e[6], rel=1e-9)


def scored(spark, data, **settings):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in data], "doc_id long, text string, score int, levels string")
    return sorted([tuple(r) for r in lm_scores(docs, column(), **settings).collect()], key=repr)


def test_scores_against_plain_counts(spark):
    close(scored(spark, texts(), model=SURE), brute(texts(), teaches, SURE))


@pytest.mark.parametrize("head", [0, 20])
def test_segments_and_rare_tokens(spark, head):
    """Many small segments, read in chains, give what the same chunks give at once; most tokens are counted by the join."""
    whole = scored(spark, texts(), chunk=60_000)
    got = scored(spark, texts(), chunk=60_000, segment=1000, head=head)
    close(got, whole)
    assert [g[:5] for g in got] == [e[:5] for e in brute(texts(), teaches, SURE)]


def test_longer_ngrams(spark):
    """The context of the second word is the start and the first word: no shorter one at the start of a text."""
    rows = [(i, t) for i, t in enumerate(["a b c", "a b d", "a b c a b c", "", "b", "a b c"])]
    model = Model(order=3, hashes=24, strength=2.0)
    got = {r.doc_id: r.score for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect()}
    assert got[0] > got[1] and got[0] == got[5] and got[4] < got[3] < 0


def test_false_answers_only_raise_counts(spark):
    data = texts()
    exact = {r[0]: r[6] for r in brute(data, teaches, Model())}
    found = {r[0]: r[6] for r in scored(spark, data)}
    assert sum(abs(found[d] - exact[d]) > 0.05 * abs(exact[d]) for d in exact) < 0.05 * len(exact)


def test_ngrams_explain_held_out_texts_better_than_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lm_scores(docs, column()).filter(~F.col("training"))
    row = held.agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert row.score > row.base


def test_no_teacher_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = sorted(lm_scores(docs, F.lit(False)).collect())
    assert [tuple(r)[:5] for r in got] == [(1, False, 3, 0, 0), (2, False, 1, 0, 0)] and got[0].base_score == 0
    assert lm_scores(docs.limit(0)).count() == 0


def test_query(spark):
    from tablecraft.llm.queries import QUERIES

    got = QUERIES["op13_lmscore"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert got.count() == 200 and got.filter("score > 0 or base_score > 0 or held_out != (crc32(cast(cast(doc_id as string) as binary)) % 10 = 0)").count() == 0
