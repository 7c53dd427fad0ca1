import random
import zlib

import pytest

from tablecraft.llm import toxicity


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abdeghiklnoprstu", k=rng.randrange(3, 9))) for _ in range(400)]
    insults = ["numpty", "twerp", "zorb"] + ["grawl" + e for e in ("ing", "ed", "er", "s", "ish", "ard", "ly")]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randrange(20, 120))
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randrange(3, 7)):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def data(spark):
    docs, labels = corpus()
    odd = [(1000, None), (1001, ""), (None, "numpty twerp numpty"), (5, docs[5][1]), (1002, "fine words " * 20_000)]
    frame = spark.createDataFrame([(d, t, 0.5, "x") for d, t in docs + odd], "doc_id long, text string, score double, lang string")
    marks = spark.createDataFrame(labels + [(None, 1), (7, None), (0, 0)], "doc_id long, toxic int")
    return frame.repartition(3).cache(), marks, dict(labels)


def test_held_out_accuracy(data):
    docs, marks, truth = data
    found = toxicity.toxicity(docs, marks).collect()
    assert len(found) == 405
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    rated = [(r.predicted, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    assert sum(p == y for p, y in rated) / len(rated) > 0.95
    assert {r.predicted for r in found if r.doc_id in (1000, 1001, 1002)} == {0}


def test_held_out_labels_do_not_matter(spark, data):
    docs, marks, _ = data
    flipped = marks.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    key = lambda r: (r.doc_id is None, r.doc_id, r.score)
    one = sorted(toxicity.toxicity(docs, marks).collect(), key=key)
    two = sorted(toxicity.toxicity(docs, flipped).collect(), key=key)
    assert one == two


def test_filter_keeps_columns_and_clean_rows(data):
    docs, marks, truth = data
    kept = toxicity.without_toxic(docs, marks)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    clean = [d for d, y in truth.items() if not y]
    assert len(set(clean) & set(ids)) > 0.98 * len(clean)
    assert sum(truth.get(i, 0) for i in ids) < 0.1 * sum(truth.values())


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)], [(0, 1), (2, 0), (3, 0)]])
def test_few_labels(spark, labels):
    docs = spark.createDataFrame([(i, "some text") for i in range(4)], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(docs, marks).collect())
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0


def test_features_of_disguises():
    lexicon = toxicity.Lexicon({"numpty": 3.0, "grawl*": 2.0})
    row = dict(zip(toxicity.FEATURES, toxicity.features("N.U.M.P.T.Y! you GRAWLING nummmmpty plain", lexicon)))
    assert row["disguised_hits"] > 0 and row["stem_density"] > 0 and row["stretched"] > 0 and row["shouted"] > 0
    assert row["second_person_near"] == 1 and row["strongest"] == 2.0
    assert not any(toxicity.features("", lexicon))
