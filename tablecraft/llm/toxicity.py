"""Toxicity of texts: boosted trees over dense features, with isotonic calibration.

Training uses a bounded sample of labelled rows, ``TRAIN_ROWS``; everything else covers all rows. Words
that mark labelled texts form a lexicon with weights, as do beginnings that several other such words
share. For the training rows it is learned crosswise on two halves, so that no text is measured with
words it contributed itself. A text then has some features: densities and weights of lexicon hits, hits near a second person, capitals,
punctuation, disguised spellings and length. Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .bpe import texts_of
from .common import held_out, picked, query, table

#: Labelled rows that a model is fitted on at most, taken in hash order.
TRAIN_ROWS = 8_000
#: Terms in a lexicon at most, those that mark labelled texts most strongly.
TERMS = 2_000
#: Standard deviations by which a term must be more frequent in toxic texts than chance has it.
STRENGTH = 4.5
LIMIT = 0.7
SEED = 11
#: Lengths of the word beginnings that can be terms, and how many words must share one.
PREFIXES = (3, 4, 5, 6, 7)
SHARED = 3

# Words for the second person, and what stands for letters in disguised spellings.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos ti usted ustedes".split()
)
DISGUISES = str.maketrans("0134578@$!|", "oieastbasii")
_TOKEN = re.compile(r"\S+")
_WORD = re.compile(r"[^\W\d_]+")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")

FEATURES = (
    "word_density word_count stem_density stem_count mean_weight strongest second_person_near second_person_density capitals shouted "
    "exclaimed punctuation symbol_words disguised_hits stretched length"
).split()


class Lexicon(dict):
    """Weight of each word, looked up once and remembered; negative where only a beginning is known."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 200_000:  # bounds memory only
            self.clear()
        found = self.weights.get(word, 0.0)
        if not found:
            found = -max((self.weights.get(word[:n] + "*", 0.0) for n in PREFIXES if len(word) >= n), default=0.0)
        self[word] = found
        return found


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The numbers that stand for a text, in the order of ``FEATURES``."""
    lowered = text.lower()
    words = _WORD.findall(lowered)
    count = max(1, len(words))
    weights = list(map(lexicon.__getitem__, words))
    hits = [i for i, w in enumerate(weights) if w]
    marked = [abs(weights[i]) for i in hits]
    stems = sum(weights[i] < 0 for i in hits)
    persons = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if persons and hits:
        ends = np.searchsorted(persons, np.array(hits) + 4) - np.searchsorted(persons, np.array(hits) - 3)
        near = int((ends > 0).sum())
    # Only tokens that hold more than letters can be disguised.
    odd = [t for t in _TOKEN.findall(lowered) if not t.isalpha()]
    disguised = symbols = 0
    for token in odd:
        core = token.strip(".,;:!?\"'()[]{}|-")
        if core and not core.isalpha() and any(c.isalpha() for c in core):
            symbols += 1
            plain = "".join(c for c in core.translate(DISGUISES) if c.isalpha())
            disguised += bool(plain and lexicon[plain]) and not any(lexicon[w] for w in _WORD.findall(core))
    size = max(1, len(text))
    letters = max(1, sum(map(len, words)))
    upper = sum(map(str.isupper, text))
    shouted = sum(len(w) > 2 and w.isupper() for w in _WORD.findall(text)) if upper > 2 else 0
    return [
        (len(hits) - stems) / count,
        math.log1p(len(hits) - stems),
        stems / count,
        math.log1p(stems),
        sum(marked) / count,
        max(marked, default=0.0),
        near / max(1, len(hits)),
        len(persons) / count,
        upper / letters,
        shouted / count,
        (text.count("!") + text.count("?")) / size,
        sum(map(text.count, ".,;:#$%&*|")) / size,
        symbols / count,
        disguised / count,
        len(_STRETCHED.findall(lowered)) / count,
        math.log1p(len(words)),
    ]


def feature_column(weights: dict[str, float]):
    """A function from a text column to ``array<double>``; null counts as empty."""

    def run(texts: pa.Array) -> pa.Array:
        lexicon = Lexicon(weights)
        return pa.array([features(t, lexicon) for t in texts_of(texts)], pa.list_(pa.float64()))

    return F.arrow_udf(run, T.ArrayType(T.DoubleType()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _words(texts: pa.Array) -> pa.Array:
    return pa.array([sorted(set(_WORD.findall(text.lower()))) for text in texts_of(texts)], pa.list_(pa.string()))


def _weighed(toxic: Column, clean: Column, toxic_rows: int, clean_rows: int) -> tuple[Column, Column]:
    """Of a term in so many toxic and clean texts: by how many standard deviations the toxic ones exceed
    chance, and its weight, which is 0 where that is too little."""
    share = toxic_rows / max(1, toxic_rows + clean_rows)
    if not 0 < share < 1:
        return F.lit(0.0), F.lit(0.0)
    seen = toxic + clean
    far = F.try_divide(toxic - seen * share, F.sqrt(seen * share * (1 - share)))
    strength = F.when(toxic >= max(2, math.ceil(0.01 * toxic_rows)), far).otherwise(F.lit(0.0))
    odds = F.log((toxic + 0.5) / (toxic_rows + 1)) - F.log((clean + 0.5) / (clean_rows + 1))
    return strength, F.when(strength >= STRENGTH, F.greatest(odds, F.lit(0.0))).otherwise(F.lit(0.0))


def _chosen(terms: DataFrame, kinds: list[tuple]) -> list[dict[str, float]]:
    """The strongest of ``terms`` with their weights for each kind; at most ``TERMS`` rows reach the driver."""
    pairs = [_weighed(*k) for k in kinds]
    rated = terms.select("term", F.greatest(*[s for s, _ in pairs]).alias("s"), *[w.alias(f"w{i}") for i, (_, w) in enumerate(pairs)])
    rows = rated.filter(F.col("s") >= STRENGTH).orderBy(F.desc("s"), "term").limit(TERMS).collect()
    return [{r.term: r[f"w{i}"] for r in rows if r[f"w{i}"] > 0} for i in range(len(kinds))]


def _lexicons(train: DataFrame) -> list[dict[str, float]]:
    """Weights learned on half 0, on half 1 and on both, from ``train (text, label, half)``.

    Texts that occur several times count once, or else any word of a copied text would mark it.
    """
    once = train.groupBy("text").agg(F.max("label").alias("label"), F.min("half").alias("half"))
    sizes = {(r.half, r.label): r["count"] for r in once.groupBy("half", "label").count().collect()}  # 4 rows
    cells = [(h, y) for h in (0, 1) for y in (1, 0)]
    words = once.select(F.explode(_words("text")).alias("term"), "half", "label").groupBy("term").agg(
        *[F.count_if((F.col("half") == h) & (F.col("label") == y)).alias(f"n{h}{y}") for h, y in cells]
    )
    words = settle(words, "words")
    kinds = []
    for halves in ((0,), (1,), (0, 1)):
        columns = [sum((F.col(f"n{h}{y}") for h in halves), F.lit(0)) for y in (1, 0)]
        kinds.append((*columns, *(sum(sizes.get((h, y), 0) for h in halves) for y in (1, 0))))
    chosen = _chosen(words, kinds)
    # What a chosen word has shown says nothing about other words that begin like it.
    known = sorted({term for lexicon in chosen for term in lexicon})
    others = words.filter(~F.col("term").isin(known)) if known else words
    starts = F.array(*[F.when(F.length("term") >= n, F.concat(F.substring("term", 1, n), F.lit("*"))) for n in PREFIXES])
    stems = others.select(F.explode(F.array_compact(starts)).alias("stem"), *[f"n{h}{y}" for h, y in cells])
    shared = stems.groupBy(F.col("stem").alias("term")).agg(
        *[F.sum(f"n{h}{y}").alias(f"n{h}{y}") for h, y in cells], F.count_if(F.col("n01") + F.col("n11") > 0).alias("words")
    )
    begun = _chosen(shared.filter(F.col("words") >= SHARED), kinds)
    return [a | b for a, b in zip(chosen, begun)]


@dataclass
class Model:
    """What scoring needs; ``trees`` is None where the labels allow no model, then ``prior`` is the score."""

    weights: dict[str, float]
    trees: object | None
    calibration: object | None
    prior: float


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` of the labelled documents that are not held out.

    ``labels (doc_id, toxic)``: null labels are left out, of several labels of an id the largest counts.
    Without both labels among the rows, every text gets the share of toxic rows as its score.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    mixed = F.xxhash64(F.col("doc_id").cast("string"))
    sample = known.orderBy(mixed, "doc_id").limit(rows).select(
        F.col("doc_id").alias("_id"),
        "label",
        F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("half")), F.lit(2)).cast("int").alias("half"),
        (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("part")), F.lit(4)) == 0).alias("calibrate"),
    )
    # Broadcast: at most ``rows`` rows. The texts of all other documents are not shuffled.
    texts = picked(docs, _doc=id_column, text=text_column)
    train = settle(texts.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).drop("_doc", "_id"), "training")
    first, second, both = _lexicons(train)
    # Each half is measured with the lexicon of the other.
    measured = F.when(F.col("half") == 0, feature_column(second)("text")).otherwise(feature_column(first)("text"))
    points = settle(train.select(measured.alias("features"), F.col("label").cast("double").alias("label"), "calibrate"), "points")
    points = points.withColumn("features", array_to_vector("features"))
    counts = {(r.calibrate, r.label): r["count"] for r in points.groupBy("calibrate", "label").count().collect()}  # 4 rows
    total, toxic = sum(counts.values()), sum(n for (_, y), n in counts.items() if y)
    prior = toxic / total if total else 0.0
    if not 0 < toxic < total:
        return Model(both, None, None, prior)
    apart = min(counts.get((c, y), 0) for c in (True, False) for y in (0.0, 1.0)) >= 10
    # With few rows of a label, trees and calibration share them.
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.2, minInstancesPerNode=2, seed=SEED).fit(
        points.filter(~F.col("calibrate")) if apart else points
    )
    rated = _raw(trees, points.filter("calibrate") if apart else points)
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label").fit(rated.select("raw", "label"))
    return Model(both, trees, calibration, prior)


def _raw(trees, df: DataFrame) -> DataFrame:
    return trees.transform(df).withColumn("raw", vector_to_array("probability")[1])


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``(row, score)``: each row of ``docs`` as a struct, and its score from 0 to 1.

    Null and empty texts are scored by their features, all 0. All rows and columns stay.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if model.trees is None:
        return rows.withColumn("score", F.lit(float(model.prior)))
    measured = rows.withColumn("features", array_to_vector(feature_column(model.weights)(F.col(f"row.`{text_column}`"))))
    rated = model.calibration.transform(_raw(model.trees, measured).select("row", "raw"))
    return rated.select("row", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "prediction")).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs``.

    Rows of which the id's crc32 leaves 1 when divided by 3 are held out from all fitting. Null ids are
    not held out and carry no label. Repeated rows get the same score each; an empty table gives an empty
    result; other columns are ignored.
    """
    rows = picked(docs, doc_id=id_column, text=text_column)
    rated = score(rows, fit(rows, labels))
    doc = F.col("row.doc_id")
    return rated.select(
        doc.alias("doc_id"), held_out(doc).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the rows that are predicted toxic; columns and other rows stay as they are."""
    model = fit(picked(docs, doc_id=id_column, text=text_column), labels)
    return score(docs, model, text_column).filter(F.col("score") < LIMIT).select("row.*")


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
