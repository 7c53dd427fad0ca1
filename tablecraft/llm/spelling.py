"""Spelling variants: words that differ by one letter, found with blocked Gram matrices.

A word is the vector of its letter counts. One inserted or deleted letter gives two vectors of squared
distance 1, one replaced letter of squared distance 2. The inner products of a block of words with another
are one matrix product, and with the squared norms they give all squared distances of the two blocks;
pairs at a distance of 1 or 2 are then compared letter by letter.

Blocks are by length, and only blocks of equal or adjacent lengths meet. A length is cut further: letters are
dealt to a few groups, and words of one block have the same number of letters in each group. One edit
changes these numbers by one up, one down, or one up and one down, so a word visits the few blocks that
it can reach and no others; no pair within one edit is lost. More words get more groups, which keeps
blocks small. A block with more than ``split`` words is cut into chunks that each visitor passes by. A task
keeps one chunk at a time and streams visitors past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .common import picked, query, table

#: Maximal runs of these letters are words; A-Z alone are lower-cased.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, RAREST, DAMAGE = 5, 3, 97
#: A form occurs at least this many times as often as its variant.
RATIO = 2
#: Words that one task keeps of a block.
SPLIT = 2048
#: Letters in the usual order of their frequency, dealt to the groups in turn; others go by code point.
COMMON = "etaoinshrdlcumwfgypbvkjxqz"
#: Distances (words of a chunk times visitors) held at once, and letters compared at once.
_TILE, _LETTERS = 1 << 22, 1 << 22


def word_counts(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shortest: int = SHORTEST,
    rarest: int = RAREST,
    damage: int = DAMAGE,
) -> DataFrame:
    """``(word, n)``: the words of all texts of at least ``shortest`` letters that occur ``rarest`` times or more.

    From a run with a crc32 of ``<id>:<run>`` that ``damage`` divides, one letter is deleted first. A null id
    counts as empty. Occurrences are summed per task before the shuffle, so a word of any share of all rows
    sends one row per task.
    """
    rows = picked(docs, doc_id=id_column, text=text_column)
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))
    each = rows.select("doc_id", F.explode(runs).alias("run"))
    marked = each.withColumn("h", F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % damage != 0, F.col("run")).otherwise(
        F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    )
    counted = marked.select(word.alias("word")).filter(F.length("word") >= shortest).groupBy("word")
    return counted.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= rarest)


def groups_for(words: int) -> int:
    """How many groups of letters cut the blocks of a table with so many words."""
    return max(2, round(np.log2(max(words, 1)) / 2) - 4)


def _group_of(codes: np.ndarray, groups: int) -> np.ndarray:
    dealt = np.arange(256) % groups
    for place, letter in enumerate(COMMON):
        dealt[ord(letter)] = place % groups
    return np.where(codes < 256, dealt[np.minimum(codes, 255)], codes % groups)


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words as (code points of all, first place of each and the end)."""
    lengths = pa.compute.utf8_length(words).to_numpy(zero_copy_only=False)
    codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _blocks(words: pa.Array, groups: int) -> np.ndarray:
    """Row per word: its length, then its number of letters per group."""
    codes, starts = _letters(words)
    lengths = np.diff(starts)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    sums = np.bincount(owner * groups + _group_of(codes, groups), minlength=len(lengths) * groups)
    return np.column_stack([lengths, sums.reshape(-1, groups)]).astype(">i4")


def _keys(blocks: np.ndarray) -> pa.Array:
    """Blocks as binary values that sort as their numbers do."""
    packed = np.ascontiguousarray(blocks)
    width = packed.shape[1] * packed.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(packed), [None, pa.py_buffer(packed)]).cast(pa.binary())


def _homes(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([_keys(_blocks(batch.column("word"), groups))], ["block"])


def _visits(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Each word once at home (``visitor`` 0), then as a visitor: of its own block (1) and of others (2).

    Of two blocks that can hold words one edit apart, the words of the smaller key visit the larger: those
    of one letter more, and those of the same length with a letter moved to an earlier group.
    """
    unit = np.eye(groups + 1, dtype=int)[1:]
    longer = [unit[i] + np.eye(groups + 1, dtype=int)[0] for i in range(groups)]
    moved = [unit[i] - unit[j] for i in range(groups) for j in range(i + 1, groups)]
    for batch in batches:
        for start in range(0, batch.num_rows, 8192):
            part = batch.slice(start, 8192)
            own = _blocks(part.column("word"), groups)
            rows = [(np.arange(len(own)), own, 0), (np.arange(len(own)), own, 1)]
            for step in longer + moved:
                there = (own + step).astype(">i4")
                real = np.flatnonzero((there >= 0).all(axis=1))
                rows.append((real, there[real], 2))
            index = pa.array(np.concatenate([r[0] for r in rows]))
            kind = np.concatenate([np.full(len(r[0]), r[2], np.int8) for r in rows])
            yield pa.RecordBatch.from_arrays(
                [_keys(np.concatenate([r[1] for r in rows])), pa.array(kind), *(part.column(c).take(index) for c in ("word", "n"))],
                ["block", "visitor", "word", "n"],
            )


class _Chunk:
    """The words of one chunk at home, as letters and as letter counts."""

    def __init__(self) -> None:
        self.parts: list[tuple[pa.Array, pa.Array]] = []
        self.ready = False

    def add(self, words: pa.Array, n: pa.Array) -> None:
        self.parts.append((words, n))

    def settled(self) -> None:
        if not self.ready:
            self.words, self.n = (pa.concat_arrays(x) for x in zip(*self.parts))
            codes, starts = _letters(self.words)
            self.length = int(starts[1])
            self.spelt = codes.reshape(len(self.words), self.length)
            # Counts below 1,000 have sums of squares that single precision holds exactly.
            self.kind = np.float32 if self.length < 1000 else np.float64
            self.letters = np.unique(codes)
            self.counts, self.norms = self.counted(codes, starts)
            self.ready = True

    def counted(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the letters that this chunk has, and the squared norms over all letters."""
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        every, column = np.unique(codes, return_inverse=True)
        counts = np.bincount(owner * len(every) + column, minlength=(len(starts) - 1) * len(every)).reshape(-1, len(every))
        place = np.minimum(np.searchsorted(every, self.letters), len(every) - 1)
        shared = np.where(every[place] == self.letters, counts[:, place], 0)
        return shared.astype(self.kind), (counts.astype(self.kind) ** 2).sum(axis=1)

    def near(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place at home, place among ``words``) of all pairs one edit apart; ``words`` have one length."""
        codes, starts = _letters(words)
        spelt = codes.reshape(len(words), -1)
        found = []
        step = max(1, _TILE // len(self.words))
        for lo in range(0, len(words), step):
            hi = min(lo + step, len(words))
            counts, norms = self.counted(codes[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo])
            squares = self.counts @ counts.T
            squares *= -2
            squares += self.norms[:, None]
            squares += norms[None]
            i, j = np.nonzero((squares > 0.5) & (squares < 2.5))
            wide = max(1, _LETTERS // self.length)
            for at in range(0, len(i), wide):
                a, b = i[at : at + wide], j[at : at + wide] + lo
                kept = self.one_edit(self.spelt[a], spelt[b])
                found.append((a[kept], b[kept]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int))

    @staticmethod
    def one_edit(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Row by row: of equal length with one difference, or ``one`` is ``two`` with a letter more."""
        if one.shape[1] == two.shape[1]:
            return (one != two).sum(axis=1) == 1
        end = np.ones((len(one), 1), bool)
        ahead = np.hstack([one[:, :-1] != two, end]).argmax(axis=1)
        behind = np.hstack([(one[:, 1:] != two)[:, ::-1], end]).argmax(axis=1)
        return ahead + behind >= two.shape[1]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and chunk, homes first: keep the chunk's homes, stream its visitors past them."""
    key, chunk = None, _Chunk()
    for batch in batches:
        blocks, kinds = batch.column("block"), batch.column("visitor").to_numpy(zero_copy_only=False)
        raw = np.array(blocks.to_pylist() + [b""], object)
        chunks = batch.column("chunk").to_numpy(zero_copy_only=False)
        size = pa.compute.utf8_length(batch.column("word")).to_numpy(zero_copy_only=False)
        new = (raw[1:-1] != raw[:-2]) | (chunks[1:] != chunks[:-1]) | (kinds[1:] != kinds[:-1]) | (size[1:] != size[:-1])
        turns = np.flatnonzero(new) + 1
        for lo, hi in zip([0, *turns.tolist()], [*turns.tolist(), len(kinds)]):
            if hi == lo:
                continue
            words, n = batch.column("word").slice(lo, hi - lo), batch.column("n").slice(lo, hi - lo)
            if (raw[lo], chunks[lo]) != key:
                key, chunk = (raw[lo], chunks[lo]), _Chunk()
            if kinds[lo] == 0:
                chunk.add(words, n)
            elif chunk.parts:
                chunk.settled()
                i, j = chunk.near(words)
                if len(i):
                    a, b = chunk.words.take(pa.array(i)), words.take(pa.array(j))
                    if kinds[lo] == 1:  # both words of such a pair come by
                        once = pa.compute.less(a, b)
                        a, b, i, j = a.filter(once), b.filter(once), i[once.to_numpy(zero_copy_only=False)], j[once.to_numpy(zero_copy_only=False)]
                    m, o = chunk.n.take(pa.array(i)), n.take(pa.array(j))
                    yield pa.RecordBatch.from_arrays(
                        [pa.concat_arrays(x) for x in ((a, b), (b, a), (o, m))], ["word", "near", "near_n"]
                    )


def near_words(words: DataFrame, split: int = SPLIT) -> DataFrame:
    """``(word, near, near_n)``: every pair of different ``words (word, n)`` one edit apart, both ways.

    Each word must occur once and must not be empty.
    """
    groups = groups_for(words.count())
    at_home = words.mapInArrow(lambda b: _homes(b, groups), "block binary").groupBy("block").count()
    full = at_home.filter(F.col("count") > split).select(
        F.col("block").alias("_block"), F.ceil(F.col("count") / split).cast("int").alias("_chunks")
    )
    visits = words.mapInArrow(lambda b: _visits(b, groups), "block binary, visitor byte, word string, n long")
    joined = visits.join(full, F.col("block") == F.col("_block"), "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("_chunks")).cast("int")
    places = F.when(F.col("visitor") > 0, F.sequence(F.lit(0), F.col("_chunks") - 1)).otherwise(F.array(own))
    dealt = joined.select("block", F.explode(places).alias("chunk"), "visitor", "word", "n")
    key = ["block", "chunk"]
    ordered = dealt.repartition(*key).sortWithinPartitions(*key, "visitor", F.length("word"))
    return ordered.mapInArrow(_compare, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)``: the last of a chain of forms, by doubling the steps.

    A form occurs more often than its variant, so chains end. Each round is written to the shared folder.
    """
    steps = settle(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = steps.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        joined = steps.join(onward, F.col("root") == F.col("_at"), "left")
        if joined.filter(F.col("_to").isNotNull()).isEmpty():
            return steps
        steps = settle(joined.select("word", F.coalesce("_to", "root").alias("root")), "forms")


def spelling_variants(words: DataFrame, ratio: float = RATIO, split: int = SPLIT) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for ``words (word, n)``, each of which occurs once.

    ``n_near`` counts the words one edit away. The ``form`` is the one of them with the largest ``n``, of
    several the first in code-point order, if that is at least ``ratio`` times the word's; ``root`` ends the
    chain of forms. A word without a form is its own root. An empty table gives an empty result.
    """
    words = settle(words.select("word", F.col("n").cast("long").alias("n")), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    reached = near_words(words, split).groupBy(F.col("word").alias("_word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(reached, F.col("word") == F.col("_word"), "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")

    def when_form(value: Column) -> Column:
        return F.when(is_form, value)

    found = settle(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            when_form(F.col("best.form")).alias("form"), when_form(-F.col("best.less")).alias("form_n"),
        ),
        "variants",
    )
    roots = _roots(found.filter(F.col("form").isNotNull())).withColumnRenamed("word", "_word")
    return found.join(roots, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def document_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The spelling variants among the words of ``docs``.

    Null and empty texts have no words; a null id counts as empty text in the hash; repeated rows count as
    often as they occur; very long texts and words are read whole. Ties of forms go to the first word in
    code-point order. An empty table gives an empty result; other columns are ignored.
    """
    return spelling_variants(word_counts(docs, id_column, text_column))


@query("op11_spelling")
def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return document_variants(table(spark, folder, "documents"))
