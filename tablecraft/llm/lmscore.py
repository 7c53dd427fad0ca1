"""Language-model scores from n-gram counts in a log-frequency Bloom filter.

A count is quantised on a log scale, and an n-gram of level q enters the filter q times, once with each of
the numbers 1 to q. Reading a count asks for 1, 2, 3 ... until the filter says no. A false answer can only
raise a count, and the chance of that falls with each further level. Probabilities of all orders come from
such probes, each order smoothed by the one below.

N-grams are hashed and counted per task first, and go to chunks by their hash; the task that gets a chunk sums
its counts and sets its bits. A chunk has as many bits as its own entries need, so the filter grows with the
corpus and keeps its error rate. It is broadcast in segments of a checked size: one where it fits, else one
after the other, and rows carry the levels read so far from segment to segment.

Exact counts of single tokens are kept beside it: those of the frequent tokens, at most ``HEAD``, are
broadcast, the others meet their documents in a join.
"""

from __future__ import annotations

import contextlib
import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .common import picked, query, table

#: Bytes of a segment of the filter, as it is broadcast.
SEGMENT = 96 << 20
#: Bytes of text per chunk of the filter; a task holds the counts of one chunk.
CHUNK = 4 << 20
#: Exact counts broadcast at most, of tokens of at most ``HEAD_BYTES`` bytes.
HEAD, HEAD_BYTES = 1 << 17, 64
#: N-grams counted before they are passed on, and bytes of text handled at once.
BUFFER, BLOCK = 1 << 21, 1 << 19
#: Rows of an Arrow batch.
ROWS = 500
#: Segments read one after the other before rows are written down.
CHAIN = 4
LEVELS = 96
#: Added to the count of each token, and once more for all unknown ones together.
ALPHA = 0.1
#: Hashes of a text's start and of its end, which as a token is empty, as no word is; odd bases of hashes.
_START, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASES = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(_LOWER, [9, 10, 11, 12, 13, 32])


@dataclass(frozen=True)
class Model:
    """``order`` words in an n-gram at most; ``base`` of the log scale of counts; ``hashes`` per entry of the
    filter; ``strength`` of the lower order in smoothing, as a count; n-grams that occur less than
    ``rarest`` times stay out of the filter."""

    order: int = 2
    base: float = 1.5
    hashes: int = 5
    strength: float = 20.0
    rarest: int = 1

    def level(self, counts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base ** np.arange(LEVELS), counts, side="right")

    def counts(self) -> np.ndarray:
        """The count that each level stands for: the middle of the whole numbers it covers, 0 for level 0."""
        ends = np.ceil(self.base ** np.arange(LEVELS + 1))
        return np.concatenate([[0.0], (ends[:-1] + np.maximum(ends[1:] - 1, ends[:-1])) / 2])


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def _entry(hashes: np.ndarray, level: int) -> np.ndarray:
    """Where the bits of an entry (n-gram, level) start. Each level starts anew: further steps from one start
    would, for some n-grams, come back to bits of their own."""
    return _mixed(hashes + np.uint64(level * int(_START) % (1 << 64)))


def _step(hashes: np.ndarray) -> np.ndarray:
    """By how much each next bit of an entry moves on."""
    return _mixed(hashes ^ _END) | np.uint64(1)


def _bits(places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places as bits of chunks of ``sizes`` bits."""
    return ((places >> np.uint64(32)) * sizes) >> np.uint64(32)


@dataclass(frozen=True)
class _Words:
    """The tokens of some texts, one text after the other, each with its end.

    Two hashes tell tokens apart, 128 bits together; the bytes of a token are read only where they are asked for.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    sizes: np.ndarray
    one: np.ndarray
    two: np.ndarray

    def token(self, number: int) -> bytes:
        return self.data[self.starts[number] : self.ends[number]].tobytes()


def _powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse, in 64 bits."""
    found = []
    for number in (base, pow(base, -1, 1 << 64)):
        powers = np.full(count + 1, number, np.uint64)
        powers[0] = 1
        found.append(np.multiply.accumulate(powers))
    return tuple(found)


@functools.cache
def _tables(count: int) -> tuple:
    return tuple(_powers(base, count) for base in _BASES)


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word: a polynomial in its bytes, as a difference of running sums.

    Running sums go over about ``BLOCK`` bytes at a time; a longer word is taken alone.
    """
    hashes = np.zeros((2, len(starts)), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, side="right")))
        first, last = int(starts[at]), int(ends[to - 1])
        part = data[first:last].astype(np.uint64) + np.uint64(1)
        tables = _tables(BLOCK) if len(part) <= BLOCK else [_powers(base, len(part)) for base in _BASES]
        begin, end = starts[at:to] - first, ends[at:to] - first
        for k, (powers, inverse) in enumerate(tables):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * powers[: len(part)], dtype=np.uint64)])
            hashes[k, at:to] = (sums[end] - sums[begin]) * inverse[begin]
        at = to
    return _mixed(hashes[0]), hashes[1]


def words_of(texts: pa.LargeBinaryArray) -> _Words:
    """Words between ASCII white space with A-Z lower-cased, then an end, for each of some texts."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.empty(0, np.uint8)
    data, offsets = _LOWER[data], offsets - offsets[0]
    inside = np.zeros(len(data) + 2, bool)  # white space before and behind
    inside[1:-1] = ~_SPACE[data]
    begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]  # at a place, up to a place
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cut], ends[cut] = inside[cut + 1], inside[cut]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends)
    sizes = np.diff(np.searchsorted(starts, offsets)) + 1
    words = np.ones(int(sizes.sum()), bool)
    words[np.cumsum(sizes) - 1] = False
    every = [np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), _END), np.full(len(words), _END)]
    for whole, values in zip(every, (starts, ends, *_hashed(data, starts, ends))):
        whole[words] = values
    return _Words(data, every[0], every[1], sizes, every[2], every[3])


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.LargeBinaryArray]]:
    """The texts of a batch by about ``BLOCK`` bytes: (first row, row behind the last, texts)."""
    texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
    ends = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right")))
        yield at, to, texts.slice(at, to - at)
        at = to


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each value among the different ones, the different ones), by hash."""
    found = pa.array(values).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_numpy()


def _before(values: np.ndarray, sizes: np.ndarray, start) -> np.ndarray:
    """The value of the token before each token of its text; ``start`` for the first."""
    moved = np.concatenate([values[:1], values[:-1]])
    moved[np.cumsum(sizes) - sizes] = start
    return moved


def _ngrams(words: _Words, order: int) -> list[np.ndarray]:
    """Per order, the hash of the n-gram that ends with each token. Before a text stands its start."""
    grams = [words.one]
    for n in range(2, order + 1):
        grams.append(_mixed(_before(grams[-1], words.sizes, _START) * np.uint64(2 * n + 1) + words.one))
    return grams


def _counted(batches: Iterator[pa.RecordBatch], model: Model, chunks: int) -> Iterator[pa.RecordBatch]:
    """``(chunk, hashes, counts)``: n-grams of all orders, counted over up to ``BUFFER`` of them."""
    kept, held = [], 0

    def flush() -> pa.RecordBatch:
        hashes, counts = np.unique(np.concatenate(kept), return_counts=True)
        kept.clear()
        # Sorting numbers of 16 bits is fast.
        chunk = (hashes % np.uint64(chunks)).astype(np.uint16 if chunks <= 1 << 16 else np.uint64)
        order = np.argsort(chunk, kind="stable")
        hashes, counts, chunk = hashes[order], counts[order].astype(np.uint32), chunk[order].astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
        found = chunk[starts]
        ends = [*starts[1:].tolist(), len(hashes)]
        parts = [[x[a:b].tobytes() for a, b in zip(starts.tolist(), ends)] for x in (hashes, counts)]
        return pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(p, pa.binary()) for p in parts)], ["chunk", "hashes", "counts"])

    for batch in batches:
        for _, _, texts in _blocks(batch):
            words = words_of(texts)
            kept.extend(_ngrams(words, model.order))
            held += model.order * len(words.one)
            if held >= BUFFER:
                yield flush()
                held = 0
    if kept:
        yield flush()


def _built(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk: its entries with their counts summed, as bits."""
    now, hashes, counts = None, [], []

    def chunk() -> pa.RecordBatch:
        place, every = _numbered(np.concatenate(hashes))
        total = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)
        kept = total >= model.rarest
        every, level = every[kept], model.level(total[kept])
        size = max(64, math.ceil(int(level.sum()) * model.hashes / math.log(2) / 64) * 64)
        bits = np.zeros(size, bool)
        entries, step = len(every), _step(every)
        for q in range(1, int(level.max(initial=0)) + 1):
            kept = level >= q
            every, level, step = every[kept], level[kept], step[kept]
            place = _entry(every, q)
            for _ in range(model.hashes):
                bits[_bits(place, np.uint64(size))] = True
                place = place + step
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([entries]), pa.array([packed], pa.binary())], ["chunk", "entries", "bits"])

    for batch in batches:
        for number, h, c in zip(*(batch.column(x).to_pylist() for x in ("chunk", "hashes", "counts"))):
            if number != now and hashes:
                yield chunk()
                hashes, counts = [], []
            now = number
            hashes.append(np.frombuffer(h, np.uint64))
            counts.append(np.frombuffer(c, np.uint32))
    if hashes:
        yield chunk()


def build_filter(training: DataFrame, model: Model = Model(), chunk: int = CHUNK) -> tuple[DataFrame, int]:
    """``(chunk, entries, bits)`` over the texts of ``training (text)``, and the number of chunks.

    The number of chunks follows the bytes of text. An n-gram of any share of all rows comes from each task
    once.
    """
    size = training.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    chunks = max(1, math.ceil(size / chunk))
    counted = training.mapInArrow(lambda b: _counted(b, model, chunks), "chunk long, hashes binary, counts binary")
    ordered = counted.repartition("chunk").sortWithinPartitions("chunk")
    return settle(ordered.mapInArrow(lambda b: _built(b, model), "chunk long, entries long, bits binary"), "filter"), chunks


class _Segment:
    """Chunks ``number``, ``number + of``, ... of a filter."""

    def __init__(self, rows: pa.Table, number: int, of: int, chunks: int) -> None:
        self.number, self.of, self.chunks = number, of, chunks
        rows = rows.sort_by("chunk").combine_chunks()
        # Chunks without entries have no bits, and say no.
        self.sizes = np.zeros(len(range(number, chunks, of)), np.uint64)
        self.bits = np.empty(0, np.uint8)
        if rows.num_rows:
            bits = rows.column("bits").chunk(0).cast(pa.large_binary())
            self.sizes[rows.column("chunk").to_numpy() // of] = pa.compute.binary_length(bits).to_numpy() * 8
            self.bits = np.frombuffer(bits.buffers()[2], np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.uint64)

    def __getstate__(self) -> dict:
        return vars(self) | {"bits": self.bits.tobytes()}

    def __setstate__(self, state: dict) -> None:
        """Bytes are read into their place; an array would be held twice for a while."""
        vars(self).update(state | {"bits": np.frombuffer(state["bits"], np.uint8)})

    def levels(self, hashes: np.ndarray, model: Model) -> np.ndarray:
        """Levels of the n-grams that belong to this segment; 0 for others."""
        chunk = (hashes % np.uint64(self.chunks)).astype(np.int64)
        level = np.zeros(len(hashes), np.uint8)
        active = np.flatnonzero(chunk % self.of == self.number) if self.of > 1 else np.arange(len(hashes))
        chunk = chunk[active] // self.of
        sizes, starts = self.sizes[chunk], self.starts[chunk]
        hashes = hashes[active]
        step = _step(hashes)
        some, last = sizes > 0, np.uint64(max(len(self.bits) * 8, 1) - 1)
        for q in range(1, LEVELS):
            place = _entry(hashes, q)
            for _ in range(model.hashes):
                if np.count_nonzero(some) < 0.95 * len(some):
                    active, hashes, place, step, sizes, starts = (x[some] for x in (active, hashes, place, step, sizes, starts))
                    some = np.ones(len(active), bool)
                if not len(active):
                    return level
                # An entry that is out already may lie in a chunk without bits.
                bit = np.minimum(starts + _bits(place, sizes), last)
                some &= (self.bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
                place = place + step
            level[active[some]] = q
        return level


@dataclass(frozen=True)
class _Known:
    """What all tasks know of the corpus: both hashes of the frequent tokens, sorted, and their exact counts;
    all tokens, different tokens, texts."""

    one: np.ndarray
    two: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    texts: int

    def find(self, words: _Words) -> tuple[np.ndarray, np.ndarray]:
        """Per token its place among the frequent ones, and whether it is there."""
        if not len(self.one):
            return np.zeros(len(words.one), np.int64), np.zeros(len(words.one), bool)
        number, every = _numbered(words.one)
        place = np.minimum(np.searchsorted(self.one, every), len(self.one) - 1)[number]
        return place, (self.one[place] == words.one) & (self.two[place] == words.two)

    def part(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ALPHA) / (self.tokens + ALPHA * (self.distinct + 1)))


def _scores(levels: list[np.ndarray], sizes: np.ndarray, model: Model, known: _Known) -> np.ndarray:
    """log10 probability per token, from the levels of the n-grams that end with it, by order."""
    value = model.counts()
    start = value[model.level(np.array(known.texts))]
    seen = [value[level] for level in levels]
    share = np.minimum((seen[0] + ALPHA) / (known.tokens + ALPHA * (known.distinct + 1)), 1.0)
    for shorter, gram in zip(seen, seen[1:]):
        context = _before(shorter, sizes, start)
        share = (np.minimum(gram, context) + model.strength * share) / (context + model.strength)
    return np.log10(share)


def _pass(
    batches: Iterator[pa.RecordBatch], segment: Callable[[], _Segment], known: Callable[[], _Known], model: Model, last: bool
) -> Iterator[pa.RecordBatch]:
    """Read levels from one segment, and after the ``last`` one give the scores.

    ``levels`` of a row are those of its single words, then of its pairs, and so on.
    """
    segment, known = segment(), known()
    frequent = segment.levels(known.one, model)  # once per task
    for batch in batches:
        for lo, hi, texts in _blocks(batch):
            words = words_of(texts)
            sizes, levels = words.sizes, []
            at, head = known.find(words)
            for n, gram in enumerate(_ngrams(words, model.order)):
                if n:
                    place, every = _numbered(gram)
                    levels.append(segment.levels(every, model)[place])
                else:
                    levels.append(np.zeros(len(gram), np.uint8))
                    levels[0][head] = frequent[at[head]]
                    place, every = _numbered(gram[~head])
                    levels[0][~head] = segment.levels(every, model)[place]
            row = [batch.column(c).slice(lo, hi - lo) for c in ("uid", "doc_id")]
            before = batch.column("levels").slice(lo, hi - lo)
            if before.null_count < len(before):  # no n-gram has a level in two segments
                held = [np.frombuffer(b, np.uint8).reshape(len(levels), -1) for b in before.to_pylist()]
                levels = [np.maximum(level, np.concatenate([h[k] for h in held])) for k, level in enumerate(levels)]
            if not last:
                apart = [np.split(level, np.cumsum(sizes)[:-1]) for level in levels]
                packed = [np.concatenate(x).tobytes() for x in zip(*apart)]
                yield pa.RecordBatch.from_arrays(
                    [*row, batch.column("text").slice(lo, hi - lo), pa.array(packed, pa.binary())], ["uid", "doc_id", "text", "levels"]
                )
                continue
            score, owner = _scores(levels, sizes, model, known), np.repeat(np.arange(len(sizes)), sizes)
            part = np.zeros(len(head))
            part[head] = known.part(known.counts)[at[head]]
            rare = np.flatnonzero(~head)
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[rare], minlength=len(sizes)))])
            tail = pa.array([words.token(i) for i in rare.tolist()], pa.binary())

            def summed(values: np.ndarray) -> pa.Array:
                return pa.array(np.bincount(owner, weights=values, minlength=len(sizes)))

            yield pa.RecordBatch.from_arrays(
                [
                    *row, pa.array(sizes), summed(head).cast("int64"), summed(part), summed(score),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tail),
                ],
                ["uid", "doc_id", "n_tokens", "n_known", "base_score", "score", "tail"],
            )


def token_counts(training: DataFrame) -> DataFrame:
    """``(token, n)`` over the texts of ``training (text)``, exact; counted per ``BUFFER`` tokens before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[_Words] = []

        def flush() -> pa.RecordBatch:
            one, two = (np.concatenate([getattr(w, name) for w in kept]) for name in ("one", "two"))
            order = np.argsort(one)
            one, two = one[order], two[order]
            # Runs of equal hashes are occurrences of one token; a token may have more than one run.
            first = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
            counts = np.diff(np.append(first, len(one)))
            behind = np.cumsum([len(w.one) for w in kept])
            block = np.searchsorted(behind, order[first], side="right")
            places = order[first] - np.concatenate([[0], behind])[block]
            tokens = [kept[b].token(p) for b, p in zip(block.tolist(), places.tolist())]
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), pa.array(counts)], ["token", "n"])

        held = 0
        for batch in batches:
            for _, _, texts in _blocks(batch):
                kept.append(words_of(texts))
                held += len(kept[-1].one)
                if held >= BUFFER // 2:
                    yield flush()
                    held = 0
        if kept:
            yield flush()

    return training.mapInArrow(counted, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _head(counts: DataFrame, size: int) -> tuple[Column, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The frequent tokens, at most ``size`` of at most ``HEAD_BYTES`` bytes: as a filter, and their hashes and counts."""
    short = F.octet_length("token") <= HEAD_BYTES
    scale = F.floor(F.log2("n") * 4).cast("int")
    # One row per quarter of a power of two.
    steps = counts.filter(short).groupBy(scale.alias("step")).count().orderBy(F.desc("step")).collect()
    lowest, held = None, 0
    for step in steps:
        held += step["count"]
        if held > size:
            break
        lowest = step.step
    if lowest is None:
        return F.lit(False), (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64))
    is_head = short & (scale >= lowest)
    frequent = counts.filter(is_head).toArrow()
    tokens = frequent.column("token").cast(pa.large_binary()).combine_chunks()
    words = words_of(tokens if isinstance(tokens, pa.Array) else tokens.chunk(0))
    # The first of each: the word, or for the end, which has no bytes, the end.
    at = np.cumsum(words.sizes) - words.sizes
    order = np.argsort(words.one[at])
    return is_head, (words.one[at][order], words.two[at][order], frequent.column("n").to_numpy()[order])


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Fewer rows in an Arrow batch while the operator's own jobs run: texts may be long, and memory is bounded by a batch."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROWS if int(before) <= 0 else min(int(before), ROWS))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def lm_scores(
    docs: DataFrame,
    is_training: Column | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    model: Model = Model(),
    segment: int = SEGMENT,
    chunk: int = CHUNK,
    head: int = HEAD,
) -> DataFrame:
    """``(doc_id, training, n_tokens, n_known, train_tokens, base_score, score)``: one row per row of ``docs``.

    ``is_training`` is a condition on ``doc_id``; without it all rows teach the model. ``base_score`` comes
    from exact counts of single tokens, ``score`` is the log10 probability of the text under the n-gram
    model in the filter. Null and empty texts are the end token alone. Repeated rows teach as often as they
    occur and are returned as often. Where no row teaches, every count is 0. A very long text is read whole,
    in one block of its own. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    teaches = F.lit(True) if is_training is None else is_training
    rows = picked(docs, doc_id=id_column, text=text_column)
    training = rows.filter(teaches).select("text")
    with _small_batches(spark):
        bits, chunks = build_filter(training, model, chunk)
        counts = settle(token_counts(training), "tokens")
    texts = F.sum(F.when(F.octet_length("token") == 0, F.col("n")))  # each text has one end
    totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), texts.alias("texts")).first()
    is_head, frequent = _head(counts, head)
    known = _Known(*frequent, totals.n or 0, totals.v, totals.texts or 0)

    segments = 1
    while True:  # until the largest is within the bound
        dealt = bits.groupBy((F.col("chunk") % segments).alias("s")).agg(F.sum(F.octet_length("bits").cast("long")).alias("size"))
        if segments >= chunks or (dealt.agg(F.max("size")).first()[0] or 0) <= segment:
            break
        segments *= 2
    segments = min(segments, chunks)

    read = rows.withColumn("uid", F.monotonically_increasing_id()).select("uid", "doc_id", "text", F.lit(None).cast("binary").alias("levels"))
    shared = spark.sparkContext.broadcast(known)
    given = [shared]
    id_type = rows.schema["doc_id"].dataType.simpleString()
    with _small_batches(spark):
        for number in range(segments):
            if number % CHAIN == 0:  # row ids must not change any more, and few Python workers run at once
                read = settle(read, "levels") if number else read
            mine = bits.filter(F.col("chunk") % segments == number).select("chunk", "bits").toArrow()
            part = spark.sparkContext.broadcast(_Segment(mine, number, segments, chunks))
            given.append(part)
            last = number == segments - 1
            columns = (
                "n_tokens long, n_known long, base_score double, score double, tail array<binary>" if last else "text string, levels binary"
            )
            read = read.mapInArrow(
                lambda b, part=part, last=last: _pass(b, lambda: part.value, lambda: shared.value, model, last), f"uid long, doc_id {id_type}, {columns}"
            )
        scored = settle(read, "scores")
    for broadcast in given:
        broadcast.destroy()

    # Tokens that are not frequent, with their documents; no count means unknown.
    rare = counts.filter(~is_head).select(F.col("token").alias("_token"), "n")
    met = scored.select("uid", F.explode("tail").alias("token")).join(rare, F.col("token") == F.col("_token"), "left")
    part = F.log10((F.coalesce("n", F.lit(0)) + ALPHA) / (known.tokens + ALPHA * (known.distinct + 1)))
    rest = met.groupBy(F.col("uid").alias("_uid")).agg(
        F.count("n").alias("_known"), F.sum(part).alias("_base")
    )
    return scored.join(rest, F.col("uid") == F.col("_uid"), "left").select(
        "doc_id",
        teaches.alias("training"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


@query("op13_lmscore")
def op13_lmscore(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose id's crc32 leaves 0 when divided by 10 are held out of training."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    scored = lm_scores(table(spark, folder, "documents"), ~held)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
