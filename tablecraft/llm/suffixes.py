"""Passages that occur twice, by sorting sampled suffixes.

A cover of the suffixes is sampled: of each window of ``REACH`` starts the one whose first bytes hash lowest.
Two equal strings of ``LENGTH`` bytes contain the same sampled suffix at the same place, which is what a
difference cover is for; taken from the content, it holds about one suffix in 60 bytes instead of two in
three. A sampled suffix is named by three pieces: the core that starts there (``CORE`` bytes, in every
string that it stands for), and the text to the left and right that those strings take in. Equal names
meet in Spark; a core that occurs once is done. Of the others, those whose whole names are equal repeat as
they are. What remains is merged in: each string around such a suffix is ordered behind it by its place
and a name of its own, and adjacent ones compared. Names are 64-bit hashes, so equal text always meets.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .common import picked, query, table

LENGTH = 200
#: Starts of which one is sampled, and the bytes whose hash decides.
REACH, GRAM = 160, 16
CORE = LENGTH - REACH
#: Bytes of text that are handled at once.
PART = 1 << 20
#: Suffixes of one core that a task compares; more are compared string by string in Spark.
TOGETHER = 20_000
#: Rows that may be broadcast, of one long each.
SMALL = 1_000_000

_BITS = np.uint64((1 << 21) - 1)
_ONE, _TWO, _THREE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_BASE = 0xD6E8FEB86659FD93


def _mix(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(32))) * _THREE
    return value ^ (value >> np.uint64(29))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, and a random number for each byte."""
    size = 2 * PART + 4 * LENGTH
    powers = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        powers.append(np.cumprod(steps, dtype=np.uint64))
    return *powers, np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)


class Hashes:
    """Hashes of any stretch of a buffer, in constant time each.

    ``places`` counts the bytes of each text in the buffer from 0, where it holds more than the tables
    do; stretches then lie within a text.
    """

    def __init__(self, buffer: np.ndarray, places: np.ndarray | None = None) -> None:
        up, self.down, numbers = _tables()
        self.places = places
        weights = up[: len(buffer)] if places is None else up[places]
        sums = np.cumsum(numbers[buffer] * weights, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), sums])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        place = start if self.places is None else self.places[start]
        return _mix((self.sums[end] - self.sums[start]) * self.down[place])


def _starts(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges ``low`` to ``high`` (exclusive), and the range of each."""
    count = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(low)), count)
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count), owner


def sampled(buffer: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(range, suffix, first, last, core, name)`` of the sampled suffixes for the strings that start in
    the ranges ``low`` to ``high``. ``first`` to ``last`` are the starts that a suffix stands for."""
    size = len(buffer)
    padded = np.concatenate([buffer, np.zeros(REACH + 2 * GRAM, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (size + REACH + 8, 8), (1, 1)).copy().view("<u8").ravel()
    grams = _mix((words[: size + REACH] * _ONE) ^ (words[8 : size + REACH + 8] * _TWO))
    keys = (grams & ~_BITS) | np.arange(size + REACH, dtype=np.uint64)
    blocks = np.full(-(-len(keys) // REACH) * REACH, ~np.uint64(0))
    blocks[: len(keys)] = keys
    blocks = blocks.reshape(-1, REACH)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    lowest = np.minimum(behind[:size], ahead[REACH - 1 : REACH - 1 + size]) & _BITS
    starts, owner = _starts(low, high)
    if not len(starts):
        none = np.empty(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = lowest[starts].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
    first, last, at, owner = starts[new], starts[np.append(new[1:], len(starts)) - 1], at[new], owner[new]
    hashes = Hashes(buffer)
    place = ((at - first) * 1024 + (last - first)).astype(np.uint64)
    return owner, at, first, last, hashes.of(at, at + CORE), _mix(hashes.of(first, last + LENGTH) + place * _ONE)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes, int, int]]]:
    """Texts in parts of bounded size: (key, bytes, offset of the bytes, number of starts in them)."""
    held, size = [], 0
    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        for key, value in zip(keys.tolist(), batch.column("text").cast(pa.large_binary())):
            data = value.as_py()
            for offset in range(0, max(0, len(data) - LENGTH + 1), PART):
                count = min(PART, len(data) - LENGTH + 1 - offset)
                held.append((key, data[offset : offset + count + LENGTH - 1], offset, count))
                size += count + LENGTH
                if size >= PART:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (core, name, key, place); ``place`` holds the suffix and the starts before and after its last."""
    for part in _parts(batches):
        lengths = np.array([len(p[1]) for p in part])
        begins = np.cumsum(lengths) - lengths
        counts, offsets, keys = (np.array([p[i] for p in part], np.int64) for i in (3, 2, 0))
        buffer = np.frombuffer(b"".join(p[1] for p in part), np.uint8)
        owner, at, first, last, core, name = sampled(buffer, begins, begins + counts)
        inside = at - begins[owner] + offsets[owner]
        place = (inside << 16) | ((at - first) << 8) | (at - last)
        columns = (core.view(np.int64), name.view(np.int64), keys[owner], place)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["core", "name", "key", "place"])


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = place >> 16
    return at, at - (place >> 8 & 255), at - (place & 255)


def _texts_with(texts: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Texts with one of the keys, and the others. Keys are broadcast if they are few by count; otherwise
    all texts are returned, to meet the keys in a join, and None."""
    if keys.count() > SMALL:
        return texts, None
    few = F.broadcast(keys)
    return texts.join(few, "key", "left_semi"), texts.join(few, "key", "left_anti")


def _contexts(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """``open_ (core, name, n, key, place)`` with ``part``, the bytes that its strings take in."""
    near, _ = _texts_with(texts, open_.select("key").distinct())
    # Copies of a text have one key; one of them is enough.
    once = near.groupBy("key").agg(F.first("text").alias("text"))
    at = F.shiftright("place", 16)
    first, last = at - F.shiftright("place", 8).bitwiseAND(F.lit(255)), at - F.col("place").bitwiseAND(F.lit(255))
    joined = open_.join(once, "key")
    part = F.substring(F.col("text").cast("binary"), (first + 1).cast("int"), (last - first + LENGTH).cast("int"))
    return joined.select("core", "n", "key", "place", part.alias("part"))


def _strings(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of each string that the rows' suffixes stand for: (row, start, hash of core, place and text)."""
    parts = rows.column("part").to_pylist()
    lengths = np.array([len(p) for p in parts], np.int64)
    begins = np.cumsum(lengths) - lengths
    at, first, last = _unpacked(rows.column("place").to_numpy(zero_copy_only=False))
    here, owner = _starts(begins, begins + last - first + 1)
    places = np.arange(lengths.sum()) - np.repeat(begins, lengths)
    hashes = Hashes(np.frombuffer(b"".join(parts), np.uint8), places).of(here, here + LENGTH)
    start = here - begins[owner] + first[owner]
    core = rows.column("core").to_numpy(zero_copy_only=False).view(np.uint64)
    return owner, start, _mix(hashes + core[owner] * _ONE + (at[owner] - start).astype(np.uint64) * _TWO)


def _runs(keys: np.ndarray, row: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Stretches ``(key, start, end)`` that strings at consecutive starts of a row cover."""
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])) if len(row) else np.empty(0, int)
    last = start[np.append(new[1:], len(row)) - 1] if len(row) else start
    columns = [pa.array(keys[row[new]]), pa.array(start[new]), pa.array(last + LENGTH)]
    return pa.RecordBatch.from_arrays(columns, ["key", "start", "end"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by core: sort the strings of whole cores and compare adjacent ones."""

    def compare(rows: pa.RecordBatch) -> pa.RecordBatch:
        row, start, names = _strings(rows)
        n = rows.column("n").to_numpy(zero_copy_only=False)
        order = np.argsort(names, kind="stable")
        same = names[order][1:] == names[order][:-1]
        twice = np.zeros(len(names), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        kept = twice & (n[row] == 1)  # the others repeat as they are
        return _runs(rows.column("key").to_numpy(zero_copy_only=False), row[kept], start[kept])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        core = batch.column("core").to_numpy(zero_copy_only=False)
        at = 0
        for i in range(2_000, len(core), 2_000):
            turn = i + int(np.argmax(core[i:] != core[i - 1])) if (core[i:] != core[i - 1]).any() else None
            if turn is not None and turn > at:
                whole = [*held, batch.slice(at, turn - at)]
                yield compare(pa.Table.from_batches(whole).combine_chunks().to_batches()[0])
                held, at = [], turn
        held.append(batch.slice(at))
        if sum(h.num_rows for h in held) >= 2_000:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            core = rows.column("core").to_numpy(zero_copy_only=False)
            turn = len(core) - int(np.argmax(core[::-1] != core[-1])) if (core != core[-1]).any() else 0
            if turn:
                yield compare(rows.slice(0, turn))
            held = [rows.slice(turn)]
    if held and sum(h.num_rows for h in held):
        yield compare(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _crowded(contexts: DataFrame) -> DataFrame:
    """The same for cores of which a task should not hold all: strings meet in a Spark aggregate."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2_000):
                rows = batch.slice(i, 2_000)
                row, start, names = _strings(rows)
                columns = (names.view(np.int64), rows.column("key").to_numpy(zero_copy_only=False)[row], start, rows.column("n").to_numpy(zero_copy_only=False)[row])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["name", "key", "start", "n"])

    each = settle(contexts.mapInArrow(strings, "name long, key long, start long, n long"), "strings")
    twice = each.groupBy("name").agg(F.sum("n").alias("_n")).filter(F.col("_n") > 1).select("name")
    return each.filter(F.col("n") == 1).join(twice, "name", "left_semi").select("key", "start", (F.col("start") + LENGTH).alias("end"))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """``(key, start, end)``: stretches that strings of ``LENGTH`` bytes cover which also start elsewhere.

    ``texts (key, text)`` has a row per document; equal texts share a key. Places are bytes.
    """
    rows = texts.mapInArrow(_suffix_rows, "core long, name long, key long, place long")
    cores = rows.groupBy("core").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("core")
    known = settle(rows.join(cores, "core", "left_semi"), "suffixes")
    named = known.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.min("core").alias("core"), F.min(F.struct("key", "place")).alias("one")
    )
    named = settle(named, "named")
    per_core = named.groupBy("core").agg(F.count(F.lit(1)).alias("names"), F.min("n").alias("least"))
    unsure = per_core.filter((F.col("names") > 1) & (F.col("least") == 1)).select("core", "names")
    open_ = named.join(unsure, "core").select("core", "name", "n", "one.key", "one.place", "names")
    open_ = settle(open_, "open")
    few, many = open_.filter(F.col("names") <= TOGETHER), open_.filter(F.col("names") > TOGETHER)
    sorted_ = _contexts(few, texts).repartition("core").sortWithinPartitions("core")
    merged = sorted_.mapInArrow(_compared, "key long, start long, end long")
    if not many.isEmpty():
        merged = merged.union(_crowded(_contexts(many, texts)))
    at = F.shiftright("place", 16)
    whole = known.join(named.filter(F.col("n") > 1).select("name"), "name", "left_semi").select(
        "key",
        (at - F.shiftright("place", 8).bitwiseAND(F.lit(255))).alias("start"),
        (at - F.col("place").bitwiseAND(F.lit(255)) + LENGTH).alias("end"),
    )
    return whole.union(merged).distinct()


DIGEST = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def joined_runs(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Overlapping and adjacent stretches as maximal runs."""
    runs: list[list[int]] = []
    for start, end in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return runs


def _without(data: bytes, runs: list[list[int]]) -> bytes:
    edges = [0, *(e for run in runs for e in run), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


@F.arrow_udf(DIGEST)
def _digest(texts: pa.Array, spans: pa.Array) -> pa.Array:
    rows = []
    for text, own in zip(texts.cast(pa.large_binary()), spans):
        data, runs = text.as_py(), joined_runs([(s["start"], s["end"]) for s in own.as_py()])
        kept = _without(data, runs)
        rows.append((len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))], DIGEST.fieldNames())


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts ``(doc_id, text, key)``, null as empty, and their repeated stretches ``(key, start, end)``."""
    rows = picked(docs, doc_id=id_column, text=text_column)
    text = F.coalesce("text", F.lit(""))
    texts = rows.select("doc_id", text.alias("text"), F.xxhash64(text, F.octet_length(text)).alias("key"))
    return texts, settle(repeated_spans(texts.select("key", "text")), "spans")


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` per row of ``docs``.

    A byte is removed if a string of 200 bytes covers it that also starts anywhere else, in the same text or
    another, overlapping or not. Strings do not cross documents and are judged on the texts as given. Null
    and empty texts have 0 bytes and the digest of nothing. Repeated rows are copies of each other, so all of
    their strings repeat. Null ids stay null, an empty table gives an empty result, and other columns are
    ignored. Texts longer than a part are read in overlapping parts, whole.
    """
    texts, spans = repeated_passages(docs, id_column, text_column)
    per_key = spans.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cut, rest = _texts_with(texts, spans.select("key").distinct())
    size = F.octet_length("text").cast("long").alias("n_bytes")
    none = (F.lit(0).cast("long"), F.sha2("text", 256))
    joined = cut.join(per_key, F.col("key") == F.col("_key"), "left")
    found = joined.select(
        "doc_id", size, _digest("text", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))).alias("_d")
    ).select("doc_id", "n_bytes", "_d.*")
    if rest is None:
        return found
    return found.union(rest.select("doc_id", size, none[0], none[0], none[1]))


@query("op1_suffixes")
def op1_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeats(table(spark, folder, "documents"))
