"""Near duplicates by SimHash, found through the anchors of a covering code.

The binary Golay code of length 23 is perfect: every 23-bit value lies within 3 bits of exactly one of
its 4,096 words. Bits 0-22 of a fingerprint are matched with that code. A fingerprint's home is the one
anchor within the covering radius 3, and it visits every anchor within 3 + threshold. Two fingerprints
that differ in at most ``threshold`` bits meet: the second visits the first one's home. Homes are
compared with visitors per anchor, exactly, on all 64 bits.

An anchor that is home to more than ``split`` fingerprints is refined by a second anchor over bits
23-45; the distance beyond radius 3 that both parts take up must not exceed the threshold together. A
refined anchor that still has more homes is cut into chunks of homes, and its visitors go to all chunks.
So no task holds more than about ``split`` homes of an anchor; visitors stream past them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .common import picked, query, table
from .components import components

SEED = 42
SHINGLE = 3
THRESHOLD = 3
RADIUS = 3
LENGTH = 23
#: Generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the binary Golay code.
GENERATOR = 0b110001110101
#: Homes that one task keeps for an anchor.
SPLIT = 2048
_LOW = (1 << LENGTH) - 1


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64-bit SimHash over ``size``-word shingles of lower-cased text; 0 without words."""
    import xxhash

    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    shingles = zip(*[words[i:] for i in range(size)]) if len(words) >= size else [words]
    hashes = b"".join([digest(b" ".join(s), SEED) for s in shingles])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    total = np.zeros(64, np.int64)
    whole = len(bits) // 255 * 255
    if whole:
        total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    total += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(bits)).tobytes(), "big")


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    found = (fingerprint(t.as_py() or b"") for t in texts.cast(pa.large_binary()))
    return pa.array(np.fromiter(found, np.uint64, len(texts)).view(np.int64))


@functools.cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of each 23-bit value in two halves; per syndrome the error patterns of up to 6 bits."""
    weights = RADIUS + THRESHOLD

    def remainder(values: np.ndarray) -> np.ndarray:
        values = values.copy()
        for bit in range(LENGTH - 1, 10, -1):
            values ^= np.where(values >> bit & 1, GENERATOR << (bit - 11), 0)
        return values

    halves = np.arange(4096, dtype=np.int64)
    low, high = remainder(halves), remainder(halves << 12 & _LOW)
    patterns = np.arange(1 << LENGTH, dtype=np.int64)
    patterns = patterns[np.bitwise_count(patterns) <= weights]
    syndromes = remainder(patterns)
    order = np.argsort(syndromes, kind="stable")
    starts = np.searchsorted(syndromes[order], np.arange(2049))
    return low, high, patterns[order], starts


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For 23-bit values: (index of value, anchor, bits beyond the radius) of every anchor in reach."""
    low, high, patterns, starts = _golay()
    syndrome = low[values & 4095] ^ high[values >> 12]
    count = starts[syndrome + 1] - starts[syndrome]
    index = np.repeat(np.arange(len(values)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[syndrome], count)
    error = patterns[place]
    return index, values[index] ^ error, np.maximum(np.bitwise_count(error).astype(np.int64) - RADIUS, 0)


def _parts(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = fingerprints.view(np.uint64)
    return (bits & np.uint64(_LOW)).astype(np.int64), (bits >> np.uint64(LENGTH) & np.uint64(_LOW)).astype(np.int64)


def home(values: np.ndarray) -> np.ndarray:
    index, anchor, beyond = anchors(values)
    return anchor[beyond == 0]


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("first", "second")]))
def _homes(fingerprints: pa.Array) -> pa.Array:
    first, second = _parts(fingerprints.to_numpy(zero_copy_only=False))
    return pa.StructArray.from_arrays([pa.array(home(first)), pa.array(home(second))], ["first", "second"])


def _visits(batches: Iterator[pa.RecordBatch], refined: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of (first, second, visitor, fingerprint); second is -1 where ``first`` is not refined."""
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            fp = part.column("fingerprint").to_numpy(zero_copy_only=False)
            one, two = _parts(fp)
            index, anchor, beyond = anchors(one)
            fine = np.isin(anchor, refined)
            rows = [(index[~fine], anchor[~fine], np.full((~fine).sum(), -1), beyond[~fine])]
            if fine.any():
                source, first, used = index[fine], anchor[fine], beyond[fine]
                at, second, more = anchors(two[source])
                fits = used[at] + more <= THRESHOLD
                rows.append((source[at][fits], first[at][fits], second[fits], (used[at] + more)[fits]))
            index, first, second, beyond = (np.concatenate(x) for x in zip(*rows))
            at_home = beyond == 0
            index = np.concatenate([index[at_home], index])
            visitor = np.concatenate([np.zeros(at_home.sum(), bool), np.ones(len(at_home), bool)])
            first, second = (np.concatenate([x[at_home], x]) for x in (first, second))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (first, second, visitor, fp[index])],
                ["first", "second", "visitor", "fingerprint"],
            )


def _linked(homes: np.ndarray, root: np.ndarray, guests: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what lies within the threshold: one per visitor, and those that join homes.

    ``root`` names the tree of each home so far and is updated, so a dense group of homes gives as many
    links as it has members, not as many as it has pairs.
    """
    kept = []
    step = max(1, 4_000_000 // len(homes))
    for start in range(0, len(guests), step):
        some = guests[start : start + step]
        near = np.bitwise_count(homes[:, None] ^ some[None]) <= THRESHOLD
        first = near.argmax(axis=0)
        met = near[first, np.arange(len(some))]
        near, first, some = near[:, met], first[met], some[met]
        kept.append((homes[first], some))
        i, j = np.nonzero(near & (root[:, None] != root[first][None]))
        while len(i):
            a, b = homes[i[0]], homes[first[j[0]]]
            kept.append((np.array([a]), np.array([b])))
            old, new = root[i[0]], root[first[j[0]]]
            root[root == old] = new
            apart = root[i] != root[first[j]]
            i, j = i[apart], j[apart]
    return kept


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, homes first: keep the anchor's homes, stream its visitors past them."""
    key, homes, root = None, np.empty(0, np.uint64), np.empty(0, np.int64)
    for batch in batches:
        first, second, chunk = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "second", "chunk"))
        visitor = batch.column("visitor").to_numpy(zero_copy_only=False)
        fp = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
        turns = np.flatnonzero((first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        found = []
        for lo, hi in zip(np.concatenate([[0], turns]).tolist(), np.concatenate([turns, [len(fp)]]).tolist()):
            if hi == lo:
                continue
            now = (first[lo], second[lo], chunk[lo])
            if now != key:
                key, homes, root = now, np.empty(0, np.uint64), np.empty(0, np.int64)
            middle = lo + int((~visitor[lo:hi]).sum())
            if middle > lo:
                homes, root = np.concatenate([homes, fp[lo:middle]]), np.arange(len(homes) + middle - lo)
            if len(homes) and hi > middle:
                found += _linked(homes, root, fp[middle:hi])
        if found:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])


def links(fingerprints: DataFrame, split: int = SPLIT) -> DataFrame:
    """Links ``(a, b)`` that connect all of ``fingerprints (fingerprint)`` within the threshold.

    Each fingerprint must occur once. Links implied by others of the same anchor are left out, so a dense
    group of g fingerprints gives about g links per anchor instead of g squared.
    """
    at_home = fingerprints.select(_homes("fingerprint").alias("_home")).select("_home.*")
    # At most 4,096 rows, the size of the code, whatever the data.
    crowded = at_home.groupBy("first").count().filter(F.col("count") > split).select("first").collect()
    refined = np.array(sorted(r[0] for r in crowded), np.int64)
    visits = fingerprints.select("fingerprint").mapInArrow(
        lambda batches: _visits(batches, refined),
        "first long, second long, visitor boolean, fingerprint long",
    )
    one = F.lit(1).cast("int")
    if len(refined):
        cells = at_home.filter(F.col("first").isin([int(x) for x in refined])).groupBy("first", "second").count()
        full = cells.filter(F.col("count") > split).select(
            "first", "second", F.ceil(F.col("count") / split).cast("int").alias("chunks")
        )
        visits = visits.join(full, ["first", "second"], "left").withColumn("chunks", F.coalesce("chunks", one))
    else:
        visits = visits.withColumn("chunks", one)
    own = F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int")
    places = F.when(F.col("visitor"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))
    dealt = visits.withColumn("chunk", F.explode(places)).select("first", "second", "chunk", "visitor", "fingerprint")
    key = ["first", "second", "chunk"]
    return dealt.repartition(*key).sortWithinPartitions(*key, "visitor").mapInArrow(_compare, "a long, b long")


def _rooted(marked: DataFrame, split: int) -> DataFrame:
    """``(fingerprint, rep, root)`` per different fingerprint of ``marked (doc_id, fingerprint)``."""
    # Copies meet here, in a min that combines before the shuffle: one row per fingerprint goes on.
    distinct = settle(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "distinct")
    reached = components(links(distinct, split)).withColumnRenamed("component", "root")
    return distinct.join(reached, distinct.fingerprint == reached.node, "left").select(
        "fingerprint", "rep", F.coalesce("root", "fingerprint").alias("root")
    )


def simhash_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", split: int = SPLIT) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Two documents are linked if their fingerprints differ in at most 3 bits; ``component_id`` is the
    smallest id reachable. Null and empty texts have no words, hence fingerprint zero, and link like any
    other. Repeated rows are returned as often as they occur. A null id is returned with the component of
    the other rows of its group, null if there are none. An empty table gives an empty result; columns
    other than the two are ignored.
    """
    rows = picked(docs, doc_id=id_column, text=text_column)
    marked = settle(rows.select("doc_id", _fingerprints("text").alias("fingerprint")), "fingerprints")
    rooted = _rooted(marked, split)
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = rooted.join(smallest, "root").select(F.col("fingerprint").alias("_fp"), "component_id")
    return marked.join(known, F.col("fingerprint") == F.col("_fp"), "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", split: int = SPLIT) -> DataFrame:
    """One row of ``docs`` per group of near copies, with all its columns: that of the smallest id.

    A null id comes after all others; among rows of one id a hash of the text decides. Groups are reduced
    before the shuffle, so one of any size sends one row per task.
    """
    names = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in names])
    rows = docs.select(
        whole.alias("row"),
        F.struct(F.col(f"`{id_column}`").isNull(), F.col(f"`{id_column}`"), F.xxhash64(F.col(f"`{text_column}`"))).alias("order"),
        _fingerprints(F.col(f"`{text_column}`")).alias("fingerprint"),
    )
    marked = settle(rows.select("fingerprint", F.col(f"row.`{id_column}`").alias("doc_id")), "fingerprints")
    known = _rooted(marked, split).select(F.col("fingerprint").alias("_fp"), "root")
    grouped = rows.join(known, F.col("fingerprint") == F.col("_fp")).groupBy("root")
    return grouped.agg(F.min_by("row", "order").alias("row")).select("row.*")


@query("op9_simhash")
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_components(table(spark, folder, "documents"))
