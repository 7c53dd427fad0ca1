"""Byte-level BPE: encoding by a queue of merge ranks, decoding by concatenation.

Reads a public tokenizer file, whose path is a parameter, and trains nothing. The file is read where the
query starts and goes to the executors as a broadcast; its size is that of the vocabulary.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import picked, query, table

# Fixed value: how byte-level tokenizers cut a text into words.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker remembers; when full it starts again. Bounds memory, not results.
REMEMBERED = 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others for the characters from 256 on, in order.
    """
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Written(dict):
    """Per word: how many ids it has, these as text, and the bytes they decode to. Worked out once per word."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec

    def of(self, ids: tuple[int, ...]) -> tuple[int, str, bytes]:
        codec = self.codec
        return len(ids), ",".join(map(codec.numbers.__getitem__, ids)), b"".join(map(codec.strings.__getitem__, ids))

    def __missing__(self, word: str) -> tuple[int, str, bytes]:
        found = self.of(self.codec.merge(word.encode()))
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, file: str) -> None:
        import regex

        content = json.loads(file)
        model, cutter = content["model"], content["pre_tokenizer"]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if model["type"] != "BPE" or not plain or content["normalizer"] or cutter["type"] != "ByteLevel" or cutter["add_prefix_space"]:
            raise ValueError("only plain byte-level BPE files can be read")
        vocabulary = model["vocab"]
        shown = byte_characters()
        self.start = [vocabulary[shown[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocabulary[left], vocabulary[right]] = (rank, vocabulary[left + right])
        added = {x["content"]: x for x in content["added_tokens"]}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added.values()):
            raise ValueError("added tokens that take in what is around them are not supported")
        bytes_of = {c: b for b, c in shown.items()}
        names = {i: t for t, i in vocabulary.items()} | {x["id"]: t for t, x in added.items()}
        self.strings = [
            t.encode() if t in added else bytes(bytes_of[c] for c in t) for t in (names.get(i, "") for i in range(max(names) + 1))
        ]
        self.numbers = [str(i) for i in range(len(self.strings))]
        self.added = {t: (x["id"],) for t, x in added.items()}
        longest_first = sorted(added, key=len, reverse=True)
        self.cut_added = regex.compile("|".join(map(regex.escape, longest_first))) if added else None
        self.cut = regex.compile(PIECES)
        self.known: dict[str, tuple[int, ...]] = {}
        self.written = _Written(self)

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word. Symbols are a doubly linked list; the queue gives the lowest rank, then the
        leftmost pair. An entry is stale, and skipped, when its symbols have changed since."""
        symbols = [self.start[b] for b in word]
        size = len(symbols)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        merges = self.merges
        queue = []
        for i in range(size - 1):
            if (found := merges.get((symbols[i], symbols[i + 1]))) is not None:
                queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, joined = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= size or symbols[j] != right:
                continue
            symbols[i], symbols[j] = joined, -1
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if (found := merges.get((joined, symbols[k]))) is not None:
                    heapq.heappush(queue, (found[0], i, joined, symbols[k], found[1]))
            h = before[i]
            if h >= 0 and (found := merges.get((symbols[h], joined))) is not None:
                heapq.heappush(queue, (found[0], h, symbols[h], joined, found[1]))
        return tuple(s for s in symbols if s >= 0)

    def _words(self, text: str) -> Iterator[tuple[int, ...]]:
        known = self.known
        for word in self.cut.findall(text):
            ids = known.get(word)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = self.merge(word.encode())
                if len(word) <= 64:
                    known[word] = ids
            yield ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; strings of added tokens in it are those tokens, as the library has it."""
        if self.cut_added is None:
            return list(itertools.chain.from_iterable(self._words(text)))
        ids, at = [], 0
        for found in self.cut_added.finditer(text):
            ids.extend(itertools.chain.from_iterable(self._words(text[at : found.start()])))
            ids.extend(self.added[found.group()])
            at = found.end()
        ids.extend(itertools.chain.from_iterable(self._words(text[at:] if at else text)))
        return ids

    def round_trip(self, text: str) -> tuple[int, str, bytes]:
        """Number of ids of a whole text, the ids as text joined by commas, and the bytes they decode to."""
        words, at = [], 0
        for found in self.cut_added.finditer(text) if self.cut_added else ():
            words += map(self.written.__getitem__, self.cut.findall(text[at : found.start()]))
            words.append(self.written.of(self.added[found.group()]))
            at = found.end()
        words += map(self.written.__getitem__, self.cut.findall(text[at:] if at else text))
        return sum([w[0] for w in words]), ",".join([w[1] for w in words]), b"".join([w[2] for w in words])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def _codec(file) -> Codec:
    """The worker's codec for a broadcast file, built once."""
    if file.value not in _CODECS:
        _CODECS[file.value] = Codec(file.value)
    return _CODECS[file.value]


def texts_of(column: pa.Array) -> Iterator[str]:
    """The texts of an Arrow column one by one; null counts as empty."""
    for value in column.cast(pa.large_binary()):
        yield (value.as_py() or b"").decode("utf-8", "replace")


DIGEST = T.StructType(
    [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
)


def _digest(texts: pa.Array, file) -> pa.Array:
    codec, rows = _codec(file), []
    for text in texts_of(texts):
        count, written, decoded = codec.round_trip(text)
        decoded = decoded.decode("utf-8", "replace").encode()
        rows.append((count, hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    columns = list(zip(*rows)) or [(), (), ()]
    kinds = (pa.int64(), pa.string(), pa.string())
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], DIGEST.fieldNames())


def _lists(encoded: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, encoded)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *encoded])))


def _encoded(texts: pa.Array, file) -> pa.Array:
    codec = _codec(file)
    return _lists([np.array(codec.encode(text), np.int32) for text in texts_of(texts)])


TOKENS = T.StructType(
    [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]
)


def _tokens(texts: pa.Array, file) -> pa.Array:
    codec, ids, same = _codec(file), [], []
    for text in texts_of(texts):
        found = codec.encode(text)
        same.append(codec.decode(found) == text)
        ids.append(np.array(found, np.int32))
    counts = pa.array([len(i) for i in ids], pa.int64())
    return pa.StructArray.from_arrays([counts, _lists(ids), pa.array(same, pa.bool_())], TOKENS.fieldNames())


def _decoded(lists: pa.Array, file) -> pa.Array:
    codec = _codec(file)
    return pa.array([None if ids is None else codec.decode(ids) for ids in lists.to_pylist()], pa.string())


def _with(function, spark: SparkSession, path: str | None, kind: T.DataType):
    with open(path or default_path(), encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())

    def run(column: pa.Array) -> pa.Array:
        return function(column, shared)

    return F.arrow_udf(run, kind)


def encode_column(spark: SparkSession, path: str | None = None):
    """A function from a text column to its ids, ``array<int>``; null counts as empty."""
    return _with(_encoded, spark, path, T.ArrayType(T.IntegerType()))


def decode_column(spark: SparkSession, path: str | None = None):
    """A function from an id column to text; null stays null. Special tokens are written out."""
    return _with(_decoded, spark, path, T.StringType())


def round_trip(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row of ``docs``.

    Whole texts are encoded; ids and decoded text are digested where they are made, so neither is
    shuffled. Null and empty texts have no tokens and the digests of the empty string. Repeated rows are
    returned as often as they occur, null ids stay null, an empty table gives an empty result, and other
    columns are ignored. There is no shuffle: a lost task is done again on its own.
    """
    digest = _with(_digest, docs.sparkSession, path, DIGEST)
    rows = picked(docs, doc_id=id_column, text=text_column)
    return rows.select("doc_id", digest("text").alias("_digest")).select("doc_id", "_digest.*")


def tokenized(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids, round_trip)`` per row of ``docs``, with the cases of ``round_trip``.

    ``round_trip`` says whether the ids decode to the text itself.
    """
    found = _with(_tokens, docs.sparkSession, path, TOKENS)
    rows = picked(docs, doc_id=id_column, text=text_column)
    return rows.select("doc_id", found("text").alias("_tokens")).select("doc_id", "_tokens.*")


@query("op5_bpe")
def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "documents"))
