"""Token counts by a tokenizer library, in batches balanced by bytes.

A batch is full when its texts hold ``BATCH`` bytes, however many texts those are. A text longer than
``PIECE`` is cut where a byte-level tokenizer always cuts: between a visible ASCII character and white
space. Only lengths come back. A file's lost task is done again on its own.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import default_path, texts_of
from .common import picked, query, table

PIECE = 1 << 15
BATCH = 1 << 18
LIMIT = 512
_CUT = re.compile(r"[!-~](?=[ \t\n\r])")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters whose tokens add up to those of the whole.

    No token spans a change from a visible character to white space: white space only ever starts a
    token. Where a text has no such place it stays in one part.
    """
    at = 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


class Counter:
    """Counts tokens with the library that a vocabulary file is for."""

    def __init__(self, content: bytes, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core already
        self.cuts = path.endswith(".json")
        if self.cuts:
            from tokenizers import Tokenizer
            from tokenizers.pre_tokenizers import ByteLevel

            tokenizer = Tokenizer.from_str(content.decode())
            tokenizer.no_truncation()
            tokenizer.no_padding()
            # Only byte-level files without a normalizer are known to cut at white space.
            self.cuts = tokenizer.normalizer is None and isinstance(tokenizer.pre_tokenizer, ByteLevel)
            self.lengths = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.lengths = lambda texts: [len(e) for e in model.encode(texts, num_threads=1)]

    def __call__(self, texts: Iterator[str], count: int) -> np.ndarray:
        totals = np.zeros(count, np.int64)
        owners: list[int] = []
        batch: list[str] = []
        held = 0

        def flush() -> None:
            if batch:
                np.add.at(totals, owners, self.lengths(batch))
            owners.clear()
            batch.clear()

        for row, text in enumerate(texts):
            for part in pieces(text) if self.cuts else (text,):
                if not part:
                    continue
                owners.append(row)
                batch.append(part)
                held += len(part.encode())
                if held >= BATCH:
                    flush()
                    held = 0
        flush()
        return totals


_COUNTERS: dict[bytes, Counter] = {}


def count_column(spark: SparkSession, path: str | None = None):
    """A function from a text column to its number of tokens; null counts as empty."""
    path = path or default_path()
    with open(path, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())  # the size of the vocabulary

    def run(column: pa.Array) -> pa.Array:
        if shared.value not in _COUNTERS:
            _COUNTERS[shared.value] = Counter(shared.value, path)
        return pa.array(_COUNTERS[shared.value](texts_of(column), len(column)))

    return F.arrow_udf(run, T.LongType())


def token_counts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` per row of ``docs``, over whole texts.

    Null and empty texts have 0 bytes and tokens. Repeated rows are returned as often as they occur, null
    ids stay null, an empty table gives an empty result, and other columns are ignored.
    """
    count = count_column(docs.sparkSession, path)
    rows = picked(docs, doc_id=id_column, text=text_column)
    counted = rows.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        count("text").alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"))
