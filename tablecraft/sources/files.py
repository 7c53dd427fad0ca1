"""Reading files: parquet, CSV, Stata, chosen by extension or by name."""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Rows of a Stata file held as one pandas batch.
STATA_BATCH = 50_000


def read_parquet(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    return spark.read.options(**options).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, **options: Any) -> DataFrame:
    """CSV with a header. Quoted cells may hold commas and quotes.

    Files are split among tasks. Where cells hold line breaks, pass
    ``multiLine=True``: each file is then read by one task. A schema spares the pass that infers one. Without it types are inferred and
    dates stay text, as they are written.
    """
    settings = {"header": True, "sep": ",", "quote": '"', "escape": '"'} | options
    reader = spark.read.options(**settings)
    if schema is not None:
        return reader.schema(schema).csv(path)
    inferred = reader.option("inferSchema", True).option("preferDate", True).csv(path).schema
    as_written = T.StructType(
        [
            T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else f.dataType)
            for f in inferred.fields
        ]
    )
    return reader.schema(as_written).csv(path)


# Kinds of numpy types and the column types that hold them.
STATA_KINDS = {"i": "bigint", "u": "bigint", "f": "double", "b": "boolean", "M": "timestamp_ntz"}


def _stata_schema(spark: SparkSession, path: str) -> T.StructType:
    """The schema of one file, found in a task from that file's first row."""
    one = spark.read.format("binaryFile").option("pathGlobFilter", "*.dta").load(path).limit(1)

    def header(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                first = next(iter(pd.read_stata(io.BytesIO(content), chunksize=1, convert_categoricals=False)))
                kinds = [getattr(t, "kind", "O") for t in first.dtypes]
                yield pd.DataFrame({"name": [str(c) for c in first.columns], "kind": kinds})

    found = one.select("content").mapInPandas(header, "name string, kind string").collect()
    if not found:
        raise FileNotFoundError(f"no .dta file under '{path}'")
    return T.StructType([T.StructField(r["name"], T.DataType.fromDDL(STATA_KINDS.get(r["kind"], "string"))) for r in found])


def read_stata(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Rows of one ``.dta`` file or of a folder of them, one task per file.

    All files have the same columns; without a schema those of one file are taken.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    schema = schema or _stata_schema(spark, path)
    names = [f.name for f in schema.fields]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                for part in pd.read_stata(io.BytesIO(content), chunksize=size, convert_categoricals=False):
                    yield part[names]

    size = STATA_BATCH
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dta").load(path)
    return files.select("content").mapInPandas(rows, schema)


# File extensions and the formats they stand for.
EXTENSIONS = {".csv": "csv", ".parquet": "parquet", ".dta": "stata"}
READERS = {"csv": read_csv, "parquet": read_parquet, "stata": read_stata}


def read_any(spark: SparkSession, path: str, format: str | None = None, **options: Any) -> DataFrame:
    """Read a file by its extension, or by ``format`` when it is given."""
    if not path:
        raise ValueError("read_any: missing 'path'")
    if format is None:
        name = path.rstrip("/").rsplit("/", 1)[-1].lower()
        suffix = name[name.rfind(".") :] if "." in name else ""
        format = EXTENSIONS.get(suffix)
        if format is None:
            raise ValueError(f"unsupported file format '{suffix}'; expected one of {', '.join(EXTENSIONS)}")
    if format not in READERS:
        raise ValueError(f"unsupported format '{format}'; expected one of {', '.join(READERS)}")
    return READERS[format](spark, path, **options)
