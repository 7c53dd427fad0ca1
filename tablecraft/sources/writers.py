"""Writing frames: CSV, tables, JDBC, Stata, and named results."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, quoted
from ..operators.projection import nan_to_null
from .tables import Connection

# How cells with commas, quotes and line breaks are written.
CSV_RULES = {"quote": '"', "escape": '"', "nullValue": "", "emptyValue": "", "quoteAll": False}
STORE_PREFIX = "_store_"


def csv_options_rfc4180(**more: Any) -> dict[str, Any]:
    """Writer options for RFC 4180: quotes where needed and doubled inside, NULL as nothing."""
    return CSV_RULES | more


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", **options: Any) -> None:
    """A folder of CSV parts, each with a header."""
    df.write.mode(mode).options(**({"header": True, "sep": ","} | csv_options_rfc4180(**options))).csv(path)


def push_table(
    df: DataFrame, table: str, mode: str = "replace", schema: str | None = None, path: str | None = None
) -> str:
    """Replace a table by the frame, or append to it by position. Returns its name."""
    if not table:
        raise ValueError("push_table: missing 'table'")
    if mode not in ("replace", "append"):
        raise ValueError("push_table: mode must be 'replace' or 'append'")
    name = f"{quoted(schema)}.{quoted(table)}" if schema else quoted(table)
    if mode == "append":
        df.write.insertInto(name)
    else:
        df.write.saveAsTable(name, mode="overwrite", **({"path": path} if path else {}))
    return name


def jdbc_column_types(df: DataFrame) -> str:
    """Column types of a table created over JDBC, for ``createTableColumnTypes``."""

    def sql_type(dtype: T.DataType) -> str:
        if isinstance(dtype, T.IntegralType):
            return "BIGINT"
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            return "DOUBLE"
        if isinstance(dtype, T.BooleanType):
            return "BOOLEAN"
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            return "TIMESTAMP"
        if isinstance(dtype, T.DateType):
            return "DATE"
        if isinstance(dtype, T.DecimalType):
            return f"DECIMAL({dtype.precision},{dtype.scale})"
        return "STRING"

    return ", ".join(f"{quoted(f.name)} {sql_type(f.dataType)}" for f in df.schema.fields)


def jdbc_writer_options(df: DataFrame, connection: Connection, table: str, batch_size: int = 10_000) -> dict[str, str]:
    return {
        "url": connection.url,
        "dbtable": table,
        "batchsize": str(batch_size),
        "createTableColumnTypes": jdbc_column_types(df),
        **connection.options,
    }


def for_jdbc(df: DataFrame) -> DataFrame:
    """The frame as it goes to a database: NaN as NULL, whole numbers as long, nested values as text."""
    plain = nan_to_null(df)
    casts = {}
    for f in plain.schema.fields:
        if isinstance(f.dataType, T.IntegralType):
            casts[f.name] = col(f.name).cast("bigint")
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            casts[f.name] = F.to_json(col(f.name))
    return plain.withColumns(casts) if casts else plain


def push_jdbc(df: DataFrame, connection: Connection, table: str, mode: str = "replace", **options: Any) -> None:
    """Replace a database table by the frame, or append to it."""
    if mode not in ("replace", "append"):
        raise ValueError("push_jdbc: mode must be 'replace' or 'append'")
    ready = for_jdbc(df)
    settings = jdbc_writer_options(ready, connection, table, **options)
    ready.write.format("jdbc").options(**settings).mode("overwrite" if mode == "replace" else "append").save()


def write_stata(df: DataFrame, folder: str, rows_per_file: int = 500_000) -> DataFrame:
    """Parts in ``.dta`` in a folder all executors reach; returns ``(path, rows)``.

    A partition is cut into files of about ``rows_per_file`` rows, so no task
    holds more. Names are fixed by partition and file, and a task that runs
    again writes the same files.
    """
    names = df.columns
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    address = folder if re.match(r"[a-z0-9]+:", folder) else f"file://{folder}"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(address)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()

        def to_file(held: list[pd.DataFrame], number: int) -> pd.DataFrame:
            path = f"{root}/part-{part:05d}-{number:05d}.dta"
            rows = pd.concat(held, ignore_index=True)[names]
            rows[texts] = rows[texts].fillna("")
            # A plain text column of this format holds 2045 bytes; longer ones are kept apart.
            long = [c for c in texts if rows[c].str.len().max() * 4 > 2045]
            content = io.BytesIO()
            rows.to_stata(
                content, write_index=False, convert_dates={c: "tc" for c in times}, version=118, convert_strl=long
            )
            with store.open_output_stream(path) as target:
                target.write(content.getvalue())
            return pd.DataFrame({"path": [path], "rows": [len(rows)]})

        held, count, number = [], 0, 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                count += len(batch)
            if count >= rows_per_file:
                yield to_file(held, number)
                held, count, number = [], 0, number + 1
        if held:
            yield to_file(held, number)

    return df.mapInPandas(write, "path string, rows bigint")


def run_ddl(spark: SparkSession, statement: str, args: Mapping[str, Any] | None = None) -> None:
    """Run a statement for its effect: CREATE, INSERT and the like."""
    spark.sql(statement, args=dict(args) if args else None)


def _store_name(name: str) -> str:
    return STORE_PREFIX + re.sub(r"\W", "_", name)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Keep a result under a name, replacing an earlier one, and read it from there."""
    push_table(df, _store_name(name), path=path)
    return df.sparkSession.table(_store_name(name))


def stored(spark: SparkSession, name: str) -> DataFrame:
    if not spark.catalog.tableExists(_store_name(name)):
        raise KeyError(f"no result named '{name}'")
    return spark.table(_store_name(name))


def stored_names(spark: SparkSession) -> list[str]:
    """Names of the results kept so far."""
    tables = [t.name for t in spark.catalog.listTables() if t.name.startswith(STORE_PREFIX)]
    return sorted(t[len(STORE_PREFIX) :] for t in tables)
