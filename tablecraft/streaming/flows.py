"""Streaming forms of row transforms, quality checks and status folding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, is_missing, present
from ..operators.quality import Check
from ..session import new_path


def read_stream(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.parquet", **options: str) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).options(pathGlobFilter=pattern, **options).parquet(path)


def stream_row_transforms(stream: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Row filters and projections on a stream: the functions for batches work as they are."""
    for step in steps:
        stream = step(stream)
    return stream


def stream_dq(
    stream: DataFrame, checks: Sequence[Check], time: str, window: str = "1 hour", late: str = "10 minutes"
) -> DataFrame:
    """Rows, null rates, ranges and duplicates per event-time window.

    A row is late, and dropped, when its window ended before the watermark, which lies ``late`` behind the
    newest event seen. With a ``unique`` check, ``duplicates_<column>`` counts the rows of the window beyond
    the first of each value, missing values being one value. It is known once the window is closed, so the
    result is then for append mode, in which each window comes once; without ``unique`` any mode will do.
    """
    measured = stream.withWatermark(time, late).withColumn("_window", F.window(col(time), window))
    unique = [c for c in checks if c.type == "unique"]
    flat = _per_value(measured, checks, unique) if unique else _per_window(measured, checks)
    passed = F.lit(True)
    for check in checks:
        if check.min_rows is not None:
            passed = passed & (F.col("rows") >= check.min_rows)
        if check.max_rows is not None:
            passed = passed & (F.col("rows") <= check.max_rows)
        if check.max_null_rate is not None:
            passed = passed & (col(f"null_rate_{check.column}") <= check.max_null_rate)
        if check.min_value is not None:
            passed = passed & F.coalesce(col(f"min_{check.column}") >= check.min_value, F.lit(True))
        if check.max_value is not None:
            passed = passed & F.coalesce(col(f"max_{check.column}") <= check.max_value, F.lit(True))
    for check in unique:
        passed = passed & (col(f"duplicates_{check.column}") == 0)
    return flat.withColumn("passed", passed)


def _per_window(stream: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One aggregate per window."""
    parts = [F.count(F.lit(1)).alias("rows")]
    for check in checks:
        if check.type == "null_rate":
            parts.append(F.avg(is_missing(stream, check.column).cast("int")).alias(f"null_rate_{check.column}"))
        if check.type == "value_range":
            value = present(stream, check.column)
            parts += [F.min(value).alias(f"min_{check.column}"), F.max(value).alias(f"max_{check.column}")]
    grouped = stream.groupBy("_window").agg(*parts)
    return grouped.select(
        F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), *[col(c) for c in grouped.columns[1:]]
    )


def _per_value(stream: DataFrame, checks: Sequence[Check], unique: Sequence[Check]) -> DataFrame:
    """Two aggregates in a row: per window and value, then per window.

    Each row counts once for every ``unique`` column, under the column's number and its value; the other
    measures ride on the first of them. So one state holds all columns, with an entry per different value of
    an open window, and it is dropped when the watermark passes the window.
    """
    values = [present(stream, c.column) for c in unique]
    types = [stream.schema[c.column].dataType for c in unique]
    entries = [
        F.struct(
            F.lit(i).alias("no"),
            *[(v if i == k else F.lit(None).cast(types[k])).alias(f"value{k}") for k, v in enumerate(values)],
        )
        for i in range(len(unique))
    ]
    first = F.col("_entry.no") == 0
    inner, outer = [F.count(F.lit(1)).alias("_n")], [F.sum(F.when(F.col("_no") == 0, F.col("_n"))).alias("rows")]
    for i, check in enumerate(checks):
        if check.type == "null_rate":
            inner.append(F.count_if(first & is_missing(stream, check.column)).alias(f"_null{i}"))
            rate = F.sum(f"_null{i}") / F.sum(F.when(F.col("_no") == 0, F.col("_n")))
            outer.append(rate.alias(f"null_rate_{check.column}"))
        if check.type == "value_range":
            value = present(stream, check.column)
            inner += [F.min(value).alias(f"_min{i}"), F.max(value).alias(f"_max{i}")]
            outer += [F.min(f"_min{i}").alias(f"min_{check.column}"), F.max(f"_max{i}").alias(f"max_{check.column}")]
    for k, check in enumerate(unique):
        copies = F.coalesce(F.sum(F.when(F.col("_no") == k, F.col("_n") - 1)), F.lit(0))
        outer.append(copies.alias(f"duplicates_{check.column}"))
    each = stream.withColumn("_entry", F.explode(F.array(*entries)))
    keys = [F.col("_entry.no").alias("_no"), *[F.col(f"_entry.value{k}").alias(f"_value{k}") for k in range(len(unique))]]
    counted = each.groupBy("_window", *keys).agg(*inner)
    # The window of a window is itself; this form carries the event time on to the second aggregate.
    grouped = counted.groupBy(F.col("_window")).agg(*outer)
    return grouped.select(
        F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), *[col(c) for c in grouped.columns[1:]]
    )


def stream_latest_state(stream: DataFrame, key: str, order_by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The last value of each field per key that is not NULL. Write it in update mode."""
    when = F.struct(*[col(c) for c in order_by])
    return stream.groupBy(col(key)).agg(
        F.max(when).alias("_at"), *[F.max_by(col(f), F.when(col(f).isNotNull(), when)).alias(f) for f in fields]
    )


def stream_closed_states(
    stream: DataFrame, key: str, order_by: Sequence[str], fields: Sequence[str], time: str, idle: str, late: str = "10 minutes"
) -> DataFrame:
    """As :func:`stream_latest_state`, with state that ends: each key's state once, when the key has fallen silent.

    A key is silent when the watermark, which lies ``late`` behind the newest event, has passed its last
    event by ``idle``. Then its state is written out, with the ``first`` and the ``last`` event's time, and dropped.
    What is kept is bounded by the keys of the last ``idle``, not by all keys ever seen. A key that speaks again
    starts anew, and gives another row later on: :func:`latest_states` folds the rows of a key. Events
    of a state that has ended are dropped. Append mode writes each row once.
    """
    when = F.struct(*[col(c) for c in order_by])
    grouped = stream.withWatermark(time, late).groupBy(F.session_window(col(time), idle).alias("_session"), col(key))
    return grouped.agg(
        F.min(col(time)).alias("first"),
        F.max(col(time)).alias("last"),
        F.max(when).alias("_at"),
        *[F.max_by(col(f), F.when(col(f).isNotNull(), when)).alias(f) for f in fields],
    ).drop("_session")


def latest_states(closed: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per key of a table of closed states: the last value of each field that is not NULL.

    A key may have any number of states; they are folded before the shuffle.
    """
    at = F.col("_at")
    return closed.groupBy(col(key)).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), *[F.max_by(col(f), F.when(col(f).isNotNull(), at)).alias(f) for f in fields]
    )


def run_available(result: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Process what has arrived, write it to the shared folder and return that table.

    In update mode each batch appends the rows that changed, with ``_batch``;
    :func:`latest_rows` picks the newest of them.
    """
    spark = result.sparkSession
    target = new_path(spark, "stream")
    writer = result.writeStream.option("checkpointLocation", checkpoint or new_path(spark, "progress"))
    schema = result.schema
    if mode == "update":
        schema = T.StructType([*schema.fields, T.StructField("_batch", T.LongType())])

        def append(batch: DataFrame, number: int) -> None:
            # A batch that runs again replaces its own folder.
            batch.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{target}/b={number}")

        writer = writer.outputMode("update").foreachBatch(append)
    else:
        writer = writer.outputMode(mode).format("parquet").option("path", target)
    writer.trigger(availableNow=True).start().awaitTermination()
    reader = spark.read.schema(schema)
    return (reader.option("recursiveFileLookup", "true") if mode == "update" else reader).parquet(target)


def latest_rows(changes: DataFrame, key: str) -> DataFrame:
    """The newest row per key of a table written in update mode."""
    rest = [c for c in changes.columns if c not in (key, "_batch")]
    newest = changes.groupBy(col(key)).agg(F.max_by(F.struct(*[col(c) for c in rest]), "_batch").alias("_r"))
    return newest.select(col(key), *[F.col("_r").getField(c).alias(c) for c in rest])


