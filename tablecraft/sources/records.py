"""Records out of JSON bodies, and a paged source that fetches them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.columns import col, require


def _segments(record_path: str | Sequence[str | int] | None) -> list[str]:
    if record_path is None:
        return []
    if isinstance(record_path, str):
        return record_path.split(".") if record_path else []
    return [str(p) for p in record_path]


def json_records(
    df: DataFrame,
    body: str,
    schema: str | T.StructType | None = None,
    record_path: str | Sequence[str | int] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The records at a path of a JSON body, one row each, with typed fields.

    A list at the path gives a row per element and an object gives one row. A
    missing key is an error naming the key, and so is a plain value. A whole
    number in the path picks a list element. Fields a record lacks are NULL,
    and a NULL body has no records. Without a schema the fields are those found
    in any record, which takes a pass of its own.
    """
    require(df, [body, *keep], "json_records")
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    parsed, steps = F.parse_json(col(body)), _segments(record_path)
    paths = ["$"]
    for step in steps:
        paths.append(paths[-1] + (f"[{step}]" if step.isdigit() else f"['{step}']"))
    found = F.try_variant_get(parsed, paths[-1], "variant")
    # Looked at only when nothing was found: the first key that is not there.
    missing = F.coalesce(
        *[F.when(F.try_variant_get(parsed, p, "variant").isNull(), F.lit(s)) for p, s in zip(paths[1:], steps)],
        F.lit(""),
    )
    error = F.raise_error(F.concat(F.lit("json_records: key '"), missing, F.lit("' not found"))).cast("variant")
    value = F.coalesce(found, error) if steps else parsed
    shape = F.schema_of_variant(F.col("_at"))
    checked = (
        F.when(F.startswith(shape, F.lit("ARRAY")), F.col("_at").cast("array<variant>"))
        .when(F.startswith(shape, F.lit("OBJECT")), F.array(F.col("_at")))
        .otherwise(F.raise_error(F.lit("json_records: expected a list or an object")).cast("array<variant>"))
    )
    bodies = df.filter(col(body).isNotNull())
    records = bodies.select(*[col(c) for c in keep], value.alias("_at")).select(
        *[col(c) for c in keep], F.explode(checked).alias("_record")
    )
    if schema is None:
        schema = _found_schema(records)
    return records.select(*[col(c) for c in keep], *[_field(f) for f in schema.fields])


def _found_schema(records: DataFrame) -> T.StructType:
    """The fields of all records; one that is null everywhere is text."""
    found = records.agg(F.schema_of_variant_agg("_record").alias("s")).first()["s"]
    if not found.startswith("OBJECT<"):
        raise ValueError(f"json_records: records have no fields in common, found {found}")
    ddl = re.sub(r"\bOBJECT<", "STRUCT<", found)
    return T.DataType.fromDDL(re.sub(r": VOID\b", ": STRING", ddl))


def _field(field_: T.StructField) -> Column:
    return F.variant_get("_record", f"$['{field_.name}']", field_.dataType.simpleString()).alias(field_.name)


# --- paged source ------------------------------------------------------------


Fetch = Callable[[dict[str, Any]], tuple[int, str]]


def http_fetch(request: dict[str, Any]) -> tuple[int, str]:
    """Fetch one page over HTTP: the status and the text of the answer."""
    import requests

    answer = requests.request(
        request["method"],
        request["url"],
        headers=request["headers"],
        params={**request["params"], "page": request["page"]},
        json=request["body"] or None,
        timeout=request["timeout"],
        verify=request["verify_ssl"],
    )
    return answer.status_code, answer.text


def paged_source(
    spark: SparkSession,
    url: str,
    pages: int,
    fetch: Fetch = http_fetch,
    method: str = "GET",
    headers: dict[str, str] | None = None,
    params: dict[str, Any] | None = None,
    body: dict[str, Any] | None = None,
    timeout: int = 30,
    verify_ssl: bool = True,
) -> DataFrame:
    """``(page, body)``, one task per page. A status other than 2xx is an error.

    ``fetch`` runs in the tasks and gets one request as a dict, with the number
    of its ``page``. :func:`json_records` takes the bodies apart.
    """
    if not url:
        raise ValueError("paged_source: missing 'url'")
    if method.upper() not in ("GET", "POST"):
        raise ValueError("paged_source: method must be GET or POST")
    request = {
        "url": url,
        "method": method.upper(),
        "headers": headers or {},
        "params": params or {},
        "body": body,
        "timeout": timeout,
        "verify_ssl": verify_ssl,
    }

    class PageReader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(i) for i in range(pages)]

        def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
            status, text = fetch({**request, "page": partition.value})
            if not 200 <= status < 300:
                raise RuntimeError(f"page {partition.value}: status {status}")
            yield partition.value, text

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tablecraft_pages"

        def schema(self) -> str:
            return "page int, body string"

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return PageReader()

    spark.dataSource.register(Pages)
    return spark.read.format("tablecraft_pages").load()
