"""Reading tables of the catalog, of other catalogs and of JDBC databases."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import quoted


def read_table(
    spark: SparkSession,
    table: str | None = None,
    query: str | None = None,
    override: str | None = None,
    template: str | None = None,
    args: Mapping[str, Any] | None = None,
    **frames: DataFrame,
) -> DataFrame:
    """A table, or the result of a query.

    An override comes first, then a template; otherwise exactly one of
    ``table`` and ``query`` is to be given. ``args`` fill ``:name`` markers and
    ``frames`` fill ``{name}``.
    """
    text = override or template
    if not text:
        if table and query:
            raise ValueError("read_table: specify 'table' or 'query', not both")
        if not table and not query:
            raise ValueError("read_table: must specify 'table' or 'query'")
        if table:
            return spark.table(table)
        text = query
    return spark.sql(text, args=dict(args) if args else None, **frames)


def read_external_table(spark: SparkSession, table: str, catalog: str) -> DataFrame:
    """A table of another catalog; a name without a dot is looked up in ``catalog``."""
    name = table if "." in table else f"{catalog}.{quoted(table)}"
    return spark.table(name)


@dataclass(frozen=True)
class Connection:
    """How to reach a database: its JDBC address and further reader options."""

    url: str
    options: Mapping[str, str] = field(default_factory=dict)


def resolve_connection(
    url: str | None = None,
    key: str | None = None,
    connections: Mapping[str, Connection] | None = None,
    **inline: str,
) -> Connection:
    """An address as given, else a named connection, else inline fields."""
    if url:
        return Connection(url, inline)
    if key:
        known = connections or {}
        if key not in known:
            raise KeyError(f"connection '{key}' not found; available: {sorted(known)}")
        return known[key]
    if inline.get("subprotocol") and inline.get("database"):
        rest = {k: v for k, v in inline.items() if k not in ("subprotocol", "server", "database")}
        server = f"//{inline['server']}/" if inline.get("server") else ""
        return Connection(f"jdbc:{inline['subprotocol']}:{server}{inline['database']}", rest)
    raise ValueError("no connection configured: give 'url', 'key', or 'subprotocol' and 'database'")


def jdbc_options(
    connection: Connection,
    query: str | None = None,
    table: str | None = None,
    *,
    partition: tuple[str, Any, Any, int] | None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Reader options for a query or table.

    ``partition`` is ``(column, lower, upper, partitions)`` and reads ranges in
    parallel. It must be given; ``None`` says that one task may read all rows.
    """
    if bool(query) == bool(table):
        raise ValueError("give either a query or a table")
    options = {"url": connection.url, "fetchsize": str(fetch_size), **connection.options}
    if partition:
        column, lower, upper, count = partition
        options |= {
            "dbtable": table or f"({query}) q",
            "partitionColumn": column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(count),
        }
    elif table:
        options["dbtable"] = table
    else:
        options["query"] = query
    return options


def read_jdbc(spark: SparkSession, connection: Connection, **what: Any) -> DataFrame:
    """Rows of a query or table of a JDBC database; see :func:`jdbc_options`."""
    return spark.read.format("jdbc").options(**jdbc_options(connection, **what)).load()
