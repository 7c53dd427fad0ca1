"""Compare a query with its SQL, value by value."""

from __future__ import annotations

import datetime
import decimal
import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if value is None:
        return None
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return float(value) if not isinstance(value, int) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    found = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(found, key=repr)


def kinds(columns, rows):
    """The Python type each column shows, to compare schemas loosely."""
    return {
        c: type(next((r[i] for r in rows if r[i] is not None), None)).__name__ for i, c in enumerate(columns)
    }


def compare(df, connection, sql) -> list[str]:
    """What differs between the frame and the SQL; empty when nothing does."""
    result = connection.execute(sql)
    columns, expected = rows_of([d[0] for d in result.description], result.fetchall())
    names, actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if names != columns:
        return [f"columns {names} instead of {columns}"]
    if len(actual) != len(expected):
        return [f"{len(actual)} rows instead of {len(expected)}", f"{actual[:3]} / {expected[:3]}"]
    problems = []
    if kinds(names, actual) != kinds(columns, expected):
        problems.append(f"types {kinds(names, actual)} instead of {kinds(columns, expected)}")
    different = [(a, e) for a, e in zip(actual, expected) if a != e]
    if different:
        problems.append(f"{len(different)} rows differ, e.g. {different[:3]}")
    return problems
