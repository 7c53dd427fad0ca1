"""Questions to a cube, asked of a fact table with its dimensions joined on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_of, col, require
from .filters import union_all


GROUPING = "grouping_id"


def grouping_sets(rows: Sequence[str], totals: str | Sequence[Sequence[str]] | None) -> list[tuple[str, ...]]:
    """The sets of levels that ``totals`` names: ``rollup`` drops levels from the last to the first, ``cube``
    takes every choice of levels, a list of lists is taken as it is, with all levels before it."""
    whole = tuple(rows)
    if totals is None:
        return [whole]
    if totals == "rollup":
        return [whole[:n] for n in range(len(whole), -1, -1)]
    if totals == "cube":
        return [tuple(r for i, r in enumerate(whole) if not mask >> (len(whole) - 1 - i) & 1) for mask in range(2 ** len(whole))]
    if isinstance(totals, str):
        raise ValueError("cube_query: totals must be 'rollup', 'cube' or a list of lists of levels")
    chosen = [tuple(r for r in whole if r in wanted) for wanted in totals]
    unknown = {r for wanted in totals for r in wanted} - set(whole)
    if unknown:
        raise KeyError(f"cube_query: no such level on rows: {sorted(unknown)}")
    return list(dict.fromkeys([whole, *chosen]))


def _at_all_sets(facts: DataFrame, rows: Sequence[str], sets: Sequence[Sequence[str]]) -> DataFrame:
    """Each fact once per set of levels, under ``_level<i>`` and its grouping id.

    A level outside the set is NULL, and its bit in the grouping id is 1, the first level's bit being the
    highest: so a total and a missing member stay apart. The copies are folded before the shuffle.
    """
    structs = []
    for chosen in sets:
        number = sum(1 << (len(rows) - 1 - i) for i, r in enumerate(rows) if r not in chosen)
        members = [
            (col(r) if r in chosen else F.lit(None).cast(facts.schema[r].dataType)).alias(f"level{i}") for i, r in enumerate(rows)
        ]
        structs.append(F.struct(F.lit(number).alias("id"), *members))
    each = facts.withColumn("_set", F.explode(F.array(*structs)))
    names = {f"_level{i}": F.col(f"_set.level{i}") for i in range(len(rows))}
    return each.withColumns({"_grouping": F.col("_set.id"), **names}).drop("_set")


def cube_query(
    facts: DataFrame,
    measures: Mapping[str, Column],
    rows: Sequence[str],
    columns: Mapping[str, Sequence[Any]] | None = None,
    slicers: Mapping[str, Any] | None = None,
    calculated: Mapping[str, str] | None = None,
    sets: Mapping[str, Sequence[Any]] | None = None,
    non_empty_rows: bool = True,
    non_empty_columns: bool = False,
    totals: str | Sequence[Sequence[str]] | None = None,
    column_total: str | None = None,
) -> DataFrame:
    """Measures on columns and members on rows, for the slice the slicers leave.

    ``measures`` maps a name to an aggregate. ``columns`` maps one level to the
    members to spread over columns; each cell is then ``member · measure``.
    ``slicers`` maps a level to a member or a list of members, ``sets`` maps a
    row level to the members to show, ``calculated`` derives members from the
    measure columns with SQL expressions. ``non_empty_rows`` drops rows without
    any value; ``non_empty_columns`` drops such columns, which needs one
    aggregate over the grouped result.

    ``totals`` (``rollup``, ``cube``, or a list of lists of row levels) adds the rows of the All members, and
    the column ``grouping_id`` after the levels: a bit per level, the first level's the highest, which is 1
    where the row stands for all members of the level. A NULL level with bit 0 is a missing member.
    ``column_total`` names a further member on columns, which stands for all members of their level,
    listed or not. Totals are aggregates of the facts, not of other cells, so any measure may be used,
    and all of them come from one pass over the facts.
    """
    require(facts, rows, "cube_query")
    for level, wanted in {**(slicers or {}), **(sets or {})}.items():
        members = list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]
        facts = facts.filter(col(level).isin(members))
    if column_total is not None and not columns:
        raise ValueError("cube_query: column_total needs a level on columns")
    keys = [col(r) for r in rows]
    if totals is not None:
        facts = _at_all_sets(facts, rows, grouping_sets(rows, totals))
        keys = [F.col("_grouping"), *[F.col(f"_level{i}") for i in range(len(rows))]]
    if columns:
        ((level, members),) = columns.items()
        members, spread = list(members), level
        if column_total is not None:
            if column_total in [str(m) for m in members]:
                raise ValueError(f"cube_query: '{column_total}' is a member of '{level}' as well")
            # A missing member is no cell of its own, but part of the total.
            text = col(level).cast("string")
            both = F.array(F.struct(text.alias("m")), F.struct(F.lit(column_total).alias("m")))
            facts, spread = facts.withColumn("_both", F.explode(both)).withColumn("_member", F.col("_both.m")), "_member"
            members = [*[str(m) for m in members], column_total]
        pivoted = facts.groupBy(*keys).pivot(spread, members).agg(*[m.alias(n) for n, m in measures.items()])
        single = len(measures) == 1
        names = {}
        for member in members:
            for name in measures:
                names[f"{member}" if single else f"{member}_{name}"] = f"{member} · {name}"
        result = pivoted.withColumnsRenamed(names)
        cells = list(names.values())
    else:
        result = facts.groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])
        cells = list(measures)
    if totals is not None:
        levels = [F.col(f"_level{i}").alias(r) for i, r in enumerate(rows)]
        result = result.select(*levels, F.col("_grouping").alias(GROUPING), *[col(c) for c in cells])
    for name, text in (calculated or {}).items():
        result = result.withColumn(name, F.expr(text))
        cells.append(name)
    if non_empty_rows:
        result = result.filter(any_of(col(c).isNotNull() for c in cells))
    if non_empty_columns:
        filled = result.agg(*[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(cells)]).first()
        result = result.drop(*[c for i, c in enumerate(cells) if not filled[f"c{i}"]])
    return result


def level_members(dimension: DataFrame, level: str, max_members: int | None = None) -> DataFrame:
    """The distinct members of a level in order: all, or the first ``max_members``."""
    require(dimension, [level], "level_members")
    members = dimension.select(col(level).alias("member")).filter(F.col("member").isNotNull()).distinct()
    ordered = members.orderBy("member")
    return ordered if max_members is None else ordered.limit(max_members)


def cube_metadata(dimensions: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Per dimension and level, from the top level down: how many members it has.

    All levels of a dimension are counted in one pass over its table.
    """
    parts = []
    for name, (table, levels) in dimensions.items():
        require(table, levels, "cube_metadata")
        counted = table.agg(*[F.count_distinct(col(c)).alias(f"n{i}") for i, c in enumerate(levels)])
        lines = [
            F.struct(
                F.lit(name).alias("dimension"), F.lit(c).alias("level"), F.lit(i).alias("level_number"), F.col(f"n{i}").alias("n_members")
            )
            for i, c in enumerate(levels)
        ]
        if lines:
            parts.append(counted.select(F.inline(F.array(*lines))))
    return union_all(*parts)
