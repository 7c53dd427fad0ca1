"""Exact column lineage of a frame, read off the plan Spark resolved for it.

Only metadata is looked at and no data is read. It needs a classic session: a
remote one does not give access to the plan.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame

Sources = set[tuple[str, str]]
SCHEMA = "node_id string, output_column string, source_node_id string, source_column string, confidence string"


def _items(sequence: Any) -> Iterator[Any]:
    for i in range(sequence.size()):
        yield sequence.apply(i)


def _id(attribute: Any) -> int:
    return attribute.exprId().id()


def _references(expression: Any, known: Mapping[int, Sources]) -> Sources:
    found: Sources = set()
    for attribute in _items(expression.references().toSeq()):
        found |= known.get(_id(attribute), set())
    return found


class _Walk:
    """Resolves each column of a plan to columns of the named inputs."""

    def __init__(self, inputs: Mapping[str, DataFrame]) -> None:
        self.inputs = {name: df._jdf.queryExecution().analyzed() for name, df in inputs.items()}
        self.columns = {name: df.columns for name, df in inputs.items()}
        self.shared: dict[int, list[Sources]] = {}

    def _as_input(self, plan: Any) -> dict[int, Sources] | None:
        kind = plan.nodeName()
        named = plan.desc().identifier().table() if kind == "View" else None
        for name, source in self.inputs.items():
            if name == named or plan.sameResult(source):
                return {_id(a): {(name, c)} for a, c in zip(_items(plan.output()), self.columns[name])}
        return None

    def resolve(self, plan: Any) -> dict[int, Sources]:
        found = self._as_input(plan)
        if found is not None:
            return found
        kind = plan.nodeName()
        if kind == "CTERelationRef":
            return {_id(a): s for a, s in zip(_items(plan.output()), self.shared[plan.cteId()])}
        if kind == "WithCTE":
            for definition in _items(plan.cteDefs()):
                inner = self.resolve(definition.child())
                self.shared[definition.id()] = [inner.get(_id(a), set()) for a in _items(definition.output())]
            return self.resolve(plan.plan())

        children = list(_items(plan.children()))
        maps = [self.resolve(child) for child in children]
        output = list(_items(plan.output()))
        if kind in ("Union", "View"):
            # Columns correspond by position.
            result: dict[int, Sources] = {_id(a): set() for a in output}
            for child, known in zip(children, maps):
                for mine, theirs in zip(output, _items(child.output())):
                    result[_id(mine)] |= known.get(_id(theirs), set())
            return result

        known: dict[int, Sources] = {}
        for m in maps:
            known.update(m)
        for expression in _items(plan.expressions()):
            if expression.nodeName() == "Alias":
                known.setdefault(_id(expression.toAttribute()), _references(expression, known))
        everything: Sources | None = None
        for attribute in output:
            if _id(attribute) not in known:
                # An operator that makes its columns from whole rows.
                if everything is None:
                    everything = set()
                    for expression in _items(plan.expressions()):
                        everything |= _references(expression, known)
                    if not everything:
                        everything = set().union(*known.values())
                known[_id(attribute)] = everything
        return known


def lineage_rows(result: DataFrame, inputs: Mapping[str, DataFrame]) -> dict[str, list[tuple[str, str]]]:
    """Per output column, the input columns its value is made from, sorted."""
    plan = result._jdf.queryExecution().analyzed()
    known = _Walk(inputs).resolve(plan)
    return {c: sorted(known.get(_id(a), set())) for c, a in zip(result.columns, _items(plan.output()))}


def lineage_exact(result: DataFrame, inputs: Mapping[str, DataFrame], node_id: str) -> DataFrame:
    """The lineage table of one step: ``result`` was made from ``inputs``.

    Inputs are found as the frames themselves or as views of their names. A
    column made from no input column, such as a count of rows, has one line
    without a source.
    """
    rows = []
    for column, sources in lineage_rows(result, inputs).items():
        for source, source_column in sources or [(None, None)]:
            rows.append((node_id, column, source, source_column, "sql_exact"))
    return result.sparkSession.createDataFrame(rows, SCHEMA)
