"""Transforms by name: ``fn(inputs, params) -> DataFrame``."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .operators import aggregates, filters, joins, projection, windows

Transform = Callable[[Mapping[str, DataFrame], Mapping[str, Any]], DataFrame]


def _on_first(function: Callable[..., DataFrame]) -> Transform:
    """A transform of the first input, with the parameters as arguments."""

    def transform(inputs: Mapping[str, DataFrame], params: Mapping[str, Any]) -> DataFrame:
        return function(next(iter(inputs.values())), **params)

    return transform


def _pnl(inputs: Mapping[str, DataFrame], params: Mapping[str, Any]) -> DataFrame:
    rest = dict(params)
    keys = rest.pop("positions_key", "positions"), rest.pop("prices_key", "prices")
    for key in keys:
        if key not in inputs:
            raise KeyError(f"compute_pnl: expected inputs {keys}, got {list(inputs)}")
    return joins.compute_pnl(inputs[keys[0]], inputs[keys[1]], **rest)


TRANSFORMS: dict[str, Transform] = {
    "compute_pnl": _pnl,
    **{
        f.__name__: _on_first(f)
        for f in (
            projection.rename_and_select,
            projection.reorder_columns,
            projection.cast_columns,
            projection.coerce_types,
            projection.map_values,
            projection.derive_columns,
            projection.add_revenue,
            projection.classify_change,
            projection.add_market_tier,
            projection.fill_defaults,
            filters.drop_nulls,
            filters.filter_recent,
            aggregates.group_summary,
            windows.top_n,
            windows.add_rank,
            windows.deduplicate_by_key,
            windows.top_n_by_group,
        )
    },
    "select_rename": _on_first(projection.rename_and_select),
}


def find_transform(path: str) -> Transform:
    """A registered transform, or the callable a dotted path names."""
    if path in TRANSFORMS:
        return TRANSFORMS[path]
    module, _, name = path.rpartition(".")
    if not module:
        raise ValueError(f"unknown transform '{path}': expected a registered name or a dotted path")
    return getattr(importlib.import_module(module), name)


def apply_transform(
    path: str, inputs: Mapping[str, DataFrame], params: Mapping[str, Any] | None = None, node: str = "node"
) -> DataFrame:
    """Run a transform; what keeps it from being found is an error naming the node."""
    if not path:
        raise ValueError(f"node '{node}': missing 'transform'")
    try:
        transform = find_transform(path)
    except (ImportError, AttributeError, ValueError) as error:
        raise ValueError(f"node '{node}': cannot load transform '{path}': {error}") from error
    return transform(inputs, dict(params or {}))


def pandas_rowwise(
    df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType
) -> DataFrame:
    """Apply a pandas function to batches of rows; it must not look across rows."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(apply, schema)
