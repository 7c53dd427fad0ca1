"""The library's operators as queries over the test tables, each with its SQL."""

from . import checks, flows, frames, graphs, grouping, logs, storage, tracing  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
