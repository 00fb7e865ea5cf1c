"""Fixed tables as column expressions: a handful of entries need no join."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col


def first_match(cases: Iterable[tuple[Column, object]], default=None) -> Column:
    """Value of the first condition that holds, as one flat CASE."""
    out = None
    for cond, value in cases:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return d if out is None else out.otherwise(d)


def lookup(key, table: Mapping, default=None) -> Column:
    """Value of a small fixed table for a key column."""
    key = col(key)
    return first_match(((key == k, v) for k, v in table.items()), default)
