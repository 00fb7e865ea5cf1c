"""Cleaning steps shared by the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_null_island(df: DataFrame, position_fields: list[str]) -> DataFrame:
    """A (0, 0) position means "no fix": keep the row, clear everything about its position."""
    no_fix = (F.col("lat") == 0) & (F.col("lng") == 0)
    return df.withColumns({c: F.when(F.coalesce(no_fix, F.lit(False)), None).otherwise(F.col(c)) for c in position_fields})


def strip_blank(df: DataFrame, *columns: str) -> DataFrame:
    """Null and blank attributes are the same: clear blank text columns, drop blank entries of maps."""
    types = dict(df.dtypes)
    out = {}
    for c in columns:
        if types[c].startswith("map<"):
            out[c] = F.map_filter(c, lambda k, v: v.isNotNull() & (F.trim(v) != ""))
        else:
            out[c] = F.when(F.trim(c) != "", F.col(c))
    return df.withColumns(out)
