"""Column helpers shared by the operators: words, let-bindings, null-safe texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that separate words.
SPACE = r"[\x20\x09-\x0D]+"
#: The same set as characters, for trimming.
SPACE_CHARS = " \t\n\x0b\f\r"


def whole(text: Column) -> Column:
    """The text; a null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it inside other lambdas.

    A plain expression inside a lambda is computed again for every element; a lambda's own argument is not.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Maximal runs of other characters than ``SPACE_CHARS``; an empty array if there are none."""
    return let(F.btrim(whole(text), F.lit(SPACE_CHARS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE)))


def lines(text: Column) -> Column:
    return F.split(whole(text), "\n")


def same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """A join condition under which nulls are equal."""
    cond = F.lit(True)
    for n in names:
        cond = cond & a[n].eqNullSafe(b[n])
    return cond


def tidy() -> None:
    """At the end of a task in a Python worker: give freed memory back to the system.  Workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass
