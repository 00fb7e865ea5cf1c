"""Registration of queries next to the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .fixtures import BASE_TABLES, VIEWS

_VIEW = re.compile(r"\bv_[a-z_]+\b")


def _view_sql(name: str, dialect: str) -> str:
    body = VIEWS[name]
    return body if isinstance(body, str) else body[dialect]


def views_needed(sql: str, dialect: str) -> list[str]:
    """Fixture views a statement uses, dependencies first."""
    seen: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_VIEW.findall(text)):
            if name in VIEWS and name not in seen:
                visit(_view_sql(name, dialect))
                if name not in seen:
                    seen.append(name)

    visit(sql)
    return seen


class Tables:
    """The given tables and the fixture views derived from them, for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        for t in BASE_TABLES:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, statement: str) -> DataFrame:
        for v in views_needed(statement, "spark"):
            self.spark.sql(_view_sql(v, "spark")).createOrReplaceTempView(v)
        return self.spark.sql(statement)

    def view(self, name: str) -> DataFrame:
        return self.sql(f"select * from {name}")


@dataclass
class Entry:
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(tables)`` under ``name``; ``sql`` is the DuckDB statement with equal rows."""

    def wrap(build: Callable[[Tables], DataFrame]):
        REGISTRY[name] = Entry(build, sql)
        return build

    return wrap


def oracle(sql: str) -> str:
    """A self-contained DuckDB statement: the needed fixture views in front as CTEs."""
    ctes = [f"{v} as ({_view_sql(v, 'duck')})" for v in views_needed(sql, "duck")]
    sql = sql.strip()
    m = re.match(r"with\s+(recursive\s+)?", sql, re.I)
    if m:
        head = "with recursive " if m.group(1) else "with "
        return head + ",\n".join([*ctes, sql[m.end():]])
    return ("with " + ",\n".join(ctes) + "\n" + sql) if ctes else sql
