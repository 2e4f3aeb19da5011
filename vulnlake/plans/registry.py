"""Named queries and their SQL equivalents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vulnlake.plans.views import VIEWS, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BODIES: dict[str, str] = {}  # statement text before the views are added


class Tables:
    """Lazy access to the base tables and the derived views of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            base, exprs = VIEWS[name]
            return getattr(self, base).selectExpr(*exprs)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def texts(self, name: str, *cols: str) -> DataFrame:
        """Columns of a text table. The scan's own splits are kept: texts are never shuffled for it."""
        return getattr(self, name).select(*cols)


def query(name: str, sql: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame``; views named in ``sql`` become CTEs."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            BODIES[name] = sql
            ORACLES[name] = with_views(sql)
        return fn

    return wrap


def with_views(body: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for v in VIEWS:
            if v not in needed and re.search(rf"\b{v}\b", text):
                visit(VIEWS[v][0])
                needed.append(v)

    visit(body)
    ctes = ", ".join(f"{v} AS ({view_sql(v)})" for v in needed)
    body = body.strip()
    if not ctes:
        return body
    recursive = re.match(r"(?i)with\s+recursive\s", body)
    if recursive:
        return f"WITH RECURSIVE {ctes}, {body[recursive.end():]}"
    if re.match(r"(?i)with\s", body):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
