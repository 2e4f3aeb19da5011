"""Completeness and consistency checks over outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(routes: DataFrame, analysed: DataFrame, keys: Sequence[str], has_auth: Column) -> DataFrame:
    """Auth and route coverage with their thresholds (80 and 90 percent)."""
    marked = routes.join(analysed.select("route_id").distinct().withColumn("_a", F.lit(1)), "route_id", "left")
    g = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("routes"), F.count_if(has_auth).alias("with_auth"), F.count("_a").alias("analysed"))
    pct = lambda c: F.round(F.col(c) * 100.0 / F.col("routes"), 2)
    return g.withColumn("auth_pct", pct("with_auth")).withColumn("auth_ok", F.col("with_auth") * 100 >= F.col("routes") * 80).withColumn(
        "route_pct", pct("analysed")).withColumn("route_ok", F.col("analysed") * 100 >= F.col("routes") * 90)


RESIDUE = "【填写】|TODO|TBD|PLACEHOLDER|xxx"  # fixed value: template marks that must not remain
FILE_NAME = r"^[a-z][a-z0-9_-]*\.json$"


def artifact_problems(files: DataFrame, name: str, text: str, json_expected: Column | None = None) -> DataFrame:
    """Placeholder residue, broken JSON, encoding and file name of written artifacts."""
    wants_json = json_expected if json_expected is not None else F.col(name).endswith(".json")
    t = F.col(text)
    problems = F.array_compact(F.array(
        F.when(t.rlike(RESIDUE), "placeholder"), F.when(wants_json & F.expr(f"try_parse_json({text})").isNull(), "json"),
        F.when(~F.is_valid_utf8(t), "encoding"), F.when(F.col(name).endswith(".json") & ~F.col(name).rlike(FILE_NAME), "file_name")))
    return files.select(*[c for c in files.columns if c != text], problems.alias("problems"))


def conformance_problems(rows: DataFrame, rules: list[tuple[str, str, object]]) -> DataFrame:
    """Reasons a record breaks its schema: required, enum, pattern, range per field."""
    checks = []
    for field, kind, arg in rules:
        c = F.col(field)
        bad = {
            "required": lambda: c.isNull(), "enum": lambda: ~c.isin(list(arg)), "pattern": lambda: ~c.rlike(arg),
            "range": lambda: ~c.between(*arg),
        }[kind]()
        checks.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{field}:{kind}")))
    return rows.withColumn("problems", F.array_compact(F.array(*checks)))


def schema_rules(schema) -> list[tuple[str, str, object]]:
    """Required-field rules of a StructType (fields declared not nullable)."""
    return [(f.name, "required", None) for f in schema.fields if not f.nullable]


def gate_results(manifest: DataFrame, gates: dict[str, list[str]]) -> DataFrame:
    """Pass or fail per run and gate from the artifacts a run left.

    Only presence flags are aggregated, so a run with many files stays one row."""
    paths = sorted({p for ps in gates.values() for p in ps})
    have = manifest.groupBy("run").agg(*[F.max(F.col("path").rlike(p.replace(".", r"\.").replace("*", ".*") + "$")).alias(f"p{i}") for i, p in enumerate(paths)])
    at = {p: F.col(f"p{i}") for i, p in enumerate(paths)}
    rows = F.array(*[F.struct(F.lit(g).alias("gate"), F.array_compact(F.array(*[F.when(~at[p], F.lit(p)) for p in ps])).alias("missing")) for g, ps in gates.items()])
    return have.select("run", F.explode(rows).alias("g")).select("run", "g.*").withColumn("passed", F.size("missing") == 0)
