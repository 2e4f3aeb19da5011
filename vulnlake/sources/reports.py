"""Readers for scanner reports, lock files, advisory feeds and logs (R*).

Every reader takes an explicit schema, so nothing is inferred from the data.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake import schemas


def composer_rows(audit: DataFrame) -> DataFrame:
    """Dependency audit rows in the finding shape."""
    return audit.select(
        F.lit("composer.json").alias("file"), F.lit(0).alias("line"), F.col("package").alias("sink_function"),
        F.lit("known_vuln").alias("sink_type"), F.lit("composer_audit").alias("source"))


def report_rows(reports: DataFrame, results: str = "results") -> DataFrame:
    """One row per result; a failed report counts as empty."""
    return reports.withColumn("result", F.explode_outer(F.coalesce(results, F.array()))).drop(results)


class Shape(NamedTuple):
    """Where a tool's report holds its findings.

    ``walk``: what is opened, level by level; ``v0`` is the document, ``v1`` what the first step yields, ``k1`` its key in an
    object. A field is a path below a level, a key, or a quoted constant; the first of several (``|``) that is there counts."""

    walk: tuple[str, ...]
    file: str
    line: str
    function: str
    kind: str
    where: str = "true"


# fixed values: field names of the published report formats
TOOL_SHAPES = {
    "ast_sinks": [Shape(("v0.sinks | v0",), "v1.file", "v1.line", "v1.function | v1.sink_function", "v1.sink_type | v1.type")],
    "psalm": [Shape(("v0.results | v0",), "v1.file_name", "v1.line_from", "v1.sink | v1.selected_text", "v1.type")],
    "progpilot": [Shape(("v0.results | v0",), "v1.sink_file | v1.source_file", "v1.sink_line | v1.source_line", "v1.sink_name", "v1.vuln_name")],
    "phpstan": [Shape(("v0.files", "v1.messages"), "k1", "v2.line", "v2.identifier", "v2.message"),
                Shape(("v0.results",), "v1.file", "v1.line", "v1.identifier", "v1.message")],
    "semgrep": [Shape(("v0.results",), "v1.path", "v1.start.line | v1.line", "v1.check_id", "v1.extra.metadata.category | v1.category")],
    "codeql": [Shape(("v0.runs", "v1.results"), "v2.locations[0].physicalLocation.artifactLocation.uri", "v2.locations[0].physicalLocation.region.startLine",
                     "v2.ruleId", "v2.properties.kind | v2.kind"),
               Shape(("v0.results",), "v1.uri", "v1.startLine", "v1.ruleId", "v1.kind")],
    "composer_audit": [Shape(("v0.advisories", "v1"), "'composer.json'", "'0'", "v2.packageName | v2.package | k1", "'known_vuln'", "k1 IS NOT NULL"),
                       Shape(("v0.advisories",), "'composer.json'", "'0'", "v1.package", "'known_vuln'", "k1 IS NULL")],
    "context_extractor": [Shape(("v0.layers",), "v1.file", "v1.lines | v1.line", "v0.sink_function", "v0.sink_type", "v1.role = 'SINK'"),
                          Shape(("v0.packs",), "v1.file", "v1.line", "v1.sink_function", "v1.sink_type")],
}


def _place(place: str, kind: str) -> str:
    """SQL of one place of a shape."""
    level, _, path = place.partition(".")
    if place[0] in "'k":
        return place
    return f"try_variant_get({level}, '$.{path}', '{kind}')" if path else f"try_variant_get({level}, '$', '{kind}')"


def _field(text: str, kind: str = "string") -> Column:
    return F.expr(f"coalesce({', '.join(_place(x, kind) for x in text.split(' | '))})")


def _condition(text: str) -> Column:
    """A condition whose paths are read as text."""
    return F.expr(re.sub(r"\bv\d+(?:\.\w+)+", lambda m: _place(m.group(), "string"), text))


def findings_of(docs: DataFrame, tool: str, value: str = "value") -> DataFrame:
    """Findings in report documents (one per row), whatever else the documents hold.

    Text that is no JSON, failed reports and entries without a file give no row; a line that is a range counts from its
    first number; other columns of ``docs`` stay. Every level is a generator over the parsed document, so a report is read
    in one pass without a shuffle."""
    keep = [c for c in docs.columns if c != value]
    spark, parts = docs.sparkSession, []
    parsed = docs.select(*keep, F.try_parse_json(value).alias("v0"))
    for shape in TOOL_SHAPES[tool]:
        rows = parsed
        for n, step in enumerate(shape.walk, 1):
            entries = spark.tvf.variant_explode(_field(step, "variant").outer()).select(F.col("key").alias(f"k{n}"), F.col("value").alias(f"v{n}"))
            rows = rows.lateralJoin(entries)
        line = F.regexp_extract(_field(shape.line), "^[0-9]+", 0).try_cast("int")
        parts.append(rows.where(_condition(shape.where)).select(
            *keep, _field(shape.file).alias("file"), line.alias("line"), _field(shape.function).alias("sink_function"),
            _field(shape.kind).alias("sink_type"), F.lit(tool).alias("source")).where("file IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts)


def read_findings(spark: SparkSession, reports: str | DataFrame, tool: str) -> DataFrame:
    """A tool's reports (a folder of files, or a frame with a text column ``value``) in the shape file, line,
    sink_function, sink_type, source."""
    docs = spark.read.text(reports, wholetext=True) if isinstance(reports, str) else reports
    return findings_of(docs, tool)


def tool_status(spark: SparkSession, path: str) -> DataFrame:
    reports = spark.read.schema("status string").option("multiLine", True).json(path)
    return reports.select(F.col("_metadata.file_name").alias("report"), F.coalesce("status", F.lit("ok")).alias("status"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """Parsed rows and the lines that do not parse; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return parse_jsonl(lines, schema)


def parse_jsonl(lines: DataFrame, schema: T.StructType | str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    ddl = schema if isinstance(schema, str) else schema.simpleString()[7:-1]
    full = f"{ddl}, _bad string"
    parsed = lines.withColumn("_row", F.from_json(value, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = parsed.where(F.col("_row").isNotNull() & F.col("_row._bad").isNull())
    bad = parsed.where(F.col("_row").isNull() | F.col("_row._bad").isNotNull())
    keep = [c for c in lines.columns if c != value]
    return good.select(*keep, "_row.*").drop("_bad"), bad.select(*keep, value)


def read_lockfile(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("project"), "value")
    return lockfile_rows(files)


LOCK_SCHEMA = "packages array<struct<name:string,version:string>>, `packages-dev` array<struct<name:string,version:string>>"


def lockfile_rows(files: DataFrame, value: str = "value") -> DataFrame:
    """Packages and dev packages of each lock file, without the leading v."""
    lock = files.select("project", F.from_json(value, LOCK_SCHEMA).alias("l"))
    tagged = lambda col, dev: F.transform(
        F.coalesce(F.col("l").getField(col), F.array()),
        lambda p: F.struct(p["name"].alias("package"), p["version"].alias("version"), F.lit(dev).alias("is_dev")))
    rows = lock.select("project", F.explode(F.concat(tagged("packages", False), tagged("packages-dev", True))).alias("p"))
    return rows.select("project", "p.package", F.regexp_replace("p.version", "^v", "").alias("version"), "p.is_dev")


def advisory_batches(batches: DataFrame, summary_len: int = 200, refs: int = 3) -> DataFrame:
    """Feed shape A: results aligned with queries by position."""
    from vulnlake.functions.score import score_bucket

    zipped = batches.select(F.explode(F.arrays_zip("queries", "results")).alias("z"))
    rows = zipped.select(F.col("z.queries.package").alias("package"), F.explode("z.results.vulns").alias("v"))
    text = F.lower("v.severity_text")
    return rows.select(
        F.col("v.id").alias("vuln_id"), "package",
        F.coalesce(F.when(text.isin("critical", "high", "medium", "low"), text), score_bucket("v.score")).alias("severity"),
        F.substring("v.summary", 1, summary_len).alias("summary"), F.slice("v.references", 1, refs).alias("references"))


def advisory_lists(lists: DataFrame, vendors: list[str] | DataFrame, keep: int = 10) -> DataFrame:
    """Feed shape B: the first matches of each package of the listed vendors."""
    vendor = F.split("package", "/")[0]
    rows = lists.withColumn("vendor", vendor)
    if isinstance(vendors, DataFrame):
        rows = rows.join(vendors, "vendor", "left_semi")
    else:
        rows = rows.where(F.col("vendor").isin(vendors))
    return rows.select("package", F.posexplode(F.slice("matches", 1, keep)).alias("pos", "vuln_id"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESPONSE).json(path)


def parse_headers(raw: str | Column) -> Column:
    """Raw header text to a map with lower-cased names; the last of equal names wins."""
    h = F.col(raw) if isinstance(raw, str) else raw
    lines = F.filter(F.split(h, "\r?\n"), lambda x: x.contains(":"))
    name = lambda x: F.lower(F.trim(F.split(x, ":", 2)[0]))
    pairs = F.transform(lines, lambda x: F.struct(name(x).alias("k"), F.trim(F.split(x, ":", 2)[1]).alias("v")))
    # keep the last entry of each name so that the map has unique keys
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def location_of(raw: str | Column) -> Column:
    h = F.col(raw) if isinstance(raw, str) else raw
    return F.nullif(F.trim(F.regexp_extract(h, r"(?im)^Location:[ \t]*([^\r\n]+)", 1)), F.lit(""))


def is_redirect(status: str | Column) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return s.isin(301, 302, 303, 307, 308)


ENV_LINE = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_.]*)\s*=\s*(.*?)\s*$"


def env_pairs(lines: DataFrame, value: str = "value") -> DataFrame:
    """key = value pairs of .env and ini lines; comments and sections are skipped."""
    v = F.col(value)
    rows = lines.where(v.rlike(ENV_LINE) & ~v.rlike(r"^\s*[#;\[]"))
    unquoted = F.regexp_replace(F.regexp_extract(v, ENV_LINE, 2), r"^[\"'](.*)[\"']$", "$1")
    return rows.select(*[c for c in lines.columns if c != value], F.regexp_extract(v, ENV_LINE, 1).alias("key"), unquoted.alias("val"))


ACCESS_LINE = r'^(\S+) \S+ (\S+) \[([^\]]*)\] "([A-Z]+) (\S+)[^"]*" (\d{3}) (\d+|-)'


def access_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """Fields of common-format access log lines; other lines are dropped to ``null`` fields."""
    part = lambda i: F.nullif(F.regexp_extract(value, ACCESS_LINE, i), F.lit(""))
    return lines.select(
        *[c for c in lines.columns if c != value], part(1).alias("client"), part(2).alias("user"), part(3).alias("at"),
        part(4).alias("method"), part(5).alias("uri"), part(6).cast("int").alias("status"),
        F.expr(f"try_cast(nullif(regexp_extract({value}, r'{ACCESS_LINE}', 7), '') AS BIGINT)").alias("bytes"))


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DIFF_ROW).json(path)


def read_points(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(schemas.STORE_POINT if kind == "store" else schemas.USE_POINT).json(path)


def callback_summary(log: DataFrame, last: int = 2) -> tuple[DataFrame, DataFrame]:
    """Number of recorded callbacks and the newest ones."""
    return log.agg(F.count(F.lit(1)).alias("callbacks")), log.orderBy(F.desc("ts"), F.desc("event_id")).limit(last)


def artifact_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Paths and sizes only; file contents are never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
