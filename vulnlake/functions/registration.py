"""SQL-callable versions of the scoring rules (temporary SQL functions, no Python per row)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from vulnlake.functions.versions import PRE, STAGES

#: Weights of a CVSS 3.1 vector's metrics (published constants).
CVSS_WEIGHTS = {"AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}, "AC": {"L": 0.77, "H": 0.44}, "UI": {"N": 0.85, "R": 0.62}, "C": {"H": 0.56, "L": 0.22, "N": 0.0},
                "I": {"H": 0.56, "L": 0.22, "N": 0.0}, "A": {"H": 0.56, "L": 0.22, "N": 0.0}}


def _metric(name: str) -> str:
    return f"regexp_extract(vec, '/{name}:([A-Z])(/|$)', 1)"


def _cvss_base() -> str:
    """Base score of a vector; null where a metric is missing or unknown."""
    weight = lambda m: f"CASE {_metric(m)} " + " ".join(f"WHEN '{k}' THEN {v}D" for k, v in CVSS_WEIGHTS[m].items()) + " END"
    changed = f"{_metric('S')} = 'C'"
    need = f"CASE {_metric('PR')} WHEN 'N' THEN 0.85D WHEN 'L' THEN IF({changed}, 0.68D, 0.62D) WHEN 'H' THEN IF({changed}, 0.5D, 0.27D) END"
    return (f"WITH w AS (SELECT {changed} AS changed, {_metric('S')} AS scope, 8.22D * {weight('AV')} * {weight('AC')} * {need} * {weight('UI')} AS exploit, "
            f"1D - (1D - {weight('C')}) * (1D - {weight('I')}) * (1D - {weight('A')}) AS iss), "
            "i AS (SELECT *, IF(changed, 7.52D * (iss - 0.029D) - 3.25D * pow(iss - 0.02D, 15D), 6.42D * iss) AS impact FROM w WHERE scope IN ('C', 'U')), "
            "n AS (SELECT impact, CAST(round(least(IF(changed, 1.08D * (impact + exploit), impact + exploit), 10D) * 100000) AS BIGINT) AS scaled FROM i) "
            "SELECT max(CASE WHEN scaled IS NULL THEN NULL WHEN impact <= 0 THEN 0D WHEN scaled % 10000 = 0 THEN scaled / 100000D ELSE (floor(scaled / 10000D) + 1) / 10D END) FROM n")


SQL_FUNCTIONS = {
    "vl_severity_hundredths": (
        "r INT, i INT, c INT", "INT", "40 * r + 35 * i + 25 * c"),
    "vl_severity_level": (
        "h INT", "STRING",
        "CASE WHEN h >= 270 THEN 'C' WHEN h >= 210 THEN 'H' WHEN h >= 120 THEN 'M' WHEN h >= 10 THEN 'L' END"),
    "vl_version_key": (
        "v STRING", "ARRAY<BIGINT>",
        "WITH n AS (SELECT regexp_replace(trim(v), '^[vV]+', '') AS t), "
        "p AS (SELECT t, lower(regexp_extract(t, '" + PRE.replace("\\", "\\\\") + "', 1)) AS stage, "
        "coalesce(try_cast(regexp_extract(t, '" + PRE.replace("\\", "\\\\") + "', 2) AS BIGINT), 0L) AS nth, "
        "transform(split(regexp_replace(t, '[-+].*$', ''), '[.]'), x -> coalesce(try_cast(x AS BIGINT), CASE WHEN x RLIKE '^[0-9]+$' THEN 9223372036854775807L ELSE 0L END)) AS nums FROM n) "
        "SELECT concat(slice(nums, 1, array_max(transform(nums, (x, i) -> CASE WHEN x <> 0 THEN i + 1 ELSE 0 END))), "
        "CASE WHEN stage = '' THEN array(0L) ELSE array(-1L, CASE " + " ".join(f"WHEN stage = '{w}' THEN {k}L" for w, k in STAGES.items()) + " END, nth) END) FROM p"),
    "vl_cvss_base": ("vec STRING", "DOUBLE", _cvss_base()),
    "vl_cvss_band": (
        "s DOUBLE", "STRING",
        "CASE WHEN s >= 9 THEN 'CRITICAL' WHEN s >= 7 THEN 'HIGH' WHEN s >= 4 THEN 'MEDIUM' "
        "WHEN s > 0 THEN 'LOW' ELSE 'NONE' END"),
    "vl_score_bucket": (
        "s DOUBLE", "STRING",
        "CASE WHEN s >= 9 THEN 'critical' WHEN s >= 7 THEN 'high' WHEN s >= 4 THEN 'medium' ELSE 'low' END"),
}


def register(spark: SparkSession) -> list[str]:
    for name, (args, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    return list(SQL_FUNCTIONS)
