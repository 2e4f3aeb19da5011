"""Aggregations over findings, advisories, memory, checks and rounds.

Sets are collected only where the vocabulary is small (tool names, families);
everything else is counted, so a hot group combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.score import SEVERITY_ORDER, rank_of
from vulnlake.operators.ordered import top_k


def dedup_findings(findings: DataFrame, keys=("file", "line", "sink_function")) -> DataFrame:
    """One row per location and function with the tools that agree on it."""
    extra = [F.min(c).alias(c) for c in ("project", "sink_type") if c in findings.columns and c not in keys]
    sources = F.sort_array(F.collect_set("source"))
    return findings.groupBy(*keys).agg(*extra, sources.alias("sources")).withColumn(
        "source_count", F.size("sources").cast("long"))


def dedup_advisories(adv: DataFrame, max_refs: int = 5) -> DataFrame:
    """One row per (vuln_id, package): distinct sources, aliases, the first references and the first severity by ``seq``.

    Single values are made distinct before they are listed, and references are
    limited before they are collected (five is the published shape)."""
    keys = ["vuln_id", "package"]
    base = adv.groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_set("source")), "+").alias("source"), F.min_by("severity", "seq").alias("severity"))
    alias = adv.select(*keys, F.explode("aliases").alias("_a")).groupBy(*keys).agg(F.sort_array(F.collect_set("_a")).alias("aliases"))
    refs = top_k(adv.select(*keys, F.explode("references").alias("_r")).distinct(), keys, ["_r"], max_refs)
    refs = refs.groupBy(*keys).agg(F.sort_array(F.collect_list("_r")).alias("references"))
    none = F.array().cast("array<string>")
    return base.join(alias, keys, "left").join(refs, keys, "left").select(
        *keys, "source", F.coalesce("aliases", none).alias("aliases"), F.coalesce("references", none).alias("references"), "severity")


def severity_histogram(adv: DataFrame, keys=()) -> DataFrame:
    s = F.col("severity")
    return adv.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(s == v).alias(v) for v in SEVERITY_ORDER],
        F.count_if(~s.isin(SEVERITY_ORDER)).alias("other"))


def qc_stats(qc: DataFrame, overall: bool = False) -> DataFrame:
    """Checks, passes, fails, redos and mean pass rate per phase (and in total with ``overall``)."""
    rate = F.col("pass_count") * 100.0 / F.nullif(F.col("total_count"), F.lit(0))
    grouped = qc.rollup("phase") if overall else qc.groupBy("phase")
    return grouped.agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(F.col("verdict") == "pass").alias("passed"),
        F.count_if(F.col("verdict") == "fail").alias("failed"),
        F.sum("redo_count").cast("long").alias("redos"), F.round(F.avg(rate), 1).alias("avg_pass_rate"))


def pass_percent(passed: Column, total: Column) -> Column:
    """Whole percent, N/A when nothing was checked."""
    return F.when(total > 0, F.floor(passed * 100 / total).cast("string")).otherwise("N/A")


def grade(failed: Column, degraded: Column) -> Column:
    """A: nothing failed; B: failures but none degraded; C: one or two degraded; else D."""
    return (F.when(failed == 0, "A").when(degraded == 0, "B").when(degraded <= 2, "C").otherwise("D"))


def high_value_objects(nodes: DataFrame, keys=("project", "data_object"), least: int = 3) -> DataFrame:
    """Objects that at least ``least`` nodes touch, with their families and worst severity."""
    return nodes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("nodes"), F.sort_array(F.collect_set("vuln_type")).alias("types"),
        F.min(rank_of("severity", SEVERITY_ORDER)).alias("_r"),
    ).where(F.col("nodes") >= least).withColumn(
        "max_severity", F.element_at(F.array(*[F.lit(x) for x in [*SEVERITY_ORDER, "unknown"]]), F.col("_r") + 1)
    ).drop("_r")


def technique_feedback(rounds: DataFrame, subject: str = "sink_no", least: int = 3) -> DataFrame:
    """Yield class per strategy from distinct subjects tried and succeeded."""
    won = F.col("result") == "confirmed"
    g = rounds.groupBy("strategy").agg(
        F.countDistinct(subject).alias("subjects"), F.countDistinct(F.when(won, F.col(subject))).alias("won"))
    return g.withColumn(
        "verdict",
        F.when(F.col("subjects") < least, "pending").when(F.col("won") == 0, "low_yield")
        .when(F.col("won") == F.col("subjects"), "high_yield").otherwise("conditional"))


def race_significance(attempts: DataFrame, keys, success: Column, least: int = 20, rate: float = 0.30) -> DataFrame:
    g = attempts.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(success).alias("successes"))
    return g.withColumn(
        "verdict",
        F.when((F.col("attempts") >= least) & (F.col("successes") > rate * F.col("attempts")), "confirmed")
        .when(F.col("successes") > 0, "needs_verification").otherwise("none"))


def differential_verdict(flags: Column) -> Column:
    """How many variants behaved differently from the baseline."""
    return F.when(flags >= 3, "highly_likely").when(flags >= 1, "possible").otherwise("none")


def redirect_verdict(hits: Column) -> Column:
    return F.when(hits >= 3, "highly_vulnerable").when(hits >= 1, "vulnerable").otherwise("safe")


def position_entropy(ids: DataFrame, keys, value: str, least: int = 20) -> DataFrame:
    """Shannon entropy of the characters at each position of the ids of a group."""
    chars = ids.select(*keys, F.posexplode(F.split(value, "")).alias("pos", "ch")).where(F.col("ch") != "")
    counts = chars.groupBy(*keys, "pos", "ch").agg(F.count(F.lit(1)).alias("n"))
    # H = log2(N) - sum(n log2 n) / N needs no second pass over the rows
    g = counts.groupBy(*keys, "pos").agg(F.sum("n").alias("ids"), F.sum(F.col("n") * F.log2("n")).alias("_s"))
    return g.where(F.col("ids") >= least).select(
        *keys, "pos", "ids", F.round(F.log2("ids") - F.col("_s") / F.col("ids"), 6).alias("entropy"))


def merge_schema(columns: DataFrame, order=("migration", "model", "sql", "validation")) -> DataFrame:
    """Column types from several sources: the most trusted source wins."""
    ranked = columns.withColumn("_r", rank_of("origin", list(order)))
    return ranked.groupBy("tbl", "col").agg(
        F.coalesce(F.min_by("type", F.when(F.col("type").isNotNull(), F.col("_r"))), F.lit("VARCHAR(255)")).alias("type"),
        F.min_by("origin", "_r").alias("origin"), F.countDistinct("origin").alias("origins"))
