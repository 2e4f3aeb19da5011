"""Execution traces: reading, noise, exact call stacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.operators.ordered import hot_keys, rank_in_group, running
from vulnlake.session import durable

# Framework bootstrap frames that carry no information.
NOISE = [
    "Composer\\Autoload\\", "spl_autoload_call", "__autoload", "spl_autoload_register", "Illuminate\\Foundation\\Bootstrap\\",
    "Illuminate\\Container\\Container::", "Symfony\\Component\\HttpKernel\\", "Symfony\\Component\\DependencyInjection\\",
    "Symfony\\Bundle\\FrameworkBundle\\", "think\\App::", "think\\Container::", "yii\\base\\Application::bootstrap", "wp-settings.php",
    "wp-includes/plugin.php", "wp-includes/class-wp-hook.php", "wp-load.php", "Cake\\Http\\Server", "Cake\\Routing\\Router",
    "Cake\\Controller\\Controller", "CodeIgniter\\CodeIgniter", "CodeIgniter\\HTTP\\IncomingRequest", "class_exists", "is_file", "file_exists",
]
TRACE_SINKS = ["eval", "assert", "system", "exec", "passthru", "shell_exec", "popen", "proc_open", "unserialize", "include", "require",
               "file_put_contents", "move_uploaded_file", "curl_exec", "mysqli_query", "raw", "query", "statement", "select"]
LARGE_BYTES = 10 * 1024 * 1024
CHAIN_LINES = 500


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def base_name(function: str | Column) -> Column:
    f = _c(function)
    static = F.element_at(F.split(f, "::"), -1)
    return F.lower(F.when(f.contains("::"), static).when(f.contains("->"), F.element_at(F.split(f, "->"), -1)).otherwise(f))


def is_noise(function: str | Column, noise: Sequence[str] = NOISE) -> Column:
    f = _c(function)
    hit = F.lit(False)
    for n in noise:
        hit = hit | f.contains(n)
    return hit


def trace_frames(lines: DataFrame, value: str = "value") -> DataFrame:
    """Entry records of tab-separated trace lines; headers, exits and short records are skipped."""
    p = F.split(value, "\t")
    keep = [c for c in lines.columns if c != value]
    rows = lines.withColumn("_p", p).where(~F.col(value).rlike("^([VFS#]|$)") & (F.size("_p") >= 9) & (F.col("_p")[2] == "0"))
    num = lambda i: F.col("_p")[i].try_cast("int")
    return rows.select(
        *keep, num(0).alias("level"), num(1).alias("func_nr"), F.col("_p")[5].alias("function"), (F.col("_p")[6] == "1").alias("user_defined"),
        F.col("_p")[7].alias("include_file"), F.col("_p")[8].alias("filename"),
        F.coalesce(F.when(F.size("_p") > 9, F.col("_p")[9].try_cast("int")), F.lit(0)).alias("line"))


def stack_depths(frames: DataFrame, order: Sequence[str], key: str = "trace_id") -> DataFrame:
    """Add ``rn`` and ``depth``: the stack size once the frame is pushed.

    Popping while size >= level and then pushing means size = min(size + 1,
    level), whose closed form is a running minimum of (level - position). The
    stack needs no sequential code and works for traces of any length."""
    hot = hot_keys(frames, [key])
    ranked = rank_in_group(frames, [key], list(order), "rn", hot=hot)
    low = running(ranked, [key], ["rn"], {"_low": ("min", F.col("level") - F.col("rn"))}, hot=hot)
    return low.withColumn("depth", F.least(F.col("rn"), F.col("rn") + F.col("_low"))).drop("_low")


def sink_chains(frames: DataFrame, order: Sequence[str], key: str = "trace_id", sinks: Sequence[str] = TRACE_SINKS) -> DataFrame:
    """Call path from the entry to every sink call.

    The caller at depth k is the newest earlier frame that was pushed at depth
    k; each (sink, k) asks for it in an ordered scan per (trace, k)."""
    deep = durable(stack_depths(frames.where(~is_noise("function")), order, key).select(key, "rn", "depth", "function"))
    hits = deep.where(base_name("function").isin(list(sinks)))
    pushed = deep.select(key, F.col("depth").alias("k"), "rn", F.struct("rn", "function").alias("_f"), F.lit(None).cast("long").alias("sink_rn"))
    asks = hits.where("depth > 1").select(
        key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("depth") - 1)).alias("k"), "rn",
        F.lit(None).cast("struct<rn:bigint,function:string>").alias("_f"), F.col("rn").alias("sink_rn"))
    scanned = running(pushed.unionByName(asks), [key, "k"], ["rn"], {"_last": ("max", F.col("_f"))})
    steps = scanned.where(F.col("sink_rn").isNotNull()).select(key, "sink_rn", F.struct("k", F.col("_last.function").alias("function")).alias("_s"))
    # a list holds one path, so its size is the stack depth
    callers = steps.groupBy(key, "sink_rn").agg(F.transform(F.array_sort(F.collect_list("_s")), lambda x: x["function"]).alias("_callers"))
    none = F.array().cast("array<string>")
    out = hits.join(callers.withColumnRenamed("sink_rn", "rn"), [key, "rn"], "left")
    return out.select(key, "rn", F.col("function").alias("sink_function"), F.concat(F.coalesce("_callers", none), F.array("function")).alias("call_path"))


def trim_chains(chains: DataFrame, sizes: DataFrame, key: str = "trace_id", large: int = LARGE_BYTES, lines: int = CHAIN_LINES) -> DataFrame:
    """For large trace files stop once earlier chains fill ``lines`` lines (the published output rule)."""
    n = running(chains, [key], ["rn"], {"_before": ("sum", F.size("call_path"))}, inclusive=False)
    j = n.join(sizes.select(key, "bytes"), key, "left")
    return j.where((F.coalesce("bytes", F.lit(0)) <= large) | (F.coalesce("_before", F.lit(0)) < lines)).drop("_before", "bytes")


def trace_quality(lines: Column, sink_hits: Column, business_frames: Column, error_first: Column, to_login: Column) -> Column:
    return (F.when(lines == 0, "trace_empty").when(to_login, "auth_failed").when(error_first, "error_before_sink")
            .when(sink_hits > 0, F.when(lines > 10000, "valid_oversized").otherwise("valid")).when(business_frames == 0, "route_missed")
            .otherwise("no_sink"))


def error_vs_sink(error_at: Column, sink_at: Column) -> Column:
    return (F.when(error_at.isNull(), "none").when(sink_at.isNull() | (error_at < sink_at), "before_sink").otherwise("after_sink"))
