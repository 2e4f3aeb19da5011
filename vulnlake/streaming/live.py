"""Live behaviour as Structured Streaming (G*).

Every stateful step has a one-hour watermark: later rows are dropped and show
up in ``numRowsDroppedByWatermark`` of the query progress. ``split_late`` keeps
them instead: sums of the rows in time and a side table of the late ones, which
``completed`` merges to what a batch over all rows gives.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from vulnlake.operators.ordered import failure_streak

LATE = "1 hour"
BOARD_KEY = ["source_agent", "finding_type", "data_key", "data_value"]


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as they arrive; ``files_per_trigger`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def event_time(stream: DataFrame, ts: str = "ts", late: str = LATE) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def live_board(stream: DataFrame, key=BOARD_KEY, late: str = LATE) -> DataFrame:
    """Append-only shared findings, one row per key within the watermark."""
    return event_time(stream, late=late).dropDuplicatesWithinWatermark(list(key))


def progress_panel(stream: DataFrame, width: str = "5 seconds", late: str = LATE) -> DataFrame:
    w = event_time(stream, late=late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


def failure_bursts(stream: DataFrame, key: str, failed: Column, limit: int = 10, width: str = "10 minutes", slide: str = "1 minute", late: str = LATE) -> DataFrame:
    """Keys with at least ``limit`` failures in a sliding window."""
    w = event_time(stream, late=late).where(failed).groupBy(key, F.window("ts", width, slide).alias("w")).agg(F.count(F.lit(1)).alias("failures"))
    return w.where(F.col("failures") >= limit).select(key, F.col("w.start").alias("start"), "failures")


def run_sessions(stream: DataFrame, key: str, idle: str = "10 minutes", late: str = LATE) -> DataFrame:
    s = event_time(stream, late=late).groupBy(key, F.session_window("ts", idle).alias("w")).agg(F.count(F.lit(1)).alias("records"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "records")


def missing_followup(starts: DataFrame, ends: DataFrame, key: str, within: str, late: str = LATE) -> DataFrame:
    """Starts with no end of the same key in time: a left outer stream-stream join that keeps the unmatched side.

    Serves both the security-event/log check and the producer timeout."""
    a = event_time(starts, late=late).select(F.col(key).alias("_k"), F.col("ts").alias("_t"), *[F.col(c).alias(f"a_{c}") for c in starts.columns if c != "ts"])
    b = event_time(ends, late=late).select(F.col(key).alias("_j"), F.col("ts").alias("_e"))
    span = (F.col("_k") == F.col("_j")) & (F.col("_e") >= F.col("_t")) & (F.col("_e") <= F.col("_t") + F.expr(f"INTERVAL {within}"))
    j = a.join(b, span, "left_outer").where(F.col("_e").isNull())
    return j.select(F.col("_t").alias("ts"), *[F.col(f"a_{c}").alias(c) for c in starts.columns if c != "ts"])


def enrich(stream: DataFrame, static: DataFrame, on) -> DataFrame:
    """Stream-static left join; the static side is planned again for every batch."""
    return stream.join(static, on, "left")


def stuck_detector(state_path: str, key: str, order: list[str], failed: Column, emit: Callable[[DataFrame, int], None], last: int = 3, start: int = 4):
    """foreachBatch function: the streak rule with one carried row per key.

    State of batch n is written under its number and read by batch n+1, so a
    retried batch starts from the same state and gives the same result."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_f", failed)
        now = failure_streak(rows, [key], order, F.col("_f"))
        if batch_id > 0:
            old = spark.read.parquet(f"{state_path}/{batch_id - 1}").select(key, F.col("rounds").alias("_r0"), F.col("streak").alias("_s0"))
            now = now.join(old, key, "left").fillna(0, ["_r0", "_s0"])
        else:
            old = None
            now = now.withColumn("_r0", F.lit(0).cast("long")).withColumn("_s0", F.lit(0).cast("long"))
        # a streak that fills the whole batch of a key continues the carried one
        joined = now.withColumn("_streak", F.when(F.col("streak") == F.col("rn"), F.col("streak") + F.col("_s0")).otherwise(F.col("streak"))).withColumn(
            "round", F.col("rn") + F.col("_r0"))
        emit(joined.where((F.col("round") >= start) & (F.col("_streak") >= last)).select(*batch.columns, "round", F.col("_streak").alias("streak")), batch_id)
        ended = joined.groupBy(key).agg(F.max("round").alias("rounds"), F.max_by("_streak", "rn").alias("streak"))
        if old is not None:
            kept = old.select(key, F.col("_r0").alias("rounds"), F.col("_s0").alias("streak")).join(ended, key, "left_anti")
            ended = ended.unionByName(kept)
        ended.write.mode("overwrite").parquet(f"{state_path}/{batch_id}")

    return handle


def run_once(stream: DataFrame, out: str, checkpoint: str):
    """Process what is available, append it to parquet and return the finished query."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_batches(stream: DataFrame, handle, checkpoint: str):
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


class Arrivals(StreamingQueryListener):
    """Rows per batch as ``observed`` streams report them: {(query id, batch): {metric: value}}."""

    def __init__(self, name: str = "arrived"):
        self.name, self.batches = name, {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = row.asDict()

    def onQueryTerminated(self, event):
        pass


def observed(stream: DataFrame, name: str = "arrived", ts: str = "ts") -> DataFrame:
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def split_late(root: str, sums: Callable[[DataFrame], DataFrame], ts: str = "ts", late: str = LATE):
    """foreachBatch function: ``sums`` of the rows in time, and the rows that come later than ``late`` behind the newest
    row of all earlier batches.

    Everything stands under the number of its batch, the newest time as well, so a batch that runs again replaces its own
    files. What is written per batch is its sums, its late rows and one row of counts."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = spark.read.parquet(f"{root}/counts/{batch_id - 1}").first()["newest"] if batch_id else None
        is_late = F.lit(False) if mark is None else F.coalesce(F.col(ts) < F.lit(mark) - F.expr(f"INTERVAL {late}"), F.lit(False))
        rows = batch.withColumn("_late", is_late).persist()
        try:
            sums(rows.where("NOT _late").drop("_late")).write.mode("overwrite").parquet(f"{root}/sums/{batch_id}")
            rows.where("_late").drop("_late").write.mode("overwrite").parquet(f"{root}/late/{batch_id}")
            count = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("_late").alias("late"), F.greatest(F.max(ts), F.lit(mark).cast("timestamp")).alias("newest"))
            count.write.mode("overwrite").parquet(f"{root}/counts/{batch_id}")
        finally:
            rows.unpersist()

    return handle


def completed(spark: SparkSession, root: str, sums: Callable[[DataFrame], DataFrame], keys: list[str], value: str = "n") -> DataFrame:
    """Sums over all rows, those that came late included."""
    parts = [spark.read.parquet(f"{root}/sums/*"), sums(spark.read.parquet(f"{root}/late/*"))]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum(value).alias(value))


def late_counts(spark: SparkSession, root: str) -> DataFrame:
    """rows and late rows of each batch."""
    return spark.read.parquet(f"{root}/counts/*").select("rows", "late")
