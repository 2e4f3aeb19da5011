"""Streams give what the batch operators give; late rows are dropped and counted."""

from pyspark.sql import functions as F

from vulnlake.operators import windows
from vulnlake.streaming import live

DDL = "user_id int, event_id int, ts timestamp, result string"


def write(spark, rows, path):
    spark.createDataFrame(rows, "user_id int, event_id int, ts string, result string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(path))


def test_stuck_detector_carries_state_between_batches(spark, tmp_path):
    src, n = tmp_path / "in", 0
    every = []
    q = lambda: live.run_batches(
        live.read_stream(spark, str(src), DDL), live.stuck_detector(
            str(tmp_path / "state"), "user_id", ["ts", "event_id"], F.col("result") == "failed",
            lambda df, b: df.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={b}"))), str(tmp_path / "ckpt"))
    for batch in (["failed", "ok", "failed"], ["failed", "failed", "ok"], ["failed"], ["failed", "failed"]):
        rows = []
        for r in batch:
            for user in (1, 2):
                n += 1
                rows.append((user, n, f"2024-01-01 00:{n:02d}:00", r if user == 1 else "failed"))
        every += rows
        write(spark, rows, src)
        q()
    full = spark.createDataFrame(every, "user_id int, event_id int, ts string, result string")
    want = {(r.user_id, r.event_id) for r in windows.stuck_rounds(full, ["user_id"], ["ts", "event_id"]).collect()}
    got = {(r.user_id, r.event_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want and want


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    src = tmp_path / "in"
    agg = lambda: live.progress_panel(live.read_stream(spark, str(src), DDL).withColumnRenamed("result", "event_type"), "1 minute")
    run = lambda: live.run_once(agg(), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    write(spark, [(1, 1, "2024-01-01 10:00:00", "a"), (1, 2, "2024-01-01 13:00:00", "a")], src)
    run()
    write(spark, [(1, 3, "2024-01-01 09:00:00", "late"), (1, 4, "2024-01-01 15:00:00", "a")], src)
    q = run()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    rows = {(str(r.start), r.event_type) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert dropped >= 1 and not any(e == "late" for _, e in rows)
    assert ("2024-01-01 10:00:00", "a") in rows


def test_late_rows_are_kept_and_merged(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "state")
    sums = lambda df: df.groupBy(F.date_trunc("hour", "ts").alias("start"), "result").agg(F.count(F.lit(1)).alias("n"))
    heard = live.Arrivals()
    spark.streams.addListener(heard)
    handle = live.split_late(root, sums)
    run = lambda: live.run_batches(live.observed(live.read_stream(spark, str(src), DDL)), handle, str(tmp_path / "ckpt"))
    batches = [[(1, 1, "2024-01-01 10:00:00", "a"), (1, 2, "2024-01-01 13:00:00", "a")], [(1, 3, "2024-01-01 09:00:00", "late"), (1, 4, "2024-01-01 12:30:00", "a"), (1, 5, "2024-01-01 15:00:00", "a")],
               [(1, 6, "2024-01-01 10:20:00", "a"), (1, 7, None, "a")]]
    for rows in batches:
        write(spark, rows, src)
        run()
    every = spark.read.schema(DDL).parquet(str(src))
    want = sorted(map(tuple, sums(every).collect()), key=str)
    done = lambda: sorted(map(tuple, live.completed(spark, root, sums, ["start", "result"]).select("start", "result", "n").collect()), key=str)
    assert done() == want and sorted(map(tuple, live.late_counts(spark, root).collect())) == [(2, 0), (2, 1), (3, 1)]
    # A batch that runs again replaces what it wrote.
    handle(spark.createDataFrame(batches[1], "user_id int, event_id int, ts string, result string").withColumn("ts", F.to_timestamp("ts")), 1)
    assert done() == want
    for _ in range(50):
        if len(heard.batches) == 3:
            break
        __import__("time").sleep(0.2)
    spark.streams.removeListener(heard)
    assert sum(b["rows"] for b in heard.batches.values()) == 7
