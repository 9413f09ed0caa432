"""Streaming twins of batch queries."""

import json

from pyspark.sql import functions as F

from slidegrid import fixtures as fx
from slidegrid.streaming import intake, jobs, sessions

SF = "/root/testdata/sf0.001"


def test_closed_sessions_are_the_batchs(spark, tmp_path):
    requests = fx.requests(spark, SF)
    requests.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(requests.schema).parquet(f"{tmp_path}/in")
    q = jobs.sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.uid, r.started, r.n_requests) for r in spark.table("sessions").collect()}
    want = {(r.uid, r.started, r.n_requests) for r in jobs.sessions(requests).collect()}
    assert got <= want and len(got) > 0.8 * len(want)


def test_label_intake_keeps_the_latest(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    message = lambda it, *labels: json.dumps({"command": "submit", "uid": "u", "iteration": it, "samples": [{"id": str(i), "label": v, "centX": "1.5", "centY": 2, "slide": "s"} for i, v in labels]})
    for k, text in enumerate([message(1, (1, 1), (2, -1)), "not json", message(2, (1, -1), (3, 7))]):
        (source / f"{k}.txt").write_text(text + "\n")
        jobs.take_labels(spark.readStream.text(str(source)), f"{tmp_path}/table", f"{tmp_path}/seen").awaitTermination()
    jobs.compact_labels(spark, f"{tmp_path}/table", f"{tmp_path}/compact")
    for table in ("table", "compact"):
        rows = jobs.current_labels(spark, f"{tmp_path}/{table}").collect()
        assert {(r.object_id, r.label, r.iteration) for r in rows} == {(1, -1, 2), (2, -1, 1)}


def test_log_counts_in_sliding_windows(spark):
    rows = jobs.log_counts(fx.requests(spark, SF), "1 hour", "30 minutes").agg(F.sum("n")).first()[0]
    assert rows == 2 * fx.requests(spark, SF).count()


def in_files(rows, path, n):
    """The rows in n files by time, as they come in."""
    cuts = rows.selectExpr("min(ts) AS a", "max(ts) AS b").first()
    step = (cuts.b - cuts.a) / n
    for k in range(n):
        last = F.lit(True) if k == n - 1 else F.col("ts") < cuts.a + step * (k + 1)
        rows.where((F.col("ts") >= cuts.a + step * k) & last).coalesce(1).write.mode("append").parquet(path)


def test_sessions_with_state_are_the_tables(spark, tmp_path):
    """Closed by command, by timer, or open in the state: together, and each with its reason, what the table gives."""
    ends = {"purchase": "ended", "error": "cancelled"}
    requests = fx.requests(spark, SF)
    in_files(requests, f"{tmp_path}/in", 12)
    spark.conf.set(*sessions.STORE)
    try:
        stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        closed = sessions.closed_sessions(stream, gap_s=6 * 3600, late="1 hour", ends=ends)
        q = closed.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/seen").trigger(availableNow=True).start()
        q.awaitTermination()
        last = requests.agg(F.max("ts")).first()[0]
        still = sessions.open_sessions(spark, f"{tmp_path}/seen", last).collect()
    finally:
        spark.conf.unset(sessions.STORE[0])
    got = {(r.uid, r.started, r.last_seen, r.n_requests, r.reason) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.uid, r.started, r.last_seen, r.n_requests, r.reason) for r in sessions.sessions_of(requests, 6 * 3600, ends).collect()}
    # a session that has been idle for longer than the gap is open until the watermark, an hour behind, tells
    pending = {(r.uid, r.started, r.last_seen, r.n_requests) for r in still}
    assert got <= want and {x[:4] for x in want - got} == pending
    assert all(r.idle_s == int(last.timestamp()) - int(r.last_seen.timestamp()) for r in still)
    assert {x[4] for x in got} == {"ended", "cancelled", "idle"} and len(got) > 300 and 0 < len(pending) <= 15


def test_labels_are_taken_or_dead_letters(spark, tmp_path):
    """Every label that comes in is counted once, whatever batch it is in, and a batch that runs again changes nothing."""
    objects = spark.range(100).selectExpr("id AS object_id")
    line = lambda it, *labels, command="submit": json.dumps({"command": command, "uid": "u", "iteration": it, "samples": [{"id": str(i), "label": v} for i, v in labels]})
    batches = [
        [("10:00", line(1, (1, 1), (2, -1), (500, 1))), ("10:05", "not json"), ("10:06", line(1, (1, 1))), ("10:07", line(1, command="login"))],
        [("12:00", line(2, (1, -1), (3, 7), ("x", 1))), ("12:01", line(1, (2, -1))), ("12:02", line(1, (1, 1), (4, 0)))],
        [("10:30", line(3, (5, 1))), ("11:30", line(3, (6, 1), (6, 1), (6, -1))), ("12:03", line(2, (1, -1)))],
    ]
    (tmp_path / "in").mkdir()
    n_in = 0
    for k, rows in enumerate(batches):
        text = "".join(f"2024-01-01 {at}:00\t{value}\n" for at, value in rows)
        (tmp_path / "in" / f"{k}.txt").write_text(text)
        lines = spark.readStream.text(f"{tmp_path}/in").select(F.substring("value", 21, 10_000).alias("value"), F.substring("value", 1, 19).cast("timestamp").alias("ts"))
        intake.take(lines, objects, f"{tmp_path}/table", f"{tmp_path}/seen").awaitTermination()
        n_in += sum(max(1, len(json.loads(v)["samples"])) if v.startswith("{") else 1 for _, v in rows)
    dead = sorted((r.v, r.reason) for r in intake.dead_letters(spark, f"{tmp_path}/table").collect())
    taken = sorted((r.v, r.iteration, r.object_id, r.label) for r in intake.taken(spark, f"{tmp_path}/table").collect())
    assert len(dead) + len(taken) == n_in
    assert taken == [(0, 1, 1, 1), (0, 1, 2, -1), (1, 1, 4, 0), (1, 2, 1, -1), (2, 3, 6, -1), (2, 3, 6, 1)]
    assert dead == sorted([(0, "duplicate"), *[(0, "malformed")] * 2, (0, "unknown"), *[(1, "malformed")] * 2, *[(1, "duplicate")] * 2, *[(2, "duplicate")] * 2, (2, "late")])
    assert {(r.object_id, r.label) for r in intake.current(spark, f"{tmp_path}/table").collect()} >= {(1, -1), (2, -1), (4, 0)}


def test_daily_logs_go_after_seven_days(spark, tmp_path):
    """The eighth day deletes the first one's folder and no other; late rows of a day that went do not bring it back."""
    (tmp_path / "in").mkdir()
    schema = "ts timestamp, message string"
    days = [["01", "02"], ["03", "07"], ["08", "01"], ["04", "15"]]
    held = []
    path = f"{tmp_path}/logs"
    for k, some in enumerate(days):
        (tmp_path / "in" / f"{k}.csv").write_text("".join(f"2024-01-{d} 10:00:00,m{k}\n" for d in some))
        intake.keep_logs(spark.readStream.schema(schema).csv(f"{tmp_path}/in"), path, f"{tmp_path}/seen").awaitTermination()
        held.append(sorted(intake._days(spark, path)))
    day = lambda *x: [f"2024-01-{d}" for d in x]
    assert held == [day("01", "02"), day("01", "02", "03", "07"), day("02", "03", "07", "08"), day("15")]
    (tmp_path / "logs" / "other").mkdir()
    assert intake.expire(spark, path) == [] and (tmp_path / "logs" / "other").exists()
    assert [(r.message, r.batch) for r in spark.read.option("basePath", path).parquet(f"{path}/day=2024-01-15").collect()] == [("m3", 3)]
