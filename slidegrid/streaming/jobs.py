"""Streaming jobs: sessions, label intake, log counts, incremental import. Each works on a streaming or a batch DataFrame alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SUBMISSION = "struct<command:string,uid:string,iteration:int,samples:array<struct<id:string,label:string,centX:string,centY:string,slide:string,clickX:string,clickY:string>>>"


def sessions(requests: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each uid; a longer pause than the gap ends one."""
    marked = requests.withWatermark("ts", late) if requests.isStreaming else requests
    grouped = marked.groupBy("uid", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_requests"), F.max("ts").alias("last_seen"))
    return grouped.select("uid", F.col("w.start").alias("started"), "last_seen", "n_requests")


def log_counts(requests: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Requests of each command in tumbling or sliding windows."""
    marked = requests.withWatermark("ts", late) if requests.isStreaming else requests
    grouped = marked.groupBy(F.window("ts", width, slide or width).alias("w"), "command").agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("started"), "command", "n")


def submissions(lines: DataFrame) -> DataFrame:
    """Rows of label submissions from JSON text; numbers may come as text; bad lines give no rows."""
    parsed = lines.select(F.from_json("value", SUBMISSION).alias("m")).where("m.command IN ('submit', 'save') AND m.samples IS NOT NULL")
    one = parsed.select("m.uid", "m.iteration", F.explode("m.samples").alias("s"))
    return one.select(
        "uid", "iteration", F.col("s.id").try_cast("bigint").alias("object_id"), F.col("s.label").try_cast("int").alias("label"), "s.slide",
        F.col("s.centX").try_cast("double").alias("x"), F.col("s.centY").try_cast("double").alias("y"),
    )


def accepted(rows: DataFrame) -> DataFrame:
    """Valid labels only."""
    return rows.where("object_id IS NOT NULL AND label IN (-1, 0, 1)")


def latest(rows: DataFrame) -> DataFrame:
    """The latest label of each object."""
    return rows.groupBy("object_id").agg(F.max_by("label", "iteration").alias("label"), F.max("iteration").alias("iteration"))


def take_labels(lines: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's latest labels as a version of its own; a batch that runs again replaces its version. current_labels() reads them."""
    def keep(batch: DataFrame, number: int) -> None:
        latest(accepted(submissions(batch))).write.mode("overwrite").parquet(f"{table}/v={number}")

    return lines.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_labels(spark: SparkSession, table: str) -> DataFrame:
    """The latest label of each object over all versions; later batches count more where iterations are equal."""
    rows = spark.read.option("basePath", table).parquet(table)
    return rows.groupBy("object_id").agg(F.max_by("label", F.struct("iteration", "v")).alias("label"), F.max("iteration").alias("iteration"))


def compact_labels(spark: SparkSession, table: str, new: str) -> None:
    """The current labels as the only version of a new table, for readers to turn to from time to time."""
    current_labels(spark, table).write.mode("overwrite").parquet(f"{new}/v=0")


def import_new(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """T4: append the rows of files that were not seen before; the checkpoint remembers files."""
    rows = spark.readStream.option("sep", "\t").schema(schema).csv(source)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_logs(requests: DataFrame, days: int = 7) -> DataFrame:
    """T5: requests of the last days by day, counted from the latest day that there is."""
    dated = requests.withColumn("day", F.to_date("ts"))
    newest = dated.agg(F.max("day").alias("newest"))
    return dated.crossJoin(F.broadcast(newest)).where(F.datediff("newest", "day") < days).drop("newest")
