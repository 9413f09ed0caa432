"""Label intake with dead letters, and daily logs that go after some days."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slidegrid.streaming.jobs import SUBMISSION

JUDGED = "uid string, iteration int, object_id bigint, label int, ts timestamp, value string, reason string, fate string, v int"


def parsed(lines: DataFrame) -> DataFrame:
    """value, ts, uid, iteration, object_id, label, reason: a row for each label of each line, and one for a line without any.

    reason is `malformed` for lines that are no submission, and for labels without an object's number or that are not -1, 0 or 1.
    """
    m = lines.select("value", "ts", F.from_json("value", SUBMISSION).alias("m"))
    good = F.coalesce(F.col("m.command").isin("submit", "save") & (F.size("m.samples") > 0), F.lit(False))
    one = m.select("value", "ts", "m.uid", "m.iteration", good.alias("good"), F.explode_outer(F.when(good, F.col("m.samples"))).alias("s"))
    one = one.select("value", "ts", "uid", "iteration", F.col("s.id").try_cast("bigint").alias("object_id"), F.col("s.label").try_cast("int").alias("label"), "good")
    fits = F.col("good") & F.col("object_id").isNotNull() & F.coalesce(F.col("label").isin(-1, 0, 1), F.lit(False))
    return one.withColumn("reason", F.when(~fits, "malformed")).drop("good")


def judged(rows: DataFrame, objects: DataFrame, taken: DataFrame, mark: DataFrame, delay_s: int) -> DataFrame:
    """Parsed rows with the reason why a label is not taken, which is null for those that are.

    `malformed`; `late`: more than delay_s before the latest time (mark: one row, `at`) of the batches before; `unknown`: not among the
    objects; `duplicate`: the same user, iteration, object and label as one that was taken (taken: those of the last delay_s are enough), or
    that comes before it in these rows.
    """
    key = ["uid", "iteration", "object_id", "label"]
    timed = rows.crossJoin(F.broadcast(mark))
    reason = F.coalesce("reason", F.when(F.col("ts").isNull(), "malformed"), F.when(F.unix_seconds("ts") < F.unix_seconds("at") - delay_s, "late"))
    timed = timed.withColumn("reason", reason).drop("at")
    open_, done = timed.where("reason IS NULL"), timed.where("reason IS NOT NULL")
    known = objects.select("object_id").join(open_.select("object_id").distinct(), "object_id", "left_semi").distinct().withColumn("known", F.lit(True))
    open_ = open_.join(known, "object_id", "left").withColumn("reason", F.when(F.col("known").isNull(), "unknown")).drop("known")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"t.{k}")) for k in key]
    before = taken.select(*key).distinct().withColumn("again", F.lit(True)).alias("t")
    open_ = open_.alias("o").join(before, same, "left").select("o.*", "again")
    first = F.row_number().over(Window.partitionBy(*key, "reason").orderBy("ts", "value")) == 1
    open_ = open_.withColumn("reason", F.coalesce("reason", F.when(F.col("again") | ~first, "duplicate"))).drop("again")
    return open_.unionByName(done).withColumn("fate", F.when(F.col("reason").isNull(), "taken").otherwise("dead"))


def _kept(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(JUDGED).option("basePath", f"{root}/labels").parquet(f"{root}/labels")
    except AnalysisException:  # before the first batch
        return spark.createDataFrame([], JUDGED)


def take(lines: DataFrame, objects: DataFrame, root: str, checkpoint: str, delay_s: int = 3600) -> StreamingQuery:
    """A stream of lines (value, ts) of label submissions, judged against a table of objects: every label is taken, or kept as a dead letter with its reason.

    A batch is one version of the table in root; one that runs again replaces its own. The marks of the batches before
    say what is late, their labels of the last delay_s what is a duplicate; both are read from the table, so a stream that starts again goes on
    as it was.
    """
    spark = lines.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        past = _kept(spark, root).where(F.col("v") < number)
        mark = past.agg(F.max("ts").alias("at"))
        recent = past.where("fate = 'taken'").crossJoin(F.broadcast(mark)).where(F.col("at").isNull() | (F.unix_seconds("ts") >= F.unix_seconds("at") - delay_s)).drop("at")
        found = judged(parsed(batch), objects, recent, mark, delay_s)
        found.write.mode("overwrite").partitionBy("fate").parquet(f"{root}/labels/v={number}")

    return lines.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def taken(spark: SparkSession, root: str) -> DataFrame:
    """The labels that were taken."""
    return _kept(spark, root).where("fate = 'taken'").drop("fate", "reason")


def dead_letters(spark: SparkSession, root: str) -> DataFrame:
    """What was not taken, and why."""
    return _kept(spark, root).where("fate = 'dead'").drop("fate")


def current(spark: SparkSession, root: str) -> DataFrame:
    """The latest label that was taken of each object."""
    return taken(spark, root).groupBy("object_id").agg(F.max_by("label", F.struct("iteration", "ts", "v")).alias("label"), F.max("iteration").alias("iteration"))


def _days(spark: SparkSession, path: str) -> dict[str, object]:
    """The daily folders there are, by day."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return {}
    return {f.getPath().getName().removeprefix("day="): f.getPath() for f in files.listStatus(place) if f.getPath().getName().startswith("day=")}


def expire(spark: SparkSession, path: str, days: int = 7) -> list[str]:
    """T5: delete the daily folders that are `days` or more before the newest one; gives the days that went. Other folders are not touched."""
    held = _days(spark, path)
    if not held:
        return []
    oldest = spark.range(1).select(F.date_sub(F.to_date(F.lit(max(held))), days - 1).cast("string")).first()[0]
    gone = sorted(d for d in held if d < oldest)
    for d in gone:
        held[d].getFileSystem(spark._jsc.hadoopConfiguration()).delete(held[d], True)
    return gone


def keep_logs(requests: DataFrame, path: str, checkpoint: str, days: int = 7) -> StreamingQuery:
    """T5: a stream of log rows with ts, kept in a folder for each day, of the last `days` days.

    A batch writes a folder of its own in each of its days, and replaces only those when it runs again. Then days
    that are too old are deleted as folders; rows that come for such a day are left out.
    """
    spark = requests.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        dated = batch.where("ts IS NOT NULL").withColumns({"day": F.to_date("ts"), "batch": F.lit(number)})
        newest = F.greatest(F.max("day"), F.lit(max(_days(spark, path), default=None)).cast("date"))
        kept = dated.crossJoin(F.broadcast(dated.agg(newest.alias("newest")))).where(F.datediff("newest", "day") < days).drop("newest")
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
        expire(spark, path, days)

    return requests.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
