"""Queries that write a format in the shared folder and read it back, and streams over such files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidegrid import fixtures as fx
from slidegrid.fixtures import sql
from slidegrid.functions import boundaries as b
from slidegrid.operators import counts
from slidegrid.plans.model_queries import vectors
from slidegrid.plans.registry import query, rounded, shared
from slidegrid.plans.table_queries import POINTS, TEXT
from slidegrid.sources import files, layout
from slidegrid.streaming import jobs

DIMS = 3


def _reported(s: SparkSession, d: str) -> DataFrame:
    """Objects with three features and points, as reports hold them."""
    return fx.boundaries(s, d).join(fx.objects(s, d).select("object_id", "score", "iteration"), "object_id").select(
        "slide", "x_centroid", "y_centroid", F.array(F.col("score").cast("float"), F.col("iteration").cast("float"), F.lit(1.0).cast("float")).alias("features"), b.parsed(F.col("boundary")).alias("points"))


def _reread(s: SparkSession, d: str) -> DataFrame:
    path = shared(s, "reports")
    files.write_reports(_reported(s, d), path, DIMS)
    return files.read_reports(s, path, DIMS)


REPORTS = f"SELECT slide, x_centroid, y_centroid, {TEXT.format('p', ';')} AS boundary, round(score, 4) AS f0, count(*) AS n FROM (SELECT b.slide, b.x_centroid, b.y_centroid, {POINTS} AS p, o.score FROM boundaries b JOIN objects o USING (object_id)) GROUP BY ALL"


def _counted(df: DataFrame, factor: float = 1.0) -> DataFrame:
    rows = df.select("slide", (F.col("x_centroid") / factor).alias("x_centroid"), (F.col("y_centroid") / factor).alias("y_centroid"), b.written(b.scaled(F.col("points"), F.lit(1 / factor)), ";").alias("boundary"), F.round(F.col("features")[0].cast("double"), 4).alias("f0"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


query("s1_report_source", sql(REPORTS, "objects", "boundaries"))(lambda s, d: _counted(_reread(s, d)))
query("s2_report_sink", sql("SELECT slide, count(*) AS n FROM boundaries GROUP BY slide", "boundaries"))(lambda s, d: _reread(s, d).groupBy("slide").agg(F.count("*").alias("n")))


def _doubled(s: SparkSession, d: str) -> DataFrame:
    path = shared(s, "reports3")
    files.write_reports(_reported(s, d), path, DIMS)
    return files.read_reports(s, path, DIMS, double=F.lit(True))


query("s3_report_variant", sql(REPORTS, "objects", "boundaries"))(lambda s, d: _counted(_doubled(s, d), 2.0))
query("s11_concatenated_boundaries", sql(f"SELECT slide, {TEXT.format('p', ' ')} AS boundary, count(*) AS n FROM (SELECT slide, {POINTS} AS p FROM boundaries) GROUP BY ALL", "boundaries"))(
    lambda s, d: _reread(s, d).select("slide", b.written(F.col("points")).alias("boundary")).groupBy("slide", "boundary").agg(F.count("*").alias("n")))


def _boundary_file(s: SparkSession, d: str) -> DataFrame:
    path = shared(s, "boundaries")
    rows = fx.boundaries(s, d).selectExpr("slide", "CAST(x_centroid AS DECIMAL(10,1)) AS centroid_x", "CAST(y_centroid AS DECIMAL(10,1)) AS centroid_y", "boundary")
    files.write_boundaries(rows, path)
    return files.read_boundaries(s, path)


query("s4_boundary_source", sql("SELECT slide, CAST(x_centroid AS DECIMAL(10,1)) AS centroid_x, CAST(y_centroid AS DECIMAL(10,1)) AS centroid_y, 1 AS n FROM boundaries GROUP BY 1, 2, 3", "boundaries"))(
    lambda s, d: _boundary_file(s, d).select("slide", "centroid_x", "centroid_y", F.lit(1).alias("n")))


def _slide_file(s: SparkSession, d: str) -> DataFrame:
    path = shared(s, "slides")
    fx.slides(s, d).select("name", "x_size", "y_size", "pyramid_path", "scale").write.csv(path)
    return files.read_slides(s, path)


query("s5_slide_source", sql("SELECT name, x_size, y_size, pyramid_path, scale FROM slides", "slides"))(_slide_file)


def _dataset(s: SparkSession, d: str) -> DataFrame:
    path = shared(s, "dataset")
    files.write_dataset(vectors(s, d).select("object_id", "slide", F.lit(0.0).alias("x_centroid"), F.lit(0.0).alias("y_centroid"), "features"), path)
    return files.read_dataset(s, path, 64)


query("s7_dataset", """SELECT CAST(vec_id AS BIGINT) AS object_id, 'S0' || CAST(vec_id % 5 AS VARCHAR) AS slide, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings""")(
    lambda s, d: rounded(_dataset(s, d).select("object_id", "slide", F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("total")), 4))


def _keyed(s: SparkSession, d: str) -> str:
    """The folder of the objects along the curve, with two features each."""
    path = shared(s, "keyed")
    layout.write_dataset(fx.objects(s, d).select("object_id", "slide", "x_centroid", "y_centroid", F.array("score", "score_tied").alias("features")), path)
    return path


query("p8_keyed_viewport", sql("SELECT object_id, x_centroid, y_centroid FROM objects WHERE slide = 'S03' AND x_centroid BETWEEN 400 AND 1200 AND y_centroid BETWEEN 300 AND 900", "objects"))(
    lambda s, d: layout.viewport(s, _keyed(s, d), "S03", 400, 1200, 300, 900).select("object_id", "x_centroid", "y_centroid"))
query("s7_slide_header", sql("""SELECT slide, CAST(row_number() OVER (ORDER BY slide) - 1 AS INTEGER) AS slide_index, CAST(coalesce(sum(n) OVER (ORDER BY slide ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_index, n AS n_objects
    FROM (SELECT slide, count(*) AS n FROM objects GROUP BY slide)""", "objects"))(lambda s, d: layout.read_slides(s, _keyed(s, d)).select("slide", "slide_index", "first_index", "n_objects"))  # fmt: skip
query("s7_feature_header", sql("""SELECT CAST(dim AS INTEGER) AS dim, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std_dev FROM (SELECT unnest([0, 1]) AS dim, unnest([score, score_tied]) AS v FROM objects) GROUP BY dim""", "objects"))(
    lambda s, d: rounded(layout.read_features(s, _keyed(s, d)).select("dim", "mean", "std_dev")))


def _csv_report(s: SparkSession, d: str) -> DataFrame:
    path = shared(s, "report")
    files.write_report(counts.slide_counts(fx.objects(s, d), fx.slides(s, d), counts.predicted_label(F.col("score"))), path)
    return s.read.option("header", True).schema("slide string, n_positive bigint, n_negative bigint").csv(path)


query("s13_report_sink", sql("""SELECT s.name AS slide, count(o.object_id) FILTER (o.score >= 0) AS n_positive, count(o.object_id) FILTER (o.score < 0) AS n_negative
    FROM slides s LEFT JOIN objects o ON o.slide = s.name GROUP BY s.name""", "objects", "slides"))(_csv_report)  # fmt: skip


def _training_set(s: SparkSession, d: str) -> DataFrame:
    path = shared(s, "training")
    files.write_dataset(fx.samples(s, d), path)
    return files.read_dataset(s, path).select("object_id", "slide", "label")


query("s15_training_set_export", sql("SELECT object_id, slide, label FROM samples", "samples"))(_training_set)


def _imported(s: SparkSession, d: str) -> DataFrame:
    """T4: two runs over a growing folder; the second one reads the new files only."""
    source, out, seen = (shared(s, x) for x in ("tiles", "imported", "seen"))
    rows = fx.samples(s, d).select("object_id", "slide", "label")
    for part in ("label = 1", "label <> 1"):
        rows.where(part).write.mode("append").option("sep", "\t").csv(source)
        jobs.import_new(s, source, "object_id bigint, slide string, label int", out, seen).awaitTermination()
    return s.read.schema("object_id bigint, slide string, label int").parquet(out)


query("t4_incremental_import", sql("SELECT object_id, slide, label FROM samples", "samples"))(_imported)


def _resampled(s: SparkSession, d: str) -> DataFrame:
    points = b.resampled(b.parsed(F.col("boundary")), 8)
    rows = fx.boundaries(s, d).select("object_id", F.posexplode(points).alias("k", "p"))
    return rounded(rows.select("object_id", F.col("k").cast("bigint").alias("k"), "p.x", "p.y"))


query("f6_resample", sql(f"""SELECT object_id, k, round(CASE WHEN total = 0 THEN ax[1] WHEN j >= n THEN ax[n] ELSE ax[j] + (ax[j + 1] - ax[j]) * (k * total / 8 - way[j]) / (way[j + 1] - way[j]) END, 6) AS x,
    round(CASE WHEN total = 0 THEN ay[1] WHEN j >= n THEN ay[n] ELSE ay[j] + (ay[j + 1] - ay[j]) * (k * total / 8 - way[j]) / (way[j + 1] - way[j]) END, 6) AS y FROM (
    SELECT *, len(list_filter(way, lambda w: w <= k * total / 8)) AS j FROM (SELECT *, list_transform(range(0, n), lambda i: coalesce(list_sum(sides[1:i]), 0)) AS way, list_sum(sides) AS total FROM (
    SELECT object_id, list_transform(p, lambda v: v.x) AS ax, list_transform(p, lambda v: v.y) AS ay, len(p) AS n,
      list_transform(range(1, len(p)), lambda i: sqrt(pow(p[i + 1].x - p[i].x, 2) + pow(p[i + 1].y - p[i].y, 2))) AS sides FROM (SELECT object_id, {POINTS} AS p FROM boundaries))), range(9) t(k))""", "boundaries"))(_resampled)  # fmt: skip
query("f26_timestamps", sql("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS written FROM requests", "requests"))(
    lambda s, d: fx.requests(s, d).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("written")))
