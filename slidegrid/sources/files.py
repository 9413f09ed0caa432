"""Readers and writers of the library's file formats; all of them Spark's own sources with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slidegrid.functions import boundaries as b

BOUNDARY_SCHEMA = "slide string, centroid_x decimal(10,1), centroid_y decimal(10,1), boundary string"
SLIDE_SCHEMA = "name string, x_size int, y_size int, pyramid_path string, scale int"
REGION_SCHEMA = "slide string, start_x int, start_y int, width int, height int"


def read_reports(spark: SparkSession, path: str, dims: int, offset: int = 5, double: Column | None = None) -> DataFrame:
    """Segmentation reports of all tiles below the path: object rows with a feature array and points.

    One header line, tabs between; `dims` features start at column `offset`, the boundary is the column after them.
    Coordinates are doubled where `double` holds (by default at scan magnitude 40; a variant without magnitudes passes
    a true literal). Objects with a NaN or missing feature are left to rejected().
    """
    names = ["slide", "x", "y", *(["scan_mag", "analysis_mag"] if offset == 5 else []), *[f"f{i}" for i in range(dims)], "boundary"]
    raw = spark.read.option("sep", "\t").option("header", True).option("recursiveFileLookup", True).schema(", ".join(f"{n} string" for n in names)).csv(path)
    factor = F.when(double if double is not None else F.expr("try_cast(scan_mag AS DOUBLE) = 40"), 2.0).otherwise(1.0)
    return raw.select(
        F.substring_index("slide", ".", 1).alias("slide"), F.expr("try_cast(x AS DOUBLE)").alias("x_raw"), F.expr("try_cast(y AS DOUBLE)").alias("y_raw"), factor.alias("factor"),
        F.array(*[F.expr(f"try_cast(f{i} AS FLOAT)") for i in range(dims)]).alias("features"), b.parsed(F.col("boundary"), ";").alias("points"),
    ).select("slide", (F.col("x_raw") * F.col("factor")).alias("x_centroid"), (F.col("y_raw") * F.col("factor")).alias("y_centroid"), "features", b.scaled(F.col("points"), F.col("factor")).alias("points"))


def valid(features: Column) -> Column:
    """Whether no feature is missing or NaN."""
    return ~F.exists(features, lambda v: v.isNull() | F.isnan(v))


def accepted(reports: DataFrame) -> DataFrame:
    return reports.where(valid(F.col("features")))


def rejected(reports: DataFrame) -> DataFrame:
    """How many objects of each slide are left out."""
    return reports.groupBy("slide").agg(F.count_if(~valid(F.col("features"))).alias("n_rejected"))


def write_reports(objects: DataFrame, path: str, dims: int) -> None:
    """One report for each partition, in folders by slide."""
    features = [F.element_at("features", i + 1).cast("string").alias(f"f{i}") for i in range(dims)]
    one = lambda c: F.col(c).cast("decimal(12,1)").cast("string")
    rows = objects.select(
        F.col("slide").alias("part"), "slide", one("x_centroid").alias("x"), one("y_centroid").alias("y"), F.lit("20").alias("scan_mag"), F.lit("20").alias("analysis_mag"), *features,
        F.concat(b.written(F.col("points"), ";"), F.lit(";")).alias("boundary"),
    )
    rows.write.partitionBy("part").option("sep", "\t").option("header", True).mode("overwrite").csv(path)


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Boundaries by their key (slide, centroid); repeated keys are kept once."""
    return spark.read.option("sep", "\t").schema(BOUNDARY_SCHEMA).csv(path).dropDuplicates(["slide", "centroid_x", "centroid_y"])


def write_boundaries(rows: DataFrame, path: str) -> None:
    rows.select("slide", "centroid_x", "centroid_y", "boundary").write.option("sep", "\t").mode("overwrite").csv(path)


def read_slides(spark: SparkSession, path: str) -> DataFrame:
    """Slide descriptions."""
    return spark.read.schema(SLIDE_SCHEMA).csv(path)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """F24's regions: rows without exactly five numbers are dropped."""
    return spark.read.schema(REGION_SCHEMA).option("mode", "DROPMALFORMED").csv(path).dropna("any")


def read_slide_list(spark: SparkSession, path: str) -> DataFrame:
    """Name: the first field of each line of a slide file."""
    return spark.read.schema("name string").option("enforceSchema", True).csv(path).where("name IS NOT NULL")


def with_kinds(rows: DataFrame, file_col: str) -> DataFrame:
    """Rows with the kind of dataset that a file's name tells: spfeatures are regions, pofeatures cells, others nuclei."""
    name = F.col(file_col)
    return rows.withColumn("kind", F.when(name.contains("spfeatures"), "region").when(name.contains("pofeatures"), "cell").otherwise("nuclei"))


def read_survival(spark: SparkSession, path: str) -> DataFrame:
    """A survival table with a header: time, event, group if there is one, and covariates as text; blanks and carriage returns are no part of names."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.toDF(*[c.replace("\r", "").strip() for c in rows.columns])
    return rows.withColumns({"time": F.col("time").try_cast("double"), "event": F.col("event").try_cast("int")})


def append_log(rows: DataFrame, path: str) -> None:
    """Append log rows (remote_addr, type, message, ts and others); rows without a message are left out, an address that is missing is UNKNOWN."""
    address = F.when(F.coalesce("remote_addr", F.lit("")) == "", "UNKNOWN").otherwise(F.col("remote_addr"))
    rows.where("message IS NOT NULL AND message <> ''").withColumn("remote_addr", address).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, more: str = "") -> DataFrame:
    """A log; more: columns besides remote_addr, type, message and ts."""
    return spark.read.schema(", ".join(x for x in ("remote_addr string, type string, message string, ts timestamp", more) if x)).parquet(path)


def write_dataset(objects: DataFrame, path: str) -> None:
    """An object dataset or training set, in folders by slide, ordered by centroid for box filters.

    Ranges of slide and centroid go to a file each, so a slide with many objects is written by several tasks.
    """
    objects.repartitionByRange("slide", "x_centroid", "y_centroid").sortWithinPartitions("slide", "x_centroid", "y_centroid").write.partitionBy("slide").mode("overwrite").parquet(path)


def read_dataset(spark: SparkSession, path: str, dims: int | None = None) -> DataFrame:
    """An object dataset; with dims, rows of another number of features are an error."""
    rows = spark.read.parquet(path)
    if dims is None:
        return rows
    return rows.withColumn("features", F.when(F.size("features") == dims, F.col("features")).otherwise(F.raise_error(F.lit(f"a row has not {dims} features"))))


def write_report(table: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    table.coalesce(1).write.option("header", True).mode("overwrite").csv(path)


def provenance(spark: SparkSession, version: str) -> DataFrame:
    """Who saved a dataset, with what, and when."""
    return spark.range(1).select(
        F.lit(spark.sparkContext.applicationId).alias("application"), F.lit(version).alias("version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("created")
    )
