"""Views of the given tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OBJECT = """
  CAST(l_orderkey AS BIGINT) * 8 + l_linenumber AS object_id,
  concat('S', lpad(CAST(s % 20 AS {text}), 2, '0')) AS slide,
  ((CAST(p AS BIGINT) * 37) % 20000) / CAST(10 AS DOUBLE) AS x_centroid,
  ((CAST(l_orderkey AS BIGINT) * 53) % 16000) / CAST(10 AS DOUBLE) AS y_centroid,
  (CAST(round(price * 100) AS BIGINT) % 2001 - 1000) / CAST(1000 AS DOUBLE) AS score,
  round(disc * 20 - 1, 2) AS score_tied,
  CASE WHEN flag = 'R' THEN 1 ELSE -1 END AS label,
  flag, CAST(round(disc * 100) AS INTEGER) AS iteration"""
_GROUPED = """SELECT l_orderkey, l_linenumber, min(l_suppkey) AS s, max(l_partkey) AS p, max(l_extendedprice) AS price,
  max(l_discount) AS disc, max(l_returnflag) AS flag FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmented objects: one for each order line, on 20 slides."""
    grouped = (
        table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.min("l_suppkey").alias("s"), F.max("l_partkey").alias("p"), F.max("l_extendedprice").alias("price"),
            F.max("l_discount").alias("disc"), F.max("l_returnflag").alias("flag"),
        )
    )
    return grouped.selectExpr(*select_list(_OBJECT.format(text="STRING")))


def select_list(columns: str) -> list[str]:
    """Column expressions of a select list."""
    out, depth, start = [], 0, 0
    for i, x in enumerate(columns):
        depth += (x == "(") - (x == ")")
        if x == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled objects: returned or accepted lines; 0 (ignore) where the discount is 10 %."""
    return objects(spark, sf_dir).where("flag <> 'N'").selectExpr(
        "object_id", "slide", "x_centroid", "y_centroid", "score", "iteration", "CASE WHEN iteration = 10 THEN 0 ELSE label END AS label"
    )


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*select_list(_CLICK.format(text="STRING")))


def viewports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(*select_list(_VIEWPORT.format(text="STRING")))


_CLICK = """CAST(s_suppkey AS BIGINT) AS click_id, concat('S', lpad(CAST(s_suppkey % 20 AS {text}), 2, '0')) AS slide,
  CAST(CAST(s_suppkey AS BIGINT) * 7 % 2000 AS DOUBLE) AS x, CAST(CAST(s_suppkey AS BIGINT) * 13 % 1600 AS DOUBLE) AS y"""
_VIEWPORT = """CAST(n_nationkey AS BIGINT) AS view_id, concat('S', lpad(CAST(n_nationkey % 20 AS {text}), 2, '0')) AS slide,
  CAST(n_nationkey * 67 % 1600 AS DOUBLE) AS l, CAST(n_nationkey * 31 % 1300 AS DOUBLE) AS t,
  CAST(n_nationkey * 67 % 1600 + 400 AS DOUBLE) AS r, CAST(n_nationkey * 31 % 1300 + 300 AS DOUBLE) AS b"""


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slides that the suppliers' keys name."""
    return (
        table(spark, sf_dir, "supplier")
        .selectExpr("s_suppkey % 20 AS n")
        .distinct()
        .selectExpr(
            "concat('S', lpad(CAST(n AS STRING), 2, '0')) AS name",
            "2000 AS x_size",
            "1600 AS y_size",
            "CAST(1 + n % 2 AS INT) AS scale",
            "concat('/p/S', lpad(CAST(n AS STRING), 2, '0')) AS pyramid_path",
        )
    )


_SURVIVAL = """CAST(o_orderkey AS BIGINT) AS subject, CAST(floor({days} / 10) AS DOUBLE) AS time, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS event,
  o_orderpriority AS "group", o_totalprice AS price, CAST(o_custkey % 2 AS INTEGER) AS odd"""


def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with a time in tens of days, an event flag, a group and two covariates: one for each order."""
    days = "abs(datediff(CAST(o_orderdate AS DATE), DATE'1995-01-01'))"
    return table(spark, sf_dir, "orders").selectExpr(*select_list(_SURVIVAL.format(days=days).replace('"group"', "`group`")))


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polygon of four to eight vertices around each object, as text `x,y x,y ...`, on the object's slide."""
    n = "(4 + object_id % 5)"
    point = f"concat(CAST(CAST(round(x_centroid) + 10 * ((i * 7 + object_id) % 5) AS INT) AS STRING), ',', CAST(CAST(round(y_centroid) + 10 * ((i * 3 + object_id) % 4) AS INT) AS STRING))"
    return objects(spark, sf_dir).selectExpr("object_id", "slide", "x_centroid", "y_centroid", f"array_join(transform(sequence(0, CAST({n} AS INT) - 1), i -> {point}), ' ') AS boundary")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of users: uid, command, time (UTC)."""
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id AS uid", "event_type AS command", "CAST(ts AS TIMESTAMP) AS ts")


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").selectExpr("CAST(r_regionkey AS BIGINT) AS dataset_id", "r_name AS name")


def dataset_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("CAST(n_regionkey AS BIGINT) AS dataset_id", "concat('S', lpad(CAST(n_nationkey % 20 AS STRING), 2, '0')) AS slide")


def training_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS set_id", "c_name AS name", "CAST(c_nationkey % 5 AS BIGINT) AS dataset_id")


def training_objs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("CAST(o_custkey AS BIGINT) AS set_id", "CAST(o_orderkey AS BIGINT) AS object_id", "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS label")


_PIXEL = """tile_id, x, y, CAST((x * x * 3 + y * y * 5 + x * y + tile_id * 3) % 256 AS INTEGER) AS r, CAST((x * 5 + y * 11 + tile_id * 7) % 256 AS INTEGER) AS g,
  CAST((x * 3 + y * 17 + tile_id) % 256 AS INTEGER) AS b,
  CASE WHEN x % 8 < 5 + (y % 3) AND y % 8 < 6 THEN CAST(floor(x / 8) + 4 * floor(y / 8) + 1 AS INTEGER) ELSE 0 END AS label"""


#: Tiles that are made in one task.
TILES = 512


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile of 32 x 32 pixels with 16 objects for each supplier.

    The suppliers' file is small, so it is dealt by tile before it grows a thousandfold: groups, windows and joins of tiles find them in place.
    """
    tiles = table(spark, sf_dir, "supplier").selectExpr("CAST(s_suppkey AS BIGINT) AS tile_id")
    n = tiles.count()
    tiles = tiles.repartition(max(1, -(-n // TILES), min(n, spark.sparkContext.defaultParallelism)), "tile_id")
    grid = tiles.selectExpr("tile_id", "explode(sequence(0, 31)) AS x").selectExpr("tile_id", "x", "explode(sequence(0, 31)) AS y")
    return grid.selectExpr(*select_list(_PIXEL))


#: The same views as common table expressions for the comparison engine.
CTES = {
    "objects": f"objects AS (SELECT {_OBJECT.format(text='VARCHAR')} FROM ({_GROUPED.format(lineitem='lineitem')}))",
    "samples": """samples AS (SELECT object_id, slide, x_centroid, y_centroid, score, iteration,
        CASE WHEN iteration = 10 THEN 0 ELSE label END AS label FROM objects WHERE flag <> 'N')""",
    "clicks": f"clicks AS (SELECT {_CLICK.format(text='VARCHAR')} FROM supplier)",
    "viewports": f"viewports AS (SELECT {_VIEWPORT.format(text='VARCHAR')} FROM nation)",
    "slides": """slides AS (
  SELECT 'S' || lpad(CAST(n AS VARCHAR), 2, '0') AS name, 2000 AS x_size, 1600 AS y_size,
    CAST(1 + n % 2 AS INTEGER) AS scale, '/p/S' || lpad(CAST(n AS VARCHAR), 2, '0') AS pyramid_path
  FROM (SELECT DISTINCT s_suppkey % 20 AS n FROM supplier))""",
}
CTES |= {
    "pixels": f"pixels AS (SELECT {_PIXEL} FROM (SELECT CAST(s_suppkey AS BIGINT) AS tile_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM supplier, range(32) a(x), range(32) b(y)))",
    "survival": f"""survival AS (SELECT {_SURVIVAL.format(days="abs(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)))")} FROM orders)""",
    "boundaries": """boundaries AS (SELECT object_id, slide, x_centroid, y_centroid, array_to_string(list_transform(range(0, 4 + object_id % 5), lambda i:
      concat(CAST(CAST(round(x_centroid) + 10 * ((i * 7 + object_id) % 5) AS INTEGER) AS VARCHAR), ',', CAST(CAST(round(y_centroid) + 10 * ((i * 3 + object_id) % 4) AS INTEGER) AS VARCHAR))), ' ') AS boundary FROM objects)""",
    "requests": "requests AS (SELECT event_id, user_id AS uid, event_type AS command, CAST(ts AS TIMESTAMP) AS ts FROM events)",
    "datasets": "datasets AS (SELECT CAST(r_regionkey AS BIGINT) AS dataset_id, r_name AS name FROM region)",
    "dataset_slides": "dataset_slides AS (SELECT CAST(n_regionkey AS BIGINT) AS dataset_id, concat('S', lpad(CAST(n_nationkey % 20 AS VARCHAR), 2, '0')) AS slide FROM nation)",
    "training_sets": "training_sets AS (SELECT CAST(c_custkey AS BIGINT) AS set_id, c_name AS name, CAST(c_nationkey % 5 AS BIGINT) AS dataset_id FROM customer)",
    "training_objs": "training_objs AS (SELECT CAST(o_custkey AS BIGINT) AS set_id, CAST(o_orderkey AS BIGINT) AS object_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS label FROM orders)",
}
_ORDER = ("objects", "samples", "clicks", "viewports", "slides", "survival", "boundaries", "requests", "datasets", "dataset_slides", "training_sets", "training_objs", "pixels")


def sql(body: str, *views: str) -> str:
    """SQL over the views (and those that they are made of)."""
    wanted = set(views) | ({"objects"} if {"samples", "boundaries"} & set(views) else set())
    return "WITH " + ", ".join(CTES[v] for v in _ORDER if v in wanted) + " " + body if wanted else body
