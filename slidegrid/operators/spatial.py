"""Viewports, lookups by centroid, nearest objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_view(objects: DataFrame, slide: str, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """Objects of a slide in a box, borders included. Plain comparisons reach the Parquet scan."""
    return objects.where((F.col("slide") == slide) & F.col("x_centroid").between(left, right) & F.col("y_centroid").between(top, bottom))


def in_views(objects: DataFrame, views: DataFrame, side: float = 512.0) -> DataFrame:
    """P8 for a table of viewports: both are keyed by grid cells of this side, and the box is a further condition.

    A view goes to the cells that it touches, an object to its own, so a slide's objects are dealt to many tasks.
    """
    cell = lambda v: F.floor(v / side).cast("bigint")
    cells = views.withColumn("_x", F.explode(F.sequence(cell(F.col("l")), cell(F.col("r"))))).withColumn("_y", F.explode(F.sequence(cell(F.col("t")), cell(F.col("b")))))
    held = objects.withColumns({"_x": cell(F.col("x_centroid")), "_y": cell(F.col("y_centroid"))})
    box = F.col("x_centroid").between(F.col("l"), F.col("r")) & F.col("y_centroid").between(F.col("t"), F.col("b"))
    return held.join(cells, ["slide", "_x", "_y"]).where(box).drop("_x", "_y")


def expanded(views: DataFrame) -> DataFrame:
    """Viewports enlarged by their width and height on every side; the lower bounds are not below zero."""
    return views.selectExpr("view_id", "slide", "greatest(l - (r - l), 0D) AS l", "greatest(t - (b - t), 0D) AS t", "r + (r - l) AS r", "b + (b - t) AS b")


def to_fetch(views: DataFrame) -> DataFrame:
    """Whether each view has to be fetched again: above zoom 0.5, and its centre outside the box fetched last.

    views: view_id, l, t, r, b, zoom, and last_l, last_t, last_r, last_b, which are null before the first fetch.
    """
    x, y = (F.col("l") + F.col("r")) / 2, (F.col("t") + F.col("b")) / 2
    inside = x.between(F.col("last_l"), F.col("last_r")) & y.between(F.col("last_t"), F.col("last_b"))
    return views.select("view_id", ((F.col("zoom") > 0.5) & ~F.coalesce(inside, F.lit(False))).alias("fetch"))


def centroid_key(x: Column, y: Column) -> Column:
    """Centroid with one decimal as text; decimals, as these round alike everywhere."""
    return F.concat_ws("_", x.cast("decimal(10,1)").cast("string"), y.cast("decimal(10,1)").cast("string"))


def class_code(label: Column) -> Column:
    """0 for the negative class, else 1."""
    return F.when(label == -1, 0).otherwise(1)


def colour(code: Column) -> Column:
    """Colour of a class code; none for objects without one."""
    return F.when(code == 0, "lightgrey").when(code == 1, "lime").otherwise("aqua")


def lookup(requests: DataFrame, objects: DataFrame, how: str = "inner") -> DataFrame:
    """Objects by slide and centroid of one decimal; of objects with one key the smallest id.

    how: inner for what was found, left_anti for what was not.
    """
    def key(df: DataFrame, x: str, y: str) -> DataFrame:
        return df.withColumns({"kx": F.col(x).cast("decimal(10,1)"), "ky": F.col(y).cast("decimal(10,1)")})

    first = key(objects, "x_centroid", "y_centroid").groupBy("slide", "kx", "ky").agg(F.min("object_id").alias("object_id"), F.count("*").alias("n_same_key"))
    return key(requests, "x", "y").join(first, ["slide", "kx", "ky"], how).drop("kx", "ky")


def nearest(clicks: DataFrame, objects: DataFrame, reach: float, first: float | None = None) -> DataFrame:
    """For each click the nearest object in a box of `reach` around it; distances count to six places, and ties go to the smaller id.

    Objects are keyed by a grid of cells as wide as the reach and clicks by the nine cells around theirs, so the box
    condition becomes an equi-join and a hot cell can be split as any skewed key. With `first`, this smaller box is asked
    before: a click with an object closer than that is settled, as what is outside is farther, and only the others ask the wide box.
    """
    if first is not None and first < reach:
        near = _nearest(clicks, objects, first)
        settled = near.where(F.col("m.d2") < first * first).select("click_id")
        found = near.unionByName(_nearest(clicks.join(settled, "click_id", "left_anti"), objects, reach)).groupBy("click_id").agg(F.min("m").alias("m"))
    else:
        found = _nearest(clicks, objects, reach)
    return found.select("click_id", "m.object_id", F.col("m.d2").alias("distance2"))


def _nearest(clicks: DataFrame, objects: DataFrame, reach: float) -> DataFrame:
    """click_id, m: rounded squared distance and id of the nearest object in the box."""
    cell = lambda x: F.floor(x / reach).cast("bigint")
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    asked = clicks.withColumn("c", near).withColumns({"cx": cell(F.col("x")) + F.col("c.i"), "cy": cell(F.col("y")) + F.col("c.j")}).drop("c")
    held = objects.select("slide", "object_id", "x_centroid", "y_centroid", cell(F.col("x_centroid")).alias("cx"), cell(F.col("y_centroid")).alias("cy"))
    dx, dy = F.col("x_centroid") - F.col("x"), F.col("y_centroid") - F.col("y")
    met = asked.join(held, ["slide", "cx", "cy"]).where((F.abs(dx) <= reach) & (F.abs(dy) <= reach))
    return met.groupBy("click_id").agg(F.min(F.struct(F.round(dx * dx + dy * dy, 6).alias("d2"), "object_id")).alias("m"))


def coloured(objects: DataFrame, predictions: DataFrame) -> DataFrame:
    """Objects with the colour of their predicted class; aqua without one. predictions: slide, key, code."""
    keyed = objects.withColumn("key", centroid_key(F.col("x_centroid"), F.col("y_centroid")))
    return keyed.join(predictions, ["slide", "key"], "left").select("object_id", "slide", "key", colour(F.col("code")).alias("colour"))


def overridden(objects: DataFrame, clicks: DataFrame) -> DataFrame:
    """Labels of objects with edits on top; an object clicked an even number of times keeps its own label."""
    edits = clicks.groupBy("object_id").agg((F.count("*") % 2).alias("odd"))
    flipped = F.when(F.col("odd") == 1, -F.col("label")).otherwise(F.col("label"))
    return objects.join(edits, "object_id", "left").select("object_id", flipped.alias("label"))


def tile_grid(slides: DataFrame, size: int) -> DataFrame:
    """F16: upper left corners of the tiles that cover each slide."""
    xs = F.explode(F.expr(f"sequence(0, x_size - 1, {size})"))
    ys = F.explode(F.expr(f"sequence(0, y_size - 1, {size})"))
    return slides.select("name", "y_size", xs.alias("x")).select("name", "x", ys.alias("y"))


def thumbnails(samples: DataFrame, slides: DataFrame, half: int) -> DataFrame:
    """A window around each centroid, in shares of its slide's size, scaled with the slide."""
    side = F.col("scale") * half
    joined = samples.join(F.broadcast(slides), F.col("slide") == F.col("name"))
    return joined.select(
        "object_id",
        ((F.col("x_centroid") - side) / F.col("x_size")).alias("left"), ((F.col("y_centroid") - side) / F.col("y_size")).alias("top"),
        (2 * side / F.col("x_size")).alias("width"), (2 * side / F.col("y_size")).alias("height"),
    )


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
