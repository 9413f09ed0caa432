"""The catalog: datasets with their slides and sets, sets with their classes, what goes with samples, and sessions that save or leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidegrid.operators import spatial


def enriched(samples: DataFrame, slides: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Samples with size, scale and path of their slide, and their boundary if there is one. Samples of unknown slides are left out."""
    known = samples.join(slides.withColumnRenamed("name", "slide"), "slide")
    return known.join(boundaries.select("slide", "object_id", "boundary"), ["slide", "object_id"], "left")


def slides_of(dataset: str, datasets: DataFrame, dataset_slides: DataFrame, slides: DataFrame) -> DataFrame:
    """The slides of the dataset of this name, by name; one that is linked twice comes twice."""
    linked = dataset_slides.join(datasets.where(F.col("name") == dataset).select("dataset_id"), "dataset_id").select(F.col("slide").alias("name"))
    return slides.join(linked, "name").orderBy("name")


def sets_with_datasets(sets: DataFrame, datasets: DataFrame) -> DataFrame:
    """Training or test sets with the name of their dataset."""
    return sets.join(datasets.select("dataset_id", F.col("name").alias("dataset")), "dataset_id")


def class_name(label: Column) -> Column:
    return F.when(label == 1, "positive").otherwise("negative")


def classes_of_sets(objs: DataFrame) -> DataFrame:
    """set_id, label, class of each set's classes, by label."""
    return objs.select("set_id", "label").distinct().withColumn("class", class_name(F.col("label"))).orderBy("label")


def boundaries_of(wanted: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Boundaries of a list of (slide, object_id); what is listed twice comes once."""
    return boundaries.join(wanted.select("slide", "object_id").distinct(), ["slide", "object_id"], "left_semi")


def new_only(rows: DataFrame, known: DataFrame, name: str, known_name: str) -> DataFrame:
    """Rows whose name is not among the known ones; a row without a name is new."""
    return rows.join(known.select(F.col(known_name).alias(name)).distinct(), name, "left_anti")


def reloaded(samples: DataFrame, slides: DataFrame, objects: DataFrame) -> DataFrame:
    """Slide, n, iteration: how many samples of a stored set are objects of the dataset, by slide, and the iteration to go on from (fixes count as well)."""
    there = samples.join(slides.select(F.col("name").alias("slide")).distinct(), "slide", "left_semi").join(objects.select("object_id").distinct(), "object_id", "left_semi")
    return there.groupBy("slide").agg(F.count("*").alias("n"), F.max(F.abs("iteration")).alias("iteration"))


def mask_objects(boundaries: DataFrame, views: DataFrame, margin: float) -> DataFrame:
    """view_id and boundary of the objects in or near each view: views are enlarged by the margin on all sides."""
    wide = views.select("view_id", "slide", *[(F.col(c) + by).alias(c) for c, by in (("l", -margin), ("r", margin), ("t", -margin), ("b", margin))])
    return spatial.in_views(boundaries, wide)


def saved(sets: DataFrame, new: DataFrame) -> DataFrame:
    """The sets and new ones, of which those whose name is in use are left out."""
    return sets.unionByName(new_only(new, sets, "name", "name"))


def picked(samples: DataFrame, objects: DataFrame) -> DataFrame:
    """object_id, label, x_click, y_click of picked samples of objects that exist; the click is the centroid where it is not known."""
    click = lambda name, place: F.coalesce(name, place).alias(name) if name in samples.columns else F.col(place).alias(name)
    there = samples.join(objects.select("object_id").distinct(), "object_id", "left_semi")
    return there.select("object_id", "label", click("x_click", "x_centroid"), click("y_click", "y_centroid"))


def without_sessions(rows: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Rows of the sessions that were not cancelled; rows of no session stay."""
    return rows.join(cancelled.select("uid").distinct(), "uid", "left_anti")


def slides_with_boundaries(boundaries: DataFrame) -> DataFrame:
    """A29."""
    return boundaries.select("slide").distinct()
