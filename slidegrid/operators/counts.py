"""Counts, rates and moments of objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def predicted_label(score: Column) -> Column:
    """Class of a score in [-1, 1]; below zero is negative, null stays null."""
    return F.when(score.isNull(), None).when(score < 0, -1).otherwise(1)


def slide_counts(objects: DataFrame, slides: DataFrame, label: Column) -> DataFrame:
    """A1: positive and negative objects of every slide; slides without objects have zeros.

    The slides, few, are joined after the aggregation has shrunk the objects.
    """
    counted = objects.groupBy("slide").agg(F.count_if(label == 1).alias("n_positive"), F.count_if(label != 1).alias("n_negative"))
    return slides.select(F.col("name").alias("slide")).join(counted, "slide", "left").na.fill(0)


def confusion(objects: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """A2: true and false positives and negatives, and totals of either class."""
    def n(t: int, p: int) -> Column:
        return F.count_if((truth == t) & (predicted == p))

    return objects.agg(
        n(1, 1).alias("tp"), n(-1, 1).alias("fp"), n(-1, -1).alias("tn"), n(1, -1).alias("fn"),
        F.count_if(truth == 1).alias("p"), F.count_if(truth == -1).alias("n"),
    )


def rates(table: DataFrame) -> DataFrame:
    """A3: rates of a confusion table; null where a denominator is zero."""
    return table.selectExpr(
        "try_divide(fp, n) AS fp_rate", "try_divide(tp, p) AS tp_rate", "try_divide(tp, tp + fp) AS precision", "try_divide(tp + tn, p + n) AS accuracy"
    )


def accuracy(objects: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """A4: share of rows whose prediction is the label."""
    return objects.agg(F.avg((truth == predicted).cast("double")).alias("accuracy"))


def class_counts(samples: DataFrame) -> DataFrame:
    """A5: samples of each class and the number of iterations that gave them."""
    return samples.groupBy("label").agg(F.count("*").alias("n_samples"), F.count_distinct("iteration").alias("n_iterations"))


def review_summary(samples: DataFrame) -> DataFrame:
    """Distinct slides, samples, and samples of each class."""
    return samples.agg(
        F.count_distinct("slide").alias("n_slides"), F.count("*").alias("n_total"),
        F.count_if(F.col("label") == 1).alias("n_positive"), F.count_if(F.col("label") == -1).alias("n_negative"),
    )


def review_groups(samples: DataFrame) -> DataFrame:
    """Slides in case-insensitive order with their samples' number and smallest and largest id.

    A slide's samples are not gathered in one row, as a slide can hold any number of them; its rows follow by a join.
    """
    return (
        samples.groupBy("slide").agg(F.count("*").alias("n"), F.min("object_id").alias("first_id"), F.max("object_id").alias("last_id"))
        .orderBy(F.upper("slide"), "slide")
    )


def slide_offsets(objects: DataFrame) -> DataFrame:
    """Where each slide's objects start when all are ordered by slide, and how many there are.

    The running total goes over one row a slide, not over the objects.
    """
    counted = objects.groupBy("slide").agg(F.count("*").alias("n_objects"))
    before = Window.orderBy("slide").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("slide", F.coalesce(F.sum("n_objects").over(before), F.lit(0)).alias("first_index"), "n_objects")


def feature_moments(vectors: DataFrame, column: str = "features") -> DataFrame:
    """A10: mean and sample standard deviation of each dimension."""
    return vectors.select(F.posexplode(column).alias("dim", "v")).groupBy("dim").agg(
        F.avg(F.col("v").cast("double")).alias("mean"), F.stddev(F.col("v").cast("double")).alias("std_dev")
    )


def class_priors(samples: DataFrame) -> DataFrame:
    """Share of each label among all rows."""
    counted = samples.groupBy("label").agg(F.count("*").alias("n"))
    return counted.crossJoin(counted.agg(F.sum("n").alias("total"))).select("label", (F.col("n") / F.col("total")).alias("prior"))


def vocabulary(objects: DataFrame) -> DataFrame:
    """The slides in use, renumbered from 0 in ascending order."""
    return objects.select("slide").distinct().select("slide", (F.dense_rank().over(Window.orderBy("slide")) - 1).alias("slide_index"))


def slide_weights(samples: DataFrame) -> DataFrame:
    """Samples of each slide and its share of all samples."""
    counted = samples.groupBy("slide").agg(F.count("*").alias("n"))
    return counted.crossJoin(counted.agg(F.sum("n").alias("total"))).select("slide", "n", (F.col("n") / F.col("total")).alias("weight"))


def binary_columns(table: DataFrame, columns: list[str]) -> DataFrame:
    """Which columns have exactly two distinct values."""
    wide = table.agg(*[F.count_distinct(c).alias(c) for c in columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), (F.col(c) == 2).alias("is_binary")) for c in columns])).alias("x")).select("x.*")
