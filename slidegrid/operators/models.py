"""Classifiers of objects: training, scores, normalisation, active-learning rounds. Spark ML does the work."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import LinearSVC, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slidegrid.operators import counts, sampling
from slidegrid.sources import published
from slidegrid.sources.shared import checkpointed


class Sampler(Protocol):
    """What chooses objects to label next."""

    def __call__(self, scored: DataFrame, n: int, seed: int) -> DataFrame: ...


def uncertain(scored: DataFrame, n: int, seed: int) -> DataFrame:
    return sampling.most_uncertain(scored, n)


def at_random(scored: DataFrame, n: int, seed: int) -> DataFrame:
    return sampling.random_objects(scored, n, seed)


def by_bins(scored: DataFrame, n: int, seed: int) -> DataFrame:
    """At most one object for each score bin, n in all."""
    return sampling.one_of_each_bin(scored, seed).orderBy("score_bin").limit(n).select("object_id", "score")


#: Samplers by name.
SAMPLERS: dict[str, Sampler] = {"uncertain": uncertain, "random": at_random, "bins": by_bins}


def moments(vectors: DataFrame) -> DataFrame:
    """One row: arrays of each dimension's mean and deviation."""
    each = vectors.select(F.posexplode("features").alias("dim", "v")).groupBy("dim").agg(F.avg("v").alias("m"), F.stddev("v").alias("s"))
    return each.agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m", "s"))), lambda x: F.struct(x["m"].alias("m"), x["s"].alias("s"))).alias("norm"))


def normalized(vectors: DataFrame, norm: DataFrame) -> DataFrame:
    """features minus the mean, by the deviation; 0 where that is 0. norm is one row, whatever the data's size."""
    joined = vectors.crossJoin(F.broadcast(norm))
    return joined.withColumn("features", F.zip_with("features", "norm", lambda v, n: F.when(n["s"] > 0, (v - n["m"]) / n["s"]).otherwise(0.0))).drop("norm")


def renormalized(vectors: DataFrame, own: DataFrame, other: DataFrame) -> DataFrame:
    """vectors normalized by `own` figures as if by those of another dataset."""
    joined = vectors.crossJoin(F.broadcast(own)).crossJoin(F.broadcast(other.withColumnRenamed("norm", "norm2")))
    raw = F.zip_with("features", "norm", lambda v, n: v * n["s"] + n["m"])
    return joined.withColumn("features", F.zip_with(raw, "norm2", lambda v, n: F.when(n["s"] > 0, (v - n["m"]) / n["s"]).otherwise(0.0))).drop("norm", "norm2")


def prepared(samples: DataFrame) -> DataFrame:
    """Samples with label -1 or 1 as Spark ML takes them."""
    return samples.where("label <> 0").select("*", array_to_vector(F.col("features").cast("array<double>")).alias("vector"), F.when(F.col("label") == 1, 1.0).otherwise(0.0).alias("target"))


def forest(samples: DataFrame, dims: int, seed: int = 1, trees: int = 100, depth: int = 10) -> Model:
    """L1: a binary random forest with the square root of the number of features at each split."""
    return RandomForestClassifier(
        featuresCol="vector", labelCol="target", numTrees=trees, maxDepth=depth, minInstancesPerNode=1, featureSubsetStrategy=str(max(1, math.isqrt(dims))), seed=seed
    ).fit(prepared(samples))


def scored(model: Model, objects: DataFrame, keep: list[str]) -> DataFrame:
    """Score 2 p - 1 of each object and its class; rows never leave their partitions."""
    rows = objects.select(*keep, array_to_vector(F.col("features").cast("array<double>")).alias("vector"))
    p = vector_to_array("probability")[1]
    return model.transform(rows).select(*keep, (2 * p - 1).alias("score"), F.when(2 * p - 1 < 0, -1).otherwise(1).alias("predicted"))


def stored(spark: SparkSession, root: str, training_set: str, iteration: int, make: Callable[[], Model]) -> str:
    """The folder of the classifier of a training set at an iteration. It is trained by `make` once, and read ever after."""
    return published.kept(spark, root, f"{training_set} at iteration {iteration}", lambda place: make().write().save(place))


def applied(place: str, objects: DataFrame, slide: str, left: float, right: float, top: float, bottom: float, keep: list[str]) -> DataFrame:
    """Score and class of the objects of a viewport by a stored forest. Slide and bounds come first, so they reach the scan; only what is left is scored."""
    seen = objects.where((F.col("slide") == slide) & F.col("x_centroid").between(left, right) & F.col("y_centroid").between(top, bottom))
    return scored(RandomForestClassificationModel.load(place), seen, keep)


def leaf_votes(spark: SparkSession, place: str) -> DataFrame:
    """L3: tree, leaf, vote of a stored forest: the class that most training samples of the leaf have. Leaves are numbered as transform() numbers them.

    At most trees * 2 ** depth rows.
    """
    nodes = spark.read.parquet(f"{place}/data").select(F.col("treeID").alias("tree"), "nodeData.*").where("leftChild < 0")
    leaf = F.row_number().over(Window.partitionBy("tree").orderBy("id")) - 1
    return nodes.select("tree", leaf.alias("leaf"), F.col("prediction").cast("int").alias("vote"))


def voted(spark: SparkSession, place: str, objects: DataFrame, keep: list[str]) -> DataFrame:
    """L2, L3: score 2 p - 1 of each object and its class, where p is the share of a stored forest's trees that vote for the positive class.

    The leaf table, bounded by the forest's size, goes to every task as one array for each tree; votes are looked up where the objects are.
    """
    model = RandomForestClassificationModel.load(place).setLeafCol("leaves")
    trees = leaf_votes(spark, place).groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("leaf", "vote"))).alias("leaves"))
    table = trees.agg(F.transform(F.sort_array(F.collect_list(F.struct("tree", F.transform("leaves", lambda x: x["vote"]).alias("votes")))), lambda x: x["votes"]).alias("table"))
    rows = objects.select(*keep, array_to_vector(F.col("features").cast("array<double>")).alias("vector"))
    leaves = model.transform(rows).select(*keep, vector_to_array("leaves").alias("leaves")).crossJoin(F.broadcast(table))
    votes = F.aggregate(F.zip_with("leaves", "table", lambda leaf, votes: F.get(votes, leaf.cast("int"))), F.lit(0), lambda a, x: a + x)
    score = 2 * votes / F.size("table") - 1
    return leaves.select(*keep, score.alias("score"), F.when(score < 0, -1).otherwise(1).alias("predicted"))


def waves(features: Column, dims: int, n: int = 128, gamma: float | None = None, seed: int = 1) -> Column:
    """Random Fourier features of a radial kernel: cosines of random projections."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0, math.sqrt(2 * (gamma or 1 / dims)), (n, dims))
    shift = rng.uniform(0, 2 * math.pi, n)
    one = lambda row, s: F.cos(F.aggregate(F.zip_with(features, F.array(*[F.lit(float(x)) for x in row]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) + float(s))
    return F.array(*[one(row, s) * math.sqrt(2 / n) for row, s in zip(w, shift, strict=True)])


def svm(samples: DataFrame, dims: int, n: int = 128) -> tuple[Model, int]:
    """L4: an approximate radial SVM: a linear one over random Fourier features."""
    rows = prepared(samples).withColumn("vector", array_to_vector(waves(F.col("features").cast("array<double>"), dims, n)))
    return LinearSVC(featuresCol="vector", labelCol="target", regParam=0.001, maxIter=100, tol=1e-3).fit(rows), n


def margins(model: Model, n: int, objects: DataFrame, dims: int, keep: list[str]) -> DataFrame:
    """Margin and class of each object."""
    rows = objects.select(*keep, array_to_vector(waves(F.col("features").cast("array<double>"), dims, n)).alias("vector"))
    m = vector_to_array("rawPrediction")[1]
    return model.transform(rows).select(*keep, m.alias("score"), F.when(m < 0, -1).otherwise(1).alias("predicted"))


def active_round(objects: DataFrame, samples: DataFrame, dims: int, n: int = 8, seed: int = 1, sampler: Sampler = uncertain, trees: int = 100) -> DataFrame:
    """Train on the samples, score all other objects, and choose the next n to label."""
    model = forest(samples, dims, seed, trees)
    rest = objects.join(samples.select("object_id"), "object_id", "left_anti")
    return sampler(scored(model, rest, ["object_id"]), n, seed)


def resolved(objects: DataFrame, submitted: DataFrame) -> DataFrame:
    """The submitted labels (object_id, label) of objects that exist, with their features; other rows and labels are left out, of several labels the largest counts."""
    valid = submitted.where("label IN (-1, 0, 1)").groupBy("object_id").agg(F.max("label").alias("label"))
    return objects.select("object_id", "features").join(valid, "object_id")


def active_rounds(
    objects: DataFrame, samples: DataFrame, answers: Callable[[DataFrame, int], DataFrame], dims: int, rounds: int = 5, n: int = 8, seed: int = 1, sampler: Sampler = uncertain, trees: int = 100
) -> tuple[DataFrame, DataFrame]:
    """Iteration, object_id, score of what each round chose, and all samples after the last round, with their iterations.

    A round trains on the samples so far, scores the objects that are left, and chooses n; `answers` gives the labels of
    what was chosen (object_id, label), which are resolved to objects and join the samples; objects that were chosen and stay without a valid
    label are not chosen again. Samples and choices are written to the shared folder after each round, so the plan of the
    last round is that of the first. Objects are read in each round and never rewritten.
    """
    samples = checkpointed(samples.select("object_id", "features", "label", F.lit(0).alias("iteration")))
    chosen = checkpointed(samples.where("false").select(F.lit(0).alias("iteration"), "object_id", F.lit(0.0).alias("score")))
    for k in range(1, rounds + 1):
        model = forest(samples, dims, seed + k, trees)
        rest = objects.join(samples.select("object_id").union(chosen.select("object_id")), "object_id", "left_anti")
        batch = checkpointed(sampler(scored(model, rest, ["object_id"]), n, seed + k))
        new = resolved(objects, answers(batch, k).join(batch.select("object_id"), "object_id", "left_semi"))
        samples = checkpointed(samples.unionByName(new.withColumn("iteration", F.lit(k))))
        chosen = checkpointed(chosen.unionByName(batch.select(F.lit(k).alias("iteration"), "object_id", "score")))
    return chosen, samples


def next_batch(pending: DataFrame, fresh: DataFrame, submitted: DataFrame) -> DataFrame:
    """K9: uid, iteration, object_id, resent: what each session gets next.

    pending: uid, iteration, object_id of batches sent before. submitted: uid, iteration of sessions now; while a session's iteration is that of its
    pending batch, it gets the same batch again, else the fresh one (uid, object_id).
    """
    sent = pending.select("uid", "iteration").distinct().withColumn("resent", F.lit(True))
    now = submitted.join(sent, ["uid", "iteration"], "left").withColumn("resent", F.coalesce("resent", F.lit(False)))
    again = now.where("resent").join(pending, ["uid", "iteration"]).select("uid", "iteration", "object_id", "resent")
    return again.unionByName(now.where("NOT resent").join(fresh, "uid").select("uid", "iteration", "object_id", "resent"))


def roc_report(samples: DataFrame) -> DataFrame:
    """Kind, object_id, value: the labels' rows, the probabilities' rows, and a row for each rate (of object 0). samples: object_id, label, score."""
    known = samples.where("label <> 0")
    rows = known.select("object_id", F.explode(F.create_map(F.lit("label"), F.col("label").cast("double"), F.lit("probability"), (F.col("score") + 1) / 2)).alias("kind", "value"))
    rates = counts.rates(counts.confusion(known, F.col("label"), counts.predicted_label(F.col("score"))))
    each = F.explode(F.create_map(*[x for c in rates.columns for x in (F.lit(c), F.col(c))])).alias("kind", "value")
    return rows.select("kind", "object_id", "value").unionByName(rates.select(each).select("kind", F.lit(0).cast("bigint").alias("object_id"), "value"))


def folds(samples: DataFrame, n: int = 5, seed: int = 1) -> DataFrame:
    """A fold for each sample: its place in a random order, modulo n; so sizes differ by one at most."""
    return sampling.ranked_at_random(samples, seed).select("object_id", (F.col("rank") % n).cast("int").alias("fold"))
