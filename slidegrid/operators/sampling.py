"""Choice of objects to label. Random choice is by a hash of id and seed, so a repeated run chooses alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(seed: int) -> Column:
    """What orders ids at random, the same in any SQL engine: a digest of seed and id. Other seeds give orders that have nothing in common."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("object_id").cast("string")).cast("binary"))


def share_end(percent: float) -> str:
    """Of random digests this share is smaller."""
    return f"{int(percent / 100 * (1 << 48)):012x}" if percent < 100 else "g"


def most_uncertain(objects: DataFrame, n: int, score: str = "score") -> DataFrame:
    """K1, K2: the n objects with the least absolute score; ties go to smaller ids. Only n rows of a partition move."""
    return objects.orderBy(F.abs(F.col(score)), "object_id").limit(n).select("object_id", F.col(score).alias("score"))


def most_uncertain_or_any(objects: DataFrame, n: int, seed: int, score: str = "score_tied") -> DataFrame:
    """K3: if all chosen scores are equal, choose at random among all objects with that score.

    Ordering by absolute score and then at random does both.
    """
    return objects.orderBy(F.abs(F.col(score)), shuffled(seed), "object_id").limit(n).select("object_id", F.col(score).alias("score"))


def weighted_uncertain(objects: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """K4: least absolute score plus the share of samples that its slide already has."""
    sum_ = F.abs("score") + F.coalesce("weight", F.lit(0.0))
    joined = objects.join(F.broadcast(weights), "slide", "left").withColumn("rank_by", F.round(sum_, 9))
    return joined.orderBy("rank_by", "object_id").limit(n).select("object_id", "rank_by")


def uncertain_of_share(objects: DataFrame, n: int, percent: int, seed: int) -> DataFrame:
    """K5: most uncertain of a random share of the objects, chosen by the hash order."""
    return most_uncertain(objects.where(shuffled(seed) < share_end(percent)), n)


#: Upper ends of the score bins.
BIN_ENDS = (-0.5, -0.25, 0.0, 0.1, 0.25, 0.3, 0.5, 1.0)


def score_bin(score: Column) -> Column:
    out = F.when(score <= BIN_ENDS[0], 0)
    for i, end in enumerate(BIN_ENDS[1:], 1):
        out = out.when(score <= end, i)
    return out


def one_of_each_bin(objects: DataFrame, seed: int) -> DataFrame:
    """K6: one random object for each score bin; an empty bin takes from the next one that has objects (after the last, the first).

    The k-th bin that asks the same bin gets its k-th object, so none is given twice.
    """
    n = len(BIN_ENDS)
    w = Window.partitionBy("bin").orderBy("h", "object_id")
    ranked = objects.withColumns({"bin": score_bin(F.col("score")), "h": shuffled(seed)}).withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    held = ranked.select("bin").distinct()
    asking = objects.sparkSession.range(n).select(F.col("id").cast("int").alias("asks"))
    donors = asking.crossJoin(held).groupBy("asks").agg(F.min(F.struct(((F.col("bin") - F.col("asks") + n) % n).alias("away"), "bin")).alias("d"))
    turn = Window.partitionBy("d.bin").orderBy("d.away", "asks")
    wanted = donors.select("asks", F.col("d.bin").alias("bin"), F.row_number().over(turn).alias("k"))
    return wanted.join(ranked, ["bin", "k"]).select(F.col("asks").alias("score_bin"), "object_id", "score")


def random_objects(objects: DataFrame, n: int, seed: int) -> DataFrame:
    """K7: n random objects without replacement."""
    return objects.orderBy(shuffled(seed), "object_id").limit(n).select("object_id")


def ranked_at_random(objects: DataFrame, seed: int, deal: int = 10_000) -> DataFrame:
    """object_id, rank: every object's place, from 0, in a random order of all of them; equal ids stand together.

    Digests fall into ranges of about `deal` objects, whose counts give each range's first place; so no task orders more than a range.
    """
    n = objects.count()
    digits = 1
    while 16**digits * deal < n:
        digits += 1
    dealt = objects.select("object_id", shuffled(seed).alias("h")).withColumn("part", F.substring("h", 1, digits))
    before = F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = dealt.groupBy("part").agg(F.count("*").alias("c")).select("part", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("h", "object_id")) - 1
    return dealt.join(parts, "part").select("object_id", (F.col("before") + own).alias("rank"))


def strata(objects: DataFrame, n_strata: int, n_group: int) -> DataFrame:
    """Of each predicted class, n_strata groups of n_group objects at evenly spread ranks of the score.

    Groups start at ranks 0, i * n / (n_strata - 1), ..., n - n_group - 1. Scores are counted first: the running counts of a
    class's distinct scores tell which scores hold the wanted ranks, and only objects of those scores are
    ranked among themselves, so no task sorts a class.
    """
    side = objects.withColumn("class", F.when(F.col("score") < 0, -1).otherwise(1))
    bucket = F.floor((F.col("score") + 1) * 1000).cast("int")
    by_score = side.groupBy("class", bucket.alias("part"), "score").agg(F.count("*").alias("c"))
    parts = running(by_score.groupBy("class", "part").agg(F.sum("c").alias("c")), ["class"], "part")
    within = running(by_score, ["class", "part"], "score").withColumnRenamed("before", "inner").drop("n")
    counted = within.join(F.broadcast(parts.select("class", "part", "before", "n")), ["class", "part"]).select("class", "score", "c", (F.col("before") + F.col("inner")).alias("before"), "n")
    i = F.explode(F.expr(f"sequence(0, {n_strata - 1})"))
    start = F.when(F.col("i") == n_strata - 1, F.greatest(F.col("n") - n_group - 1, F.lit(0))).otherwise(F.floor(F.col("i") * F.col("n") / (n_strata - 1)))
    starts = parts.groupBy("class").agg(F.max("n").alias("n")).select("class", "n", i.alias("i")).select("class", start.alias("start"), F.col("i").alias("stratum"))
    places = F.broadcast(starts.select("class", "stratum", F.explode(F.expr(f"sequence(CAST(start AS BIGINT), CAST(start AS BIGINT) + {n_group - 1})")).alias("rank")))
    held = counted.join(places, "class").where("rank >= before AND rank < before + c")
    wanted = held.groupBy("class", "score").agg(F.first("before").alias("before"), (F.max("rank") - F.first("before") + 1).alias("deep"))
    # of a score's objects only the first ones are wanted: each part of the ids keeps so many before they meet
    tied = side.join(F.broadcast(wanted), ["class", "score"]).withColumn("some", F.pmod(F.xxhash64("object_id"), F.lit(256)))
    first = tied.withColumn("r", F.row_number().over(Window.partitionBy("class", "score", "some").orderBy("object_id"))).where("r <= deep")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("class", "score").orderBy("object_id")) - 1 + F.col("before"))
    return ranked.join(places, ["class", "rank"]).select("class", "stratum", "rank", "object_id", "score")


def running(counted: DataFrame, group: list[str], order: str) -> DataFrame:
    """counted with `before`, the sum of `c` of the group's rows before each, and `n`, that of all its rows."""
    up = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("*", F.coalesce(F.sum("c").over(up), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy(*group)).alias("n"))
