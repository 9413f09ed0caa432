"""Upkeep of label tables: append, relabel, ignore, upsert, deduplicate, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def appended(samples: DataFrame, submitted: DataFrame, objects: DataFrame, iteration: int) -> DataFrame:
    """M1: samples with the submitted labels that belong to known objects; hand-picked fixes carry -iteration.

    submitted: object_id, label, picked. Unknown objects are left out, as a semi-join with the objects shows.
    """
    known = submitted.join(objects.select("object_id"), "object_id", "left_semi")
    new = known.select("object_id", "label", F.when(F.col("picked"), -iteration).otherwise(iteration).alias("iteration"))
    return samples.select("object_id", "label", "iteration").unionByName(new)


def in_training(samples: DataFrame) -> DataFrame:
    """M2: what is learnt from; ignored samples (label 0) stay in the table and can be reviewed."""
    return samples.where("label <> 0")


def relabelled(samples: DataFrame, edits: DataFrame) -> DataFrame:
    """M3, M4: samples with the latest edit of each id on top; changed tells which. A label other than 0 returns a sample to training.

    edits: object_id, label, seq.
    """
    latest = edits.groupBy("object_id").agg(F.max_by("label", "seq").alias("new"))
    return samples.join(latest, "object_id", "left").select("object_id", F.coalesce("new", "label").alias("label"), F.col("new").isNotNull().alias("changed"))


def without_duplicates(samples: DataFrame, key: list[str], order: str) -> DataFrame:
    """M5, M6: the first row of each key."""
    w = Window.partitionBy(*key).orderBy(order)
    return samples.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def priming_complete(samples: DataFrame, each: int = 4) -> DataFrame:
    """M7: how many samples each class has, and whether it has as many as priming asks for."""
    return samples.where("label <> 0").groupBy("label").agg(F.count("*").alias("n")).select("label", "n", (F.col("n") >= each).alias("complete"))


def upserted(table: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """M9: rows of both tables; where a key is in both, the new value counts."""
    fresh = new.select(key, F.col(value).alias("_new"))
    return table.join(fresh, key, "full_outer").select(key, F.coalesce("_new", value).alias(value))


def numbered(rows: DataFrame, key: str, above: DataFrame, id_col: str, parts: int = 200) -> DataFrame:
    """New rows with ids after the largest one in use, in the order of the key.

    Rows are dealt to about `parts` ranges of the key between its quantiles, so dense and sparse keys alike give ranges of about
    one size; each range's offset comes from the counts of those before it, which are at most `parts` numbers.
    """
    top = above.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top")).first()[0]
    cuts = sorted(set(rows.approxQuantile(key, [i / parts for i in range(1, parts)], 0.5 / parts)))
    # the bucket of a key: how many cuts are not above it
    cut = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x <= F.col(key))) if cuts else F.lit(0)
    ranged = rows.withColumn("_part", cut)
    counts = {r["_part"]: r["c"] for r in ranged.groupBy("_part").agg(F.count("*").alias("c")).collect()}
    before, total = {}, top
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    offsets = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.lit(None)
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return ranged.withColumn(id_col, (offsets[F.col("_part")] if before else F.lit(0)) + own).drop("_part")


def created(existing: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """Wanted rows whose name is not in use."""
    return wanted.join(existing.select(name), name, "left_anti")


def safe_names(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Wanted (name, uid and others), where a name that exists already gets the last three characters of the uid."""
    taken = existing.select("name").distinct().withColumn("_taken", F.lit(True))
    new = F.when(F.col("_taken"), F.concat_ws("_", "name", F.substring("uid", -3, 3))).otherwise(F.col("name"))
    return wanted.join(taken, "name", "left").withColumn("name", new).drop("_taken")


def session_status(requests: DataFrame, timeout: int, ending: str = "logout") -> DataFrame:
    """Uid, last_seen, idle_seconds of each open session, and how many there are (n_open).

    A session is open if its last command does not end it and it has been idle for no more than the timeout.
    """
    last = requests.groupBy("uid").agg(F.max("ts").alias("last_seen"), F.max_by("command", "ts").alias("command"))
    now = requests.agg(F.max("ts").alias("now"))
    idle = last.crossJoin(F.broadcast(now)).withColumn("idle_seconds", F.unix_seconds("now") - F.unix_seconds("last_seen"))
    open_ = idle.where((F.col("command") != ending) & (F.col("idle_seconds") <= timeout)).select("uid", "last_seen", "idle_seconds")
    return open_.crossJoin(F.broadcast(open_.agg(F.count("*").alias("n_open"))))


def cascaded(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the keys that go."""
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def replaced(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table with all rows of the new keys replaced by the new rows."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def marked(objects: DataFrame, samples: DataFrame) -> DataFrame:
    """Objects with a flag for those already selected."""
    chosen = samples.select("object_id").distinct().withColumn("_in", F.lit(True))
    return objects.join(chosen, "object_id", "left").select("object_id", F.coalesce("_in", F.lit(False)).alias("selected"))
