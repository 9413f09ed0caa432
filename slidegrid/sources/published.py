"""Results that are kept for later calls: written aside, then published by a row that names their folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def place_of(spark: SparkSession, root: str, key: str) -> str | None:
    """The folder that was published first for the key, or None. Folders of writers that did not finish are never named."""
    try:
        rows = spark.read.schema("key string, place string, at timestamp").parquet(f"{root}/published")
    except AnalysisException:  # nothing has been published here yet
        return None
    found = rows.where(F.col("key") == key).agg(F.min(F.struct("at", "place")).alias("first")).first().first
    return found.place if found else None


def kept(spark: SparkSession, root: str, key: str, write: Callable[[str], None]) -> str:
    """The folder of the key's result; if there is none, `write` makes it in a new folder, which is published when it is done.

    Writers that race each make a folder of their own; all readers take the one that was published first. A writer that is lost leaves a
    folder that nobody reads, and the next call makes the result anew.
    """
    place = place_of(spark, root, key)
    if place is None:
        own = f"{root}/made/{uuid.uuid4().hex}"
        write(own)
        spark.range(1).select(F.lit(key).alias("key"), F.lit(own).alias("place"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{root}/published")
        place = place_of(spark, root, key)
    return place
