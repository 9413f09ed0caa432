"""Object datasets ordered along a space-filling curve, with a stored header: viewports become a few ranges of one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slidegrid.operators import counts

#: Pixels of a cell of the curve's grid, and bits of a cell's number on either axis.
CELL, BITS = 64, 20
#: Ranges of keys that a viewport is broken into at most.
RANGES = 64
_LAST = (1 << BITS) - 1
#: Shifts and masks that put a 0 before each bit of a number.
_APART = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _cell(v: Column) -> Column:
    """A coordinate's cell; what lies outside of the grid is in its first or last cell."""
    return F.when(v.isNotNull(), F.least(F.greatest(F.floor(v / CELL), F.lit(0)), F.lit(_LAST))).cast("bigint")


def curve_key(x: Column, y: Column) -> Column:
    """The bits of the cells of x and y by turns: near objects have near keys. Null for a null coordinate."""
    out = []
    for c in (_cell(x), _cell(y)):
        for shift, mask in _APART:
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        out.append(c)
    return out[0].bitwiseOR(F.shiftleft(out[1], 1))


def key_ranges(left: float, right: float, top: float, bottom: float, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of keys, at most `most` and in order, that hold all cells of the box.

    Squares of the curve that the box cuts are split, the largest first, until there are enough; neighbours are merged.
    """
    cells = [min(max(int(v // CELL), 0), _LAST) for v in (left, right, top, bottom)]
    if right < left or bottom < top:
        return []
    inside, cut = [], [(BITS, 0, 0, 0)]  # level, first cell on either axis, first key

    def touches(x: int, y: int, size: int) -> bool:
        return x <= cells[1] and x + size > cells[0] and y <= cells[3] and y + size > cells[2]

    def within(x: int, y: int, size: int) -> bool:
        return cells[0] <= x and x + size - 1 <= cells[1] and cells[2] <= y and y + size - 1 <= cells[3]

    while cut and len(inside) + len(cut) + 3 <= 4 * most:
        level, x, y, key = cut.pop(0)
        half = 1 << (level - 1) if level else 0
        if not level or within(x, y, 1 << level):
            inside.append((key, key + (1 << 2 * level) - 1))
            continue
        for k in range(4):
            u, v = x + half * (k & 1), y + half * (k >> 1)
            if touches(u, v, half):
                cut.append((level - 1, u, v, key + (k << 2 * (level - 1))))
    ranges = sorted(inside + [(key, key + (1 << 2 * level) - 1) for level, _, _, key in cut])
    merged: list[list[int]] = []
    for a, b in ranges:
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    while len(merged) > most:  # close the narrowest gaps
        i = min(range(len(merged) - 1), key=lambda i: merged[i + 1][0] - merged[i][1])
        merged[i][1] = merged.pop(i + 1)[1]
    return [tuple(r) for r in merged]


def write_dataset(objects: DataFrame, path: str) -> None:
    """An object dataset (slide, x_centroid, y_centroid, features and others) in folders by slide, along the curve in each, and its header.

    Ranges of slide and key go to a task each, so a slide with many objects is written by several tasks. The header has the
    slides with their numbers, first places and sizes, and mean and deviation of each feature; it is written last, so a dataset without one is unfinished.
    """
    keyed = objects.withColumn("curve_key", curve_key(F.col("x_centroid"), F.col("y_centroid")))
    keyed.repartitionByRange("slide", "curve_key").sortWithinPartitions("slide", "curve_key").write.partitionBy("slide").mode("overwrite").parquet(f"{path}/objects")
    stored = objects.sparkSession.read.parquet(f"{path}/objects")
    counts.vocabulary(stored).join(counts.slide_offsets(stored), "slide").coalesce(1).write.mode("overwrite").parquet(f"{path}/header/slides")
    counts.feature_moments(stored).coalesce(1).write.mode("overwrite").parquet(f"{path}/header/features")


def read_slides(spark: SparkSession, path: str) -> DataFrame:
    """Slide, slide_index, first_index, n_objects of a stored dataset; nothing of its objects is read."""
    return spark.read.parquet(f"{path}/header/slides")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Dim, mean, std_dev of a stored dataset."""
    return spark.read.parquet(f"{path}/header/features")


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/objects")


def viewport(spark: SparkSession, path: str, slide: str, left: float, right: float, top: float, bottom: float) -> DataFrame:
    """The objects of a viewport of a stored dataset, bounds included. Slide, key ranges and bounds reach the scan, which reads the row groups of those ranges alone."""
    ranges = key_ranges(left, right, top, bottom)
    key = F.lit(False)
    for a, b in ranges:
        key = key | F.col("curve_key").between(a, b)
    inside = F.col("x_centroid").between(left, right) & F.col("y_centroid").between(top, bottom)
    return read_objects(spark, path).where((F.col("slide") == slide) & key & inside).drop("curve_key")
