"""Heatmaps of all slides at once: bins, blur, ranges, normalisers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slidegrid.sources import published
from slidegrid.sources.shared import checkpointed

CELL, SIGMA, BINS, SHARE = 40, 3.5, 20, 0.9
HALF = 19
#: Columns of a grid that are blurred down together.
BLOCK = 64


def kernel(sigma: float = SIGMA, half: int = HALF) -> list[float]:
    """Gaussian weights of offsets -half to half; they add up to 1."""
    raw = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-half, half + 1)]
    return [x / sum(raw) for x in raw]


def cells(objects: DataFrame) -> DataFrame:
    """For each grid cell the largest uncertainty, the share of positive objects, and how many there are."""
    u = 1 - F.abs("score")
    return objects.groupBy("slide", F.ceil(F.col("x_centroid") / CELL).cast("int").alias("cx"), F.ceil(F.col("y_centroid") / CELL).cast("int").alias("cy")).agg(
        F.max(u).alias("uncertainty"), F.avg((F.col("score") >= 0).cast("double")).alias("positive"), F.count("*").alias("density")
    )


def upper_medians(objects: DataFrame) -> DataFrame:
    """For each slide the uncertainty at place n div 2 of the sorted ones.

    Values are counted first, so what a slide's running total goes over is distinct values.
    """
    counted = objects.groupBy("slide", F.round(1 - F.abs("score"), 6).alias("u")).agg(F.count("*").alias("c"))
    up = Window.partitionBy("slide").orderBy("u").rowsBetween(Window.unboundedPreceding, 0)
    summed = counted.select("slide", "u", F.sum("c").over(up).alias("upto"), F.sum("c").over(Window.partitionBy("slide")).alias("n"))
    return summed.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("slide").agg(F.min("u").alias("median"))


def region_cells(objects: DataFrame) -> DataFrame:
    """For each cell the share of objects more uncertain than the slide's median, and of positive ones."""
    u = F.round(1 - F.abs(F.col("score")), 6)
    joined = objects.join(F.broadcast(upper_medians(objects)), "slide")
    return joined.groupBy("slide", F.ceil(F.col("x_centroid") / CELL).cast("int").alias("cx"), F.ceil(F.col("y_centroid") / CELL).cast("int").alias("cy")).agg(
        F.avg((u > F.col("median")).cast("double")).alias("uncertain_share"), F.avg((F.col("score") >= 0).cast("double")).alias("positive_share")
    )


def blurred(maps: DataFrame, slides: DataFrame) -> DataFrame:
    """Both maps of cells() blurred on the dense grid of each slide, rows then columns.

    A grid row is one array, whose length the slide's width bounds. Rows are convolved in batches where they are, and cut into blocks of BLOCK
    columns, which are gathered and convolved down; so each value is shuffled twice, in arrays, and no map has to fit in one task. Borders
    are mirrored (without repeating the border); cells outside of a slide don't count, slides without cells are zeros.
    """
    sizes = slides.selectExpr("name AS slide", f"CAST(ceil(x_size / {CELL}) AS INT) + 1 AS nx", f"CAST(ceil(y_size / {CELL}) AS INT) + 1 AS ny")
    inside = maps.join(sizes, "slide").where("cx >= 0 AND cx < nx AND cy >= 0 AND cy < ny")
    rows = inside.groupBy("slide", "nx", "cy").agg(F.collect_list(F.struct("cx", "uncertainty", "positive")).alias("row"))
    held = rows.mapInArrow(_across, "slide string, block int, cy int, u array<double>, p array<double>").groupBy("slide", "block").agg(F.collect_list(F.struct("cy", "u", "p")).alias("rows"))
    wanted = sizes.select("slide", "nx", "ny", F.explode(F.expr(f"sequence(0, CAST((nx - 1) DIV {BLOCK} AS INT))")).alias("block"))
    return wanted.join(held, ["slide", "block"], "left").select("slide", "block", "nx", "ny", "rows").mapInArrow(_down, "slide string, cx int, cy int, uncertainty double, positive double")


def _convolved(lines: np.ndarray) -> np.ndarray:
    """Sums with the kernel's weights around each place of the last axis; as the border is mirrored as often as it takes, lines can be shorter than the kernel."""
    wide = np.pad(lines, [(0, 0)] * (lines.ndim - 1) + [(HALF, HALF)], mode="reflect")
    n = lines.shape[-1]
    out = np.zeros(lines.shape)
    for k, w in enumerate(kernel()):
        out += w * wide[..., k : k + n]
    return out


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of cells as blurred lines, in blocks of BLOCK columns."""
    for batch in batches:
        slide, nx, cy, row = (batch.column(k) for k in range(4))
        nx = nx.to_numpy(zero_copy_only=False)
        cells_ = row.flatten()
        owner = np.repeat(np.arange(len(nx)), np.diff(row.offsets.to_numpy()))
        cx, *values = (cells_.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        out: list[tuple] = []
        for n in np.unique(nx):
            mine = np.flatnonzero(nx == n)
            place = np.full(len(nx), -1)
            place[mine] = np.arange(len(mine))
            here = place[owner] >= 0
            lines = np.zeros((2, len(mine), n))
            for k, v in enumerate(values):
                lines[k, place[owner[here]], cx[here]] = v[here]
            lines = _convolved(lines)
            out += [(i, a // BLOCK, lines[0, j, a : a + BLOCK], lines[1, j, a : a + BLOCK]) for j, i in enumerate(mine.tolist()) for a in range(0, n, BLOCK)]
        at = pa.array([x[0] for x in out], pa.int64())
        lists = [pa.array([x[k] for x in out], pa.list_(pa.float64())) for k in (2, 3)]
        yield pa.RecordBatch.from_arrays([slide.take(at), pa.array([x[1] for x in out], pa.int32()), cy.take(at), *lists], ["slide", "block", "cy", "u", "p"])


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of lines as blurred cells."""
    names = ["slide", "cx", "cy", "uncertainty", "positive"]
    for batch in batches:
        for slide, block, nx, ny, rows in zip(*(batch.column(k) for k in range(5)), strict=True):
            first, ny = block.as_py() * BLOCK, ny.as_py()
            width = min(BLOCK, nx.as_py() - first)
            lines = np.zeros((2, width, ny))
            if rows.is_valid:
                cells_ = rows.values
                cy = cells_.field(0).to_numpy(zero_copy_only=False)
                for k in (0, 1):
                    lines[k][:, cy] = cells_.field(k + 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).T
            lines = _convolved(lines)
            cx = np.repeat(np.arange(first, first + width, dtype=np.int32), ny)
            cy = np.tile(np.arange(ny, dtype=np.int32), width)
            columns = [pa.array([slide.as_py()] * len(cx), pa.string()), pa.array(cx), pa.array(cy), pa.array(lines[0].ravel()), pa.array(lines[1].ravel())]
            yield pa.RecordBatch.from_arrays(columns, names)


def ranges(maps: DataFrame) -> DataFrame:
    """Least and largest value of both maps of each slide."""
    return maps.groupBy("slide").agg(
        F.min("uncertainty").alias("u_min"), F.max("uncertainty").alias("u_max"), F.min("positive").alias("p_min"), F.max("positive").alias("p_max")
    )


def normalizers(maps: DataFrame) -> DataFrame:
    """From a histogram of BINS bins of each slide's map, the first bin at which over 90 % of the cells are passed, by BINS."""
    span = F.col("u_max") - F.col("u_min")
    place = F.when(span == 0, 0).otherwise(F.least(F.floor(F.round(F.col("uncertainty") / span * BINS, 9)), F.lit(BINS - 1)))
    counted = maps.join(F.broadcast(ranges(maps)), "slide").groupBy("slide", place.cast("int").alias("bin")).agg(F.count("*").alias("c"))
    up = Window.partitionBy("slide").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    summed = counted.select("slide", "bin", F.sum("c").over(up).alias("upto"), F.sum("c").over(Window.partitionBy("slide")).alias("n"))
    return summed.where(F.col("upto") > SHARE * F.col("n")).groupBy("slide").agg((F.min("bin") / BINS).alias("norm"))


def gray(maps: DataFrame) -> DataFrame:
    """gray levels from 0 to 255 of both maps; a map of zeros stays black. The maps, once blurred, are read from a checkpoint."""
    maps = checkpointed(maps)
    joined = maps.join(F.broadcast(normalizers(maps)), "slide").join(F.broadcast(ranges(maps)), "slide")
    u = F.when(F.col("norm") > 0, F.least(F.lit(255.0), 255 * F.col("uncertainty") / F.col("norm"))).otherwise(0.0)
    p = F.when(F.col("p_max") > 0, 255 * F.col("positive") / F.col("p_max")).otherwise(0.0)
    return joined.select("slide", "cx", "cy", u.alias("u_gray"), p.alias("p_gray"))


def ranked(maps: DataFrame) -> DataFrame:
    """Slides by their largest blurred uncertainty."""
    return ranges(maps).select("slide", "u_max").orderBy(F.desc("u_max"), "slide")


def heatmap_set(spark: SparkSession, path: str, iteration: int, make: Callable[[], DataFrame]) -> DataFrame:
    """The maps of all slides for the labels of this iteration: read if they were finished before, else made, written aside and published."""
    return spark.read.parquet(published.kept(spark, path, f"heatmaps of iteration {iteration}", lambda place: make().write.parquet(place)))
