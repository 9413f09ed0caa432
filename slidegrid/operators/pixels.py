"""Pixel tables: colours, stains, object statistics, gradients. One row a pixel: tile_id, x, y, r, g, b, label (0: none)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidegrid.functions import boundaries as b

#: Stain vectors, tissue discriminants, and the matrices of the opponent colour space.
STAINS = ((0.650, 0.072, 0.0), (0.704, 0.990, 0.0), (0.286, 0.105, 0.0))
TISSUE = ((-0.154, 0.035, 0.549, -45.718), (-0.057, -0.817, 1.170, -49.887))
RGB_TO_LMS = ((0.3811, 0.5783, 0.0402), (0.1967, 0.7244, 0.0782), (0.0241, 0.1288, 0.8444))
LMS_TO_RGB = ((4.4687, -3.5887, 0.1196), (-1.2197, 2.3831, -0.1626), (0.0585, -0.2611, 1.2057))


def mixed(columns: list[Column], weights: tuple[float, ...]) -> Column:
    """A linear combination."""
    return sum((c * float(w) for c, w in zip(columns, weights, strict=False)), F.lit(float(weights[len(columns)])) if len(weights) > len(columns) else F.lit(0.0))


def density(v: Column) -> Column:
    """F8: optical density of an intensity from 0 to 255; 0 counts as 1."""
    return -255 * F.ln(F.greatest(v, F.lit(1)) / 255.0) / F.ln(F.lit(255.0))


def intensity(d: Column) -> Column:
    """F8: the intensity of an optical density."""
    return F.exp(-(d - 255) * F.ln(F.lit(255.0)) / 255)


def stain_matrix(stains: tuple = STAINS) -> np.ndarray:
    """unit stain vectors as columns; the third one completes each row to a unit vector and is itself made unit."""
    m = np.array(stains, float)
    for k in range(3):
        n = np.linalg.norm(m[:, k])
        if n:
            m[:, k] /= n
    m[:, 2] = np.sqrt(np.maximum(0, 1 - m[:, 0] ** 2 - m[:, 1] ** 2))
    m[:, 2] /= np.linalg.norm(m[:, 2])
    return m


def unmixed(pixels: DataFrame) -> DataFrame:
    """how much of each stain a pixel has."""
    inverse = np.linalg.inv(stain_matrix())
    d = [density(F.col(c)) for c in "rgb"]
    return pixels.select("tile_id", "x", "y", *[mixed(d, inverse[k]).alias(f"stain{k + 1}") for k in range(3)])


def stain_intensities(stains: DataFrame) -> DataFrame:
    """stains as intensities, by the inverse of the density transform."""
    return stains.select("tile_id", "x", "y", *[intensity(F.col(f"stain{k}")).alias(f"stain{k}") for k in (1, 2, 3)])


def remixed(stains: DataFrame) -> DataFrame:
    """colours of stains."""
    m = stain_matrix()
    s = [F.col(f"stain{k}") for k in (1, 2, 3)]
    return stains.select("tile_id", "x", "y", *[intensity(mixed(s, m[k])).alias(c) for k, c in enumerate("rgb")])


def is_tissue() -> Column:
    """whether the first linear function of the colour is below the second."""
    c = [F.col(x) for x in "rgb"]
    return mixed(c, TISSUE[0]) < mixed(c, TISSUE[1])


def opponent(pixels: DataFrame, keep: list[str]) -> DataFrame:
    """lightness and two colour axes; null where a logarithm has no value."""
    lms = [F.expr(f"CASE WHEN v > 0 THEN v END".replace("v", f"({' + '.join(f'{w}D * {c}' for w, c in zip(row, 'rgb', strict=True))})")) for row in RGB_TO_LMS]
    a, b, c = (F.log10(x) for x in lms)
    return pixels.select(*keep, ((a + b + c) / 3**0.5).alias("l"), ((a + b - 2 * c) / 6**0.5).alias("a"), ((a - b) / 2**0.5).alias("b"))


def back_to_rgb(colours: DataFrame, keep: list[str]) -> DataFrame:
    """colours of lightness and colour axes."""
    l, a, b = F.col("l") / 3**0.5, F.col("a") / 6**0.5, F.col("b") / 2**0.5  # noqa: E741
    lms = [F.pow(F.lit(10.0), x) for x in (l + a + b, l + a - b, l - 2 * a)]
    return colours.select(*keep, *[mixed(lms, row).alias(c) for row, c in zip(LMS_TO_RGB, "rgb", strict=True)])


def colour_statistics(pixels: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of each opponent axis over a tile's tissue; pixels without a value are left out."""
    lab = opponent(pixels.where(is_tissue()), ["tile_id"]).where("l IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL")
    return lab.groupBy("tile_id").agg(*[f(c).alias(f"{c}_{n}") for c in "lab" for n, f in (("mean", F.avg), ("std", F.stddev))])


def transferred(pixels: DataFrame, target: dict[str, tuple[float, float]]) -> DataFrame:
    """tissue pixels moved to the target's mean and deviation on each axis; other pixels stay. target: axis to (mean, std).

    A tile's pixels are moved together, by the figures of colour_statistics(); a tile whose tissue has one pixel, or no deviation on an axis, stays.
    """

    def tile(key: tuple, rows: pa.Table) -> pa.Table:
        out, tissue = [rows[c].to_numpy().astype(float) for c in "rgb"], rows["tissue"].to_numpy()
        with np.errstate(invalid="ignore"):
            lms = [row[0] * out[0] + row[1] * out[1] + row[2] * out[2] for row in RGB_TO_LMS]
            moved = np.flatnonzero((tissue == 1) & (lms[0] > 0) & (lms[1] > 0) & (lms[2] > 0))
        i, j, k = (np.log10(v[moved]) for v in lms)
        axes = {"l": (i + j + k) / 3**0.5, "a": (i + j - 2 * k) / 6**0.5, "b": (i - j) / 2**0.5}
        if key[0].is_valid and len(moved) > 1 and all(v.min() < v.max() for v in axes.values()):
            new = {c: (v - v.mean()) * (target[c][1] / v.std(ddof=1)) + target[c][0] for c, v in axes.items()}
            l, a, b = new["l"] / 3**0.5, new["a"] / 6**0.5, new["b"] / 2**0.5  # noqa: E741
            lms = [10.0**v for v in (l + a + b, l + a - b, l - 2 * a)]
            for v, row in zip(out, LMS_TO_RGB, strict=True):
                v[moved] = row[0] * lms[0] + row[1] * lms[1] + row[2] * lms[2]
        named = {c: pa.array(v, mask=np.isnan(v)) for c, v in zip("rgb", out, strict=True)}
        return pa.table({c: rows[c] for c in ("tile_id", "x", "y")} | named)

    marked = pixels.select("tile_id", "x", "y", F.coalesce(is_tissue(), F.lit(False)).cast("int").alias("tissue"), "r", "g", "b")
    kinds = dict(marked.dtypes)
    return marked.groupBy("tile_id").applyInArrow(tile, ", ".join(f"{c} {kinds[c]}" for c in ("tile_id", "x", "y")) + ", r double, g double, b double")


def green_ratio() -> Column:
    """the green share of a colour; null for black."""
    return F.try_divide(F.col("g"), F.col("r") + F.col("g") + F.col("b"))


def morphometry(pixels: DataFrame) -> DataFrame:
    """Area, centroid, box, extent, axes of the ellipse with the same second moments (1/12 for the pixel's own), eccentricity."""
    m = pixels.where("label > 0").groupBy("tile_id", "label").agg(
        F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        (F.var_pop("x") + 1 / 12).alias("xx"), (F.var_pop("y") + 1 / 12).alias("yy"), F.covar_pop("x", "y").alias("xy"),
    )
    root = F.sqrt((F.col("xx") - F.col("yy")) * (F.col("xx") - F.col("yy")) + 4 * F.col("xy") * F.col("xy"))
    m = m.withColumns({"major": 2 * F.sqrt(2 * (F.col("xx") + F.col("yy") + root)), "minor": 2 * F.sqrt(2 * F.greatest(F.col("xx") + F.col("yy") - root, F.lit(0.0)))})
    box = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    return m.select(
        "tile_id", "label", "area", "cx", "cy", "x0", "y0", "x1", "y1", (F.col("area") / box).alias("extent"), "major", "minor",
        F.sqrt(F.greatest(1 - (F.col("minor") / F.col("major")) * (F.col("minor") / F.col("major")), F.lit(0.0))).alias("eccentricity"),
    )


def of_area(objects: DataFrame, low: int = 20, high: int = 1000) -> DataFrame:
    """Objects larger than low and smaller than high."""
    return objects.where((F.col("area") > low) & (F.col("area") < high))


def intensities(pixels: DataFrame, value: str) -> DataFrame:
    """Mean, mean minus median, largest, smallest, and sample standard deviation of each object."""
    return pixels.where("label > 0").groupBy("tile_id", "label").agg(
        F.avg(value).alias("mean"), (F.avg(value) - F.median(value)).alias("mean_median"), F.max(value).alias("max"), F.min(value).alias("min"), F.stddev(value).alias("std")
    )


def textures(pixels: DataFrame, value: str) -> DataFrame:
    """Entropy in bits and energy of the histogram of whole values, skewness and kurtosis of each object.

    Histograms are counted first, so the second step has at most 256 rows for an object. Sides of the joins are as many as
    the objects, whatever size their source has, so none is broadcast.
    """
    level = F.least(F.greatest(F.round(value), F.lit(0)), F.lit(255)).cast("int")
    own = pixels.where("label > 0").select("tile_id", "label", level.alias("bin"), F.col(value).cast("double").alias("v"))
    bins = own.groupBy("tile_id", "label", "bin").agg(F.count("*").alias("c"))
    total = own.groupBy("tile_id", "label").agg(F.count("*").alias("n"), F.skewness("v").alias("skewness"), (F.kurtosis("v") + 3).alias("kurtosis"))
    p = F.col("c") / F.col("n")
    shares = bins.join(total.select("tile_id", "label", "n").hint("merge"), ["tile_id", "label"]).groupBy("tile_id", "label").agg((-F.sum(p * F.log2(p))).alias("entropy"), F.sum(p * p).alias("energy"))
    return shares.join(total.drop("n").hint("merge"), ["tile_id", "label"])


def gradient(pixels: DataFrame, value: str) -> DataFrame:
    """Central differences of a tile's values, one-sided at its edges, and their magnitude."""
    def way(along: str, across: str) -> Column:
        w = Window.partitionBy("tile_id", across).orderBy(along)
        before, after, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        return F.when(before.isNull() & after.isNull(), F.lit(0.0)).when(before.isNull(), (after - v).cast("double")).when(after.isNull(), (v - before).cast("double")).otherwise((after - before) / 2.0)

    both = pixels.select("tile_id", "x", "y", "label", way("x", "y").alias("gx"), way("y", "x").alias("gy"))
    return both.withColumn("magnitude", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def gradients(pixels: DataFrame, value: str) -> DataFrame:
    """Mean, deviation, entropy, energy, skewness and kurtosis of the gradient's magnitude of each object."""
    g = gradient(pixels, value)
    return intensities(g, "magnitude").select("tile_id", "label", "mean", "std").join(textures(g, "magnitude").hint("merge"), ["tile_id", "label"])


def by_tile(pixels: DataFrame, columns: list[str], work: Callable[..., pa.Table], schema: str) -> DataFrame:
    """work, which takes a tile's id and its columns as arrays (nulls of a value are NaN), for each tile. A tile has a fixed size; a pixel without a place is left out, one without a label is of none."""

    def tile(key: tuple, rows: pa.Table) -> pa.Table:
        return work(key[0].as_py(), *[rows[c].to_numpy() for c in columns])

    placed = pixels.where("x IS NOT NULL AND y IS NOT NULL").withColumn("label", F.coalesce("label", F.lit(-1)))
    return placed.select("tile_id", *columns).groupBy("tile_id").applyInArrow(tile, schema)


def rims(x: np.ndarray, y: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which object, x and y of the pixels that have a neighbour to a side which is not of their object, in the order of objects, y and x."""
    left, top, wide = x.min() - 1, y.min() - 1, int(x.max() - x.min()) + 3
    size = wide * (int(y.max() - y.min()) + 3)
    own = np.unique(which.astype(np.int64) * size + (y - top).astype(np.int64) * wide + (x - left))
    inner = np.ones(len(own), bool)
    for step in (-1, 1, -wide, wide):
        inner &= own[np.minimum(np.searchsorted(own, own + step), len(own) - 1)] == own + step
    which, place = np.divmod(own[~inner], size)
    return which, place % wide + left, place // wide + top


def ring(x: np.ndarray, y: np.ndarray, label: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, x and y of a tile's rings: distinct places of label 0 within the radius of an object. Only pixels of an object's rim mark their disk, in a box around the object."""
    free, held = label == 0, label > 0
    if not free.any() or not held.any():
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    labels, which = np.unique(label[held], return_inverse=True)
    which, rim_x, rim_y = rims(x[held].astype(np.int64), y[held].astype(np.int64), which)
    first = np.searchsorted(which, np.arange(len(labels) + 1))
    left, top = np.minimum.reduceat(rim_x, first[:-1]) - radius, np.minimum.reduceat(rim_y, first[:-1]) - radius
    w, h = np.maximum.reduceat(rim_x, first[:-1]) + radius + 1 - left, np.maximum.reduceat(rim_y, first[:-1]) + radius + 1 - top
    dy, dx = np.indices((2 * radius + 1,) * 2).reshape(2, -1) - radius
    dy, dx = dy[dx * dx + dy * dy <= radius * radius], dx[dx * dx + dy * dy <= radius * radius]
    x0, y0 = min(left.min(), x.min()), min(top.min(), y.min())
    wide = int(max((left + w).max(), x.max() + 1) - x0)
    spots = np.unique((y[free].astype(np.int64) - y0) * wide + (x[free] - x0))
    ends, found, a = np.cumsum(w * h), [], 0
    while a < len(labels):
        # objects whose boxes have 2**22 places together, or one object
        e = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 22), "right")))
        base = np.r_[0, np.cumsum((w * h)[a:e])]
        mark = np.zeros(base[-1], bool)
        for k in range(first[a], first[e], 1 << 14):
            o, px, py = (v[k : min(k + (1 << 14), first[e])] for v in (which, rim_x, rim_y))
            mark[(base[o - a] + (py - top[o]) * w[o] + px - left[o])[:, None] + dy * w[o][:, None] + dx] = True
        hit = np.flatnonzero(mark)
        o = np.searchsorted(base, hit, "right") - 1
        down, along = np.divmod(hit - base[o], w[o + a])
        spot = (down + top[o + a] - y0) * wide + along + left[o + a] - x0
        inside = spots[np.minimum(np.searchsorted(spots, spot), len(spots) - 1)] == spot
        found.append((o[inside] + a, spot[inside]))
        a = e
    o, spot = (np.concatenate(v) for v in zip(*found, strict=True))
    return labels[o], spot % wide + x0, spot // wide + y0


def rings(pixels: DataFrame, radius: int = 8) -> DataFrame:
    """for each object the pixels within the radius of it that belong to no object."""

    def work(tile: int, x: np.ndarray, y: np.ndarray, label: np.ndarray) -> pa.Table:
        labels, at_x, at_y = ring(x, y, label, radius)
        return pa.table({"tile_id": pa.array([tile] * len(labels), pa.int64()), "label": labels.astype(np.int32), "x": at_x.astype(np.int32), "y": at_y.astype(np.int32)})

    return by_tile(pixels, ["x", "y", "label"], work, "tile_id bigint, label int, x int, y int")


def outlines(pixels: DataFrame) -> DataFrame:
    """tile_id, label, points: the outer rim of each object's first part, walked clockwise from its topmost pixel on, with the start again at the end.

    A tile's objects are walked in one group, one after the other. Only pixels of their rims are walked, and each is met a few times at most.
    """
    around = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))

    def walk(x: np.ndarray, y: np.ndarray) -> list[dict]:
        held = set(zip(x.tolist(), y.tolist(), strict=True))
        start = min(held, key=lambda p: (p[1], p[0]))
        path, at, way, first = [start], start, 0, None
        for _ in range(4 * len(held) + 8):
            # from the pixel behind on, clockwise, to the first neighbour of the object
            turn = next((k for k in range(8) if (at[0] + around[(way + 6 + k) % 8][0], at[1] + around[(way + 6 + k) % 8][1]) in held), None)
            if turn is None:
                break
            way = (way + 6 + turn) % 8
            if (at, way) == first:
                break
            first = first or (at, way)
            at = (at[0] + around[way][0], at[1] + around[way][1])
            path.append(at)
        return [{"x": float(x), "y": float(y)} for x, y in path]

    def tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        labels, which = np.unique(pdf["label"].to_numpy(), return_inverse=True)
        which, x, y = rims(pdf["x"].to_numpy(), pdf["y"].to_numpy(), which)
        ends = np.searchsorted(which, np.arange(1, len(labels)))
        return pd.DataFrame({"tile_id": key[0], "label": labels, "points": [walk(*p) for p in zip(np.split(x, ends), np.split(y, ends), strict=True)]})

    held = pixels.where("label > 0 AND x IS NOT NULL AND y IS NOT NULL").select("tile_id", "label", "x", "y")
    return held.groupBy("tile_id").applyInPandas(tile, "tile_id bigint, label int, points array<struct<x:double,y:double>>")


def by_label(pdf: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """The labels of a tile's rows, and the places of each one's rows."""
    order = np.argsort(pdf["label"].to_numpy(), kind="stable")
    labels, first = np.unique(pdf["label"].to_numpy()[order], return_index=True)
    return labels, np.split(order, first[1:])


#: Names of the values of an object's vector, in order.
SHAPE_NAMES = ("Area", "Perimeter", "Eccentricity", "Circularity", "MajorAxisLength", "MinorAxisLength", "Extent", "Solidity", *(f"FSD{i}" for i in range(1, 7)))
STAIN_NAMES = (
    "MeanIntensity", "MeanMedianDifferenceIntensity", "MaxIntensity", "MinIntensity", "StdIntensity", "Entropy", "Energy", "Skewness", "Kurtosis",
    "MeanGradMag", "StdGradMag", "EntropyGradMag", "EnergyGradMag", "SkewnessGradMag", "KurtosisGradMag",
)
EDGE_NAMES = ("SumCanny", "MeanCanny")
NAMES = (*SHAPE_NAMES, *(f"{part}{n}" for part in ("Hematoxylin", "Cytoplasm") for n in (*STAIN_NAMES, *EDGE_NAMES)))
#: Edge detection: deviation of the smoothing, half the filters' length, bins of the histogram of slopes, share of pixels that are no strong edges, and weak threshold by the strong one.
EDGE_SIGMA, EDGE_HALF, EDGE_BINS, EDGE_FLAT, EDGE_WEAK = 2**0.5, 8, 64, 0.7, 0.4
#: Boundaries that are transformed at once.
FOURIER_ROWS = 1024


def _filtered(image: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    """The image filtered along an axis; pixels beyond the border are like those of the border."""
    wide = np.pad(image, [(EDGE_HALF, EDGE_HALF) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
    n = image.shape[axis]
    out = np.zeros(image.shape)
    for k, w in enumerate(taps):
        out += w * (wide[k : k + n] if axis == 0 else wide[:, k : k + n])
    return out


def canny(image: np.ndarray) -> np.ndarray:
    """Whether each pixel is on an edge: slopes of the smoothed image, their crests, and weak crests that hang together with a strong one.

    The strong threshold is the first of EDGE_BINS bins of the slopes (by their largest) that EDGE_FLAT of the pixels do not pass. A crest is a pixel whose slope is as large
    as those interpolated before and after it along its direction, and larger than one of them.
    """
    at = np.arange(-EDGE_HALF, EDGE_HALF + 1)
    smooth = np.exp(-(at**2) / (2 * EDGE_SIGMA**2))
    smooth /= smooth.sum()
    slope = at * smooth / np.abs(at * smooth)[at > 0].sum()
    gy, gx = _filtered(_filtered(image, smooth, 1), slope, 0), _filtered(_filtered(image, smooth, 0), slope, 1)
    size = np.hypot(gx, gy)
    if size.max(initial=0) <= 1e-9:
        return np.zeros(image.shape, bool)
    size = np.round(size / size.max(), 9)
    passed = np.cumsum(np.bincount(np.minimum((size * (EDGE_BINS - 1) + 0.5).astype(int), EDGE_BINS - 1).ravel(), minlength=EDGE_BINS))
    strong = (int(np.argmax(passed > EDGE_FLAT * size.size)) + 1) / EDGE_BINS
    wide = np.pad(size, 1)
    h, w = size.shape

    def beside(dy: np.ndarray, dx: np.ndarray) -> np.ndarray:
        """Slopes one step along a direction, between the two nearest of the eight neighbours."""
        y, x = np.indices((h, w))
        steep = np.abs(dy) > np.abs(dx)
        part = np.divide(np.minimum(np.abs(dy), np.abs(dx)), np.maximum(np.abs(dy), np.abs(dx)), out=np.zeros((h, w)), where=(dy != 0) | (dx != 0))
        sy, sx = np.sign(dy).astype(int), np.sign(dx).astype(int)
        straight = wide[y + 1 + np.where(steep, sy, 0), x + 1 + np.where(steep, 0, sx)]
        return (1 - part) * straight + part * wide[y + 1 + sy, x + 1 + sx]

    before, after = np.round(beside(-gy, -gx), 9), np.round(beside(gy, gx), 9)
    crest = (size >= before) & (size >= after) & ((size > before) | (size > after))
    weak = crest & (size > EDGE_WEAK * strong)
    # weak crests that hang together have one number: the smallest, passed on between neighbours by halves of the way
    number = np.where(weak, np.arange(size.size).reshape(h, w), size.size)
    while True:
        wide_n = np.pad(number, 1, constant_values=size.size)
        least = number
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                least = np.minimum(least, wide_n[dy : dy + h, dx : dx + w])
        least = np.where(weak, least, size.size)
        roots = np.append(least.ravel(), size.size)
        least = np.where(weak, roots[least], size.size)
        if (least == number).all():
            break
        number = least
    kept = np.zeros(size.size + 1, bool)
    kept[number[crest & (size > strong)]] = True
    kept[size.size] = False
    return kept[number]


def picture(x: np.ndarray, y: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A tile's values as an image; missing pixels are 0."""
    image = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1))
    image[y - y.min(), x - x.min()] = v
    return image


def edges(pixels: DataFrame, value: str) -> DataFrame:
    """tile_id, x, y of the pixels that are on an edge of the value, tile by tile; a tile has a fixed size. Missing pixels are 0."""

    def tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        found_y, found_x = np.nonzero(canny(picture(x, y, pdf[value].to_numpy(float))))
        return pd.DataFrame({"tile_id": key[0], "x": (found_x + x.min()).astype(np.int32), "y": (found_y + y.min()).astype(np.int32)})

    held = pixels.select("tile_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), value).where(F.col(value).isNotNull())
    return held.groupBy("tile_id").applyInPandas(tile, "tile_id bigint, x int, y int")


def edge_values(of: DataFrame, found: DataFrame) -> DataFrame:
    """tile_id, label, values: how many pixels of each label are on an edge, and their share. of: tile_id, x, y, label. found: from edges()."""
    marked = of.where("label > 0").join(found.withColumn("on", F.lit(1)).hint("merge"), ["tile_id", "x", "y"], "left")
    return marked.groupBy("tile_id", "label").agg(F.array(F.count("on").cast("double"), F.count("on") / F.count("*")).alias("values"))


def stain_channels(pixels: DataFrame) -> DataFrame:
    """tile_id, x, y, label and both stains as intensities from 0 to 255: unmixed densities, turned back into intensities."""
    inverse = np.linalg.inv(stain_matrix())
    d = [density(F.col(c)) for c in "rgb"]
    return pixels.select("tile_id", "x", "y", "label", *[F.least(intensity(mixed(d, inverse[k])), F.lit(255.0)).alias(n) for k, n in enumerate(("hematoxylin", "eosin"))])


def slopes(x: np.ndarray, y: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The gradient's magnitude of a tile's pixels, as gradient() has it; NaN is no value."""

    def way(along: np.ndarray, across: np.ndarray) -> np.ndarray:
        order = np.lexsort((along, across))
        own, same = v[order], np.diff(across[order]) == 0
        before, after, out = np.full(len(v), np.nan), np.full(len(v), np.nan), np.empty(len(v))
        before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
        first, last = np.isnan(before), np.isnan(after)
        out[order] = np.where(first & last, 0.0, np.where(first, after - own, np.where(last, own - before, (after - before) / 2.0)))
        return out

    gx, gy = way(x, y), way(y, x)
    return np.sqrt(gx * gx + gy * gy)


def figures(which: np.ndarray, n: int, v: np.ndarray) -> np.ndarray:
    """A15 and A16 of n objects with a row each: mean, mean minus median, largest, smallest, deviation, entropy, energy, skewness, kurtosis.

    NaN is no value, and counts in the histogram's first bin only, as in textures().
    """
    order = np.lexsort((v, which))
    v, which = v[order], which[order]
    first = np.searchsorted(which, np.arange(n))
    rows, known = np.bincount(which, minlength=n), ~np.isnan(v)
    m = np.add.reduceat(known.astype(int), first)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.add.reduceat(np.where(known, v, 0), first) / m
        apart = np.where(known, v - mean[which], 0)
        two, three, four = (np.add.reduceat(apart**k, first) for k in (2, 3, 4))
        low, high = v[first], v[first + np.maximum(m - 1, 0)]
        two[low == high] = 0
        middle = (v[first + np.maximum(m - 1, 0) // 2] + v[first + np.where(m > 0, m // 2, 0)]) / 2
        deviation = np.where(m > 1, np.sqrt(two / (m - 1)), np.nan)
        skewness, kurtosis = (np.where(two > 0, e, np.nan) for e in (np.sqrt(m) * three / two**1.5, m * four / (two * two)))
    whole = np.floor(np.where(known, v, 0))
    bins = np.clip(whole + (np.where(known, v, 0) - whole >= 0.5), 0, 255).astype(int)
    p = np.bincount(which * 256 + bins, minlength=256 * n).reshape(n, 256) / rows[:, None]
    entropy, energy = -(p * np.log2(p, out=np.zeros_like(p), where=p > 0)).sum(1), (p * p).sum(1)
    return np.stack([mean, mean - middle, high, low, deviation, entropy, energy, skewness, kurtosis], 1)


def tile_values(pixels: DataFrame, value: str, radius: int | None = None, stains: bool = True, marks: bool = False) -> DataFrame:
    """tile_id, label, values of a value of each object, or, with a radius, of the ring around it: the 15 intensity, texture and gradient values, and how many pixels are on an edge and their share.

    A tile's pixels, its gradient, rings and edges stay in its group, so that only a row for each object leaves it.
    """

    def work(tile: int, x: np.ndarray, y: np.ndarray, label: np.ndarray, v: np.ndarray) -> pa.Table:
        v, rows = v.astype(float), np.flatnonzero(label > 0)
        name = label[rows]
        if radius is not None:
            name, at_x, at_y = ring(x, y, label, radius)
            x0, y0, wide = x.min(), y.min(), int(x.max() - x.min()) + 1
            place, spot = (y - y0).astype(np.int64) * wide + (x - x0), (at_y - y0) * wide + (at_x - x0)
            order = np.argsort(place, kind="stable")
            low, high = np.searchsorted(place[order], spot), np.searchsorted(place[order], spot, "right")
            # every row at a place of the ring
            rows = order[np.repeat(low - np.r_[0, np.cumsum(high - low)[:-1]], high - low) + np.arange((high - low).sum())] if len(spot) else low
            name = np.repeat(name, high - low)
        labels, which = np.unique(name, return_inverse=True)
        parts = []
        if len(labels) and stains:
            parts += [figures(which, len(labels), v[rows]), figures(which, len(labels), slopes(x, y, v)[rows])[:, [0, 4, 5, 6, 7, 8]]]
        if len(labels) and marks:
            on, known = np.zeros(len(v), bool), ~np.isnan(v)
            if known.any():
                image = canny(picture(x[known], y[known], v[known]))
                down, along = y - y[known].min(), x - x[known].min()
                inside = (down >= 0) & (along >= 0) & (down < image.shape[0]) & (along < image.shape[1])
                on[inside] = image[down[inside], along[inside]]
            count = np.bincount(which, on[rows], len(labels))
            parts.append(np.stack([count, count / np.bincount(which, minlength=len(labels))], 1))
        flat = np.concatenate(parts, 1) if parts else np.zeros((0, 0))
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel(), mask=np.isnan(flat.ravel())))
        return pa.table({"tile_id": pa.array([tile] * len(flat), pa.int64()), "label": labels.astype(np.int32), "values": values})

    return by_tile(pixels, ["x", "y", "label", value], work, "tile_id bigint, label int, values array<double>")


def nuclear_values(pixels: DataFrame) -> DataFrame:
    """the haematoxylin values of each object."""
    return tile_values(stain_channels(pixels), "hematoxylin")


def cytoplasm_values(pixels: DataFrame, radius: int = 8) -> DataFrame:
    """the eosin values of the ring around each object."""
    return tile_values(stain_channels(pixels), "eosin", radius)


def edge_group(pixels: DataFrame) -> DataFrame:
    """How many of each object's pixels are on an edge of the haematoxylin, and their share."""
    return tile_values(stain_channels(pixels), "hematoxylin", stains=False, marks=True)


def shape_values(pixels: DataFrame) -> DataFrame:
    """area, perimeter, eccentricity, circularity, axes, extent, solidity and Fourier energies of each object."""
    outer = outlines(pixels).withColumn("perimeter", F.aggregate(b.lengths(F.col("points")), F.lit(0.0), lambda a, x: a + x))
    fourier = fourier_energies(outer.select("tile_id", "label", "points"), ["tile_id", "label"])
    joined = morphometry(pixels)
    for part in (outer.select("tile_id", "label", "perimeter"), solidity(pixels), fourier):
        joined = joined.join(part.hint("merge"), ["tile_id", "label"])
    round_ = F.when(F.col("perimeter") > 0, 4 * 3.141592653589793 * F.col("area") / (F.col("perimeter") * F.col("perimeter")))
    own = F.array(F.col("area").cast("double"), "perimeter", "eccentricity", round_, "major", "minor", "extent", "solidity")
    return joined.select("tile_id", "label", F.concat(own, "energies").alias("values"))


def vectors(pixels: DataFrame) -> DataFrame:
    """one feature array for each object, in the order of NAMES (48 values).

    Each group has a row for every object; an object that a group lacks is an error, but for the cytoplasm of an object without a ring.
    """
    key = ["tile_id", "label"]
    stains = stain_channels(pixels)
    parts = [shape_values(pixels), tile_values(stains, "hematoxylin", marks=True), tile_values(stains, "eosin", 8, marks=True)]
    joined = pixels.where("label > 0").select(*key).distinct()
    for i, p in enumerate(parts):
        joined = joined.join(p.withColumnRenamed("values", f"v{i}"), key, "full_outer")
    gap = F.array(*[F.lit(None).cast("double")] * len(STAIN_NAMES + EDGE_NAMES))
    own = F.concat("v0", "v1", F.coalesce("v2", gap))
    lacks = F.col("v0").isNull() | F.col("v1").isNull()
    return joined.select(*key, F.when(lacks, F.raise_error(F.lit("a group of features has no row for an object"))).otherwise(own).alias("features"))


def solidity(pixels: DataFrame) -> DataFrame:
    """Area by the area of the convex hull of the pixels' corners. Only the ends of each row of an object go to its tile's group, where objects are dealt with one after the other."""
    ends = pixels.where("label > 0").groupBy("tile_id", "label", "y").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count("*").alias("n"))

    def hull(y: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
        xs, ys = np.r_[a, a, b + 1, b + 1], np.r_[y, y + 1, y, y + 1]
        points = sorted(set(zip(xs.tolist(), ys.tolist(), strict=True)))
        chain: list[tuple[int, int]] = []
        for way in (points, points[::-1]):
            start = len(chain)
            for p in way:
                while len(chain) - start >= 2 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                    chain.pop()
                chain.append(p)
            chain.pop()
        h = np.array(chain, float)
        return abs(np.dot(h[:, 0], np.roll(h[:, 1], -1)) - np.dot(h[:, 1], np.roll(h[:, 0], -1))) / 2

    def tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        labels, parts = by_label(pdf)
        y, a, b, n = (pdf[c].to_numpy() for c in ("y", "a", "b", "n"))
        return pd.DataFrame({"tile_id": key[0], "label": labels, "solidity": [float(n[p].sum()) / hull(y[p], a[p], b[p]) for p in parts]})

    return ends.groupBy("tile_id").applyInPandas(tile, "tile_id bigint, label int, solidity double")


def fourier_shapes(boundaries: DataFrame, points: int = 128, bands: int = 6) -> DataFrame:
    """object_id, energies: Fourier energies of boundaries that are text; the polygon is closed first."""
    closed = b.bound(b.parsed(F.col("boundary")), lambda q: F.concat(q, F.slice(q, 1, 1)))
    return fourier_energies(boundaries.select("object_id", closed.alias("points")), ["object_id"], points, bands)


def even_points(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n + 1 points at equal distances along each row's boundary, as boundaries.resampled() has them."""
    way = np.concatenate([np.zeros((len(x), 1)), np.cumsum(np.sqrt(np.diff(x) * np.diff(x) + np.diff(y) * np.diff(y)), 1)], 1)
    to = np.arange(n + 1) * way[:, -1:] / n
    if x.shape[1] <= 32:
        j = np.zeros(to.shape, np.intp)
        for k in range(x.shape[1]):
            j += way[:, k : k + 1] <= to
    else:
        j = np.stack([np.searchsorted(w, v, "right") for w, v in zip(way, to, strict=True)])
    last = j >= x.shape[1]
    j = np.minimum(j, x.shape[1] - 1)
    at = (np.arange(len(x)) * x.shape[1])[:, None] + j
    before = at - (j > 0)
    side = way.ravel()[at] - way.ravel()[before]
    share = np.divide(to - way.ravel()[before], side, out=np.zeros_like(to), where=side > 0)
    out = []
    for v in (x, y):
        a, b = v.ravel()[before], v.ravel()[at]
        out.append(np.where(way[:, -1:] == 0, v[:, :1], np.where(last, v[:, -1:], a + (b - a) * share)))
    return out[0], out[1]


def fourier_energies(boundaries: DataFrame, keep: list[str], points: int = 128, bands: int = 6) -> DataFrame:
    """spectral energy of a closed boundary's direction in log-spaced bands, neighbours sharing their common end.

    Boundaries go to numpy as they are, where those of a batch that have equally many points are resampled and transformed
    together. keep: columns besides `points`. Boundaries without points, or without length, have no energy; null has none of it.
    """
    ends = np.unique(np.rint(2.0 ** np.linspace(0, np.log2(points / 2), bands + 1)).astype(int))
    line = boundaries.select(*keep, F.transform("points", lambda v: v["x"]).alias("px"), F.transform("points", lambda v: v["y"]).alias("py"))

    def energies(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = even_points(x, y, points)
        angle = np.arctan2(np.diff(y), np.diff(x))
        half = np.fft.rfft(angle - angle[:, :1])
        half = half.real * half.real + half.imag * half.imag
        power = np.concatenate([half, half[:, 1 : points - half.shape[1] + 1][:, ::-1]], 1)
        total = power.sum(1, keepdims=True)
        power = np.divide(power, total, out=np.zeros_like(power), where=total > 0)
        return np.stack([power[:, i - 1 : j].sum(1) for i, j in zip(ends, ends[1:], strict=False)], 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            px, py = rows["px"], rows["py"]
            none, size = px.is_null().to_numpy(zero_copy_only=False), px.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            x, y = (v.flatten().to_numpy(zero_copy_only=False).astype(float) for v in (px, py))
            first, found = np.cumsum(size) - size, np.zeros((len(rows), len(ends) - 1))
            for m in np.unique(size[size > 0]):
                same = np.flatnonzero(size == m)
                for k in range(0, len(same), FOURIER_ROWS):
                    part = same[k : k + FOURIER_ROWS]
                    at = first[part][:, None] + np.arange(m)
                    found[part] = energies(x[at], y[at])
            width = np.where(none, 0, found.shape[1])
            listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(width)].astype(np.int32)), pa.array(found[~none].ravel()), mask=pa.array(none))
            yield pa.RecordBatch.from_arrays([*[rows[c] for c in keep], listed], [*keep, "energies"])

    kinds = dict(line.dtypes)
    return line.mapInArrow(work, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", energies array<double>")


def score_mask(polygons: DataFrame, empty: float = 7.0) -> DataFrame:
    """pixels of each view's region with the score of the polygon that covers their centre; the largest object id wins, `empty` elsewhere.

    polygons: view_id, l, t, r, b, object_id, score, boundary; those that only reach into the view belong to it too. A pixel is inside if a
    line from it to the right crosses an odd number of sides. The region is left dense.
    """
    views = polygons.select("view_id", "l", "t", "r", "b").distinct()
    p = polygons.withColumn("p", b.parsed(F.col("boundary"))).withColumn("q", F.expr("concat(slice(p, 2, size(p)), slice(p, 1, 1))"))
    least, most = (lambda v: F.array_min(F.transform("p", lambda q: q[v]))), (lambda v: F.array_max(F.transform("p", lambda q: q[v])))
    top, low = F.ceil(F.greatest(least("y"), F.col("t"))).cast("int"), F.floor(F.least(most("y"), F.col("b"))).cast("int")
    lines = p.withColumn("y", F.explode(F.when(top <= low, F.sequence(top, low))))
    up = lambda e: (e["p"]["y"] > F.col("y")) != (e["q"]["y"] > F.col("y"))
    at = lambda e: (e["q"]["x"] - e["p"]["x"]) * (F.col("y") - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]) + e["p"]["x"]
    lines = lines.withColumn("cut", F.transform(F.filter(F.arrays_zip("p", "q"), up), at))
    left, right = F.ceil(F.greatest(F.array_min("cut"), F.col("l"))).cast("int"), F.floor(F.least(F.array_max("cut"), F.col("r"))).cast("int")
    filled = lines.withColumn("x", F.explode(F.when(left <= right, F.sequence(left, right)))).where(F.size(F.filter("cut", lambda c: c > F.col("x"))) % 2 == 1)
    best = filled.groupBy("view_id", "x", "y").agg(F.max_by("score", "object_id").alias("score"))
    dense = views.select("view_id", "t", "b", F.explode(F.expr("sequence(CAST(l AS INT), CAST(r AS INT))")).alias("x")).select("view_id", "x", F.explode(F.expr("sequence(CAST(t AS INT), CAST(b AS INT))")).alias("y"))
    return dense.join(best, ["view_id", "x", "y"], "left").na.fill(empty, ["score"])
