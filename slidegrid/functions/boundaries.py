"""Boundaries as arrays of points: parsing, writing, cleaning, measuring. Column expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is computed once however often f names it."""
    return F.transform(F.array(value), f)[0]


def parsed(text: Column, between: str = " ") -> Column:
    """Points of a text of `x,y` parts; parts without exactly two numbers are dropped."""
    parts = F.filter(F.transform(F.split(text, between), lambda p: F.split(p, ",")), lambda p: F.size(p) == 2)
    points = F.transform(parts, lambda p: F.struct(p[0].try_cast("double").alias("x"), p[1].try_cast("double").alias("y")))
    return F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def written(points: Column, between: str = " ") -> Column:
    """Points as text with one decimal, which decimals round alike everywhere."""
    one = lambda v: v.cast("decimal(12,1)").cast("string")
    return F.array_join(F.transform(points, lambda p: F.concat(one(p["x"]), F.lit(","), one(p["y"]))), between)


def moved(points: Column, dx: Column, dy: Column) -> Column:
    """Points moved from a tile's place to the slide's."""
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def scaled(points: Column, factor: Column) -> Column:
    """P2 for every vertex."""
    return F.transform(points, lambda p: F.struct((p["x"] * factor).alias("x"), (p["y"] * factor).alias("y")))


def _sides(points: Column, i: Column) -> tuple[Column, Column, Column, Column]:
    """The differences of the point at i to the one before and after it."""
    a, b, c = points[i - 1], points[i], points[i + 1]
    return b["x"] - a["x"], b["y"] - a["y"], c["x"] - b["x"], c["y"] - b["y"]


def without_repeats(points: Column) -> Column:
    """Points without those equal to the one before."""
    return bound(points, lambda q: F.filter(q, lambda p, i: (i == 0) | (p["x"] != q[F.greatest(i - 1, F.lit(0))]["x"]) | (p["y"] != q[F.greatest(i - 1, F.lit(0))]["y"])))


def merged(points: Column) -> Column:
    """without vertices between two collinear sides, and stationary repeats."""

    def bends(q: Column, i: Column) -> Column:
        x1, y1, x2, y2 = _sides(q, F.greatest(i, F.lit(1)))
        return (i == 0) | (i == F.size(q) - 1) | (x1 * y2 - x2 * y1 != 0)

    return bound(without_repeats(points), lambda q: F.filter(q, lambda p, i: bends(q, i)))


def without_spurs(points: Column) -> Column:
    """without stationary repeats, and then without points at which a side turns straight back: cross product 0 and dot product below 0."""
    return _without_turns(without_repeats(points))


def _without_turns(points: Column) -> Column:
    def goes_on(q: Column, i: Column) -> Column:
        x1, y1, x2, y2 = _sides(q, F.greatest(i, F.lit(1)))
        return (i == 0) | (i == F.size(q) - 1) | (x1 * y2 - x2 * y1 != 0) | (x1 * x2 + y1 * y2 >= 0)

    return bound(points, lambda q: F.filter(q, lambda p, i: goes_on(q, i)))


def distinct(points: Column) -> Column:
    """the first copy of each vertex, and the closing vertex if the boundary is closed."""

    def once(q: Column) -> Column:
        last = F.element_at(q, -1)
        return F.when((F.size(q) > 1) & (q[0] == last), F.concat(F.array_distinct(q), F.array(last))).otherwise(F.array_distinct(q))

    return bound(points, once)


def cleaned(points: Column) -> Column:
    """merged, then each vertex once, then without spurs."""
    return _without_turns(distinct(merged(points)))


def lengths(points: Column) -> Column:
    """Lengths of the sides."""
    def side(a: Column, b: Column) -> Column:
        return F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))

    def sides(q: Column) -> Column:
        n = F.greatest(F.size(q) - 1, F.lit(0))
        return F.when(n < 1, F.expr("CAST(array() AS array<double>)")).otherwise(F.zip_with(F.slice(q, 1, n), F.slice(q, 2, n), side))

    return bound(points, sides)


def arc_lengths(points: Column) -> Column:
    """The way along the boundary to each vertex."""
    return F.aggregate(lengths(points), F.array(F.lit(0.0)), lambda way, side: F.concat(way, F.array(F.element_at(way, -1) + side)))


def resampled(points: Column, n: int) -> Column:
    """n + 1 points at equal distances along the boundary; a boundary without length gives its first point."""

    def at(q: Column, way: Column, to: Column) -> Column:
        j = F.size(F.filter(way, lambda w: w <= to))
        a, b, share = q[j - 1], q[j], (to - way[j - 1]) / (way[j] - way[j - 1])
        between = F.struct((a["x"] + (b["x"] - a["x"]) * share).alias("x"), (a["y"] + (b["y"] - a["y"]) * share).alias("y"))
        return F.when(F.element_at(way, -1) == 0, q[0]).when(j >= F.size(q), F.element_at(q, -1)).otherwise(between)

    steps = F.sequence(F.lit(0), F.lit(n))
    return bound(points, lambda q: bound(arc_lengths(q), lambda way: F.transform(steps, lambda k: bound(k * F.element_at(way, -1) / n, lambda to: at(q, way, to)))))


def perimeter(points: Column) -> Column:
    """Sum of the sides and of the one that closes the polygon."""
    return F.aggregate(lengths(bound(points, lambda q: F.concat(q, F.array(q[0])))), F.lit(0.0), lambda a, x: a + x)


def area(points: Column) -> Column:
    """Area of a polygon, by the shoelace formula."""

    def crossed(ring: Column) -> Column:
        n = F.size(ring) - 1
        return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])

    ring = bound(points, lambda q: F.concat(q, F.array(q[0])))
    return F.abs(F.aggregate(bound(ring, crossed), F.lit(0.0), lambda a, x: a + x)) / 2


def circularity(points: Column) -> Column:
    """4 pi area by perimeter squared."""
    return bound(perimeter(points), lambda p: F.when(p > 0, 4 * 3.141592653589793 * area(points) / (p * p)))
