"""Queries over pixel tables and shapes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from slidegrid import fixtures as fx
from slidegrid.fixtures import sql
from slidegrid.operators import pixels as px
from slidegrid.operators import spatial
from slidegrid.plans.registry import query, rounded
from slidegrid.plans.table_queries import POINTS

ROUND = lambda columns, n=6: ", ".join(f"round({x}, {n}) AS {x}" for x in columns.split())
OD = "(-255 * ln(greatest({0}, 1) / 255.0) / ln(255.0))"


def line(columns, weights):
    return "(" + " + ".join(f"{c} * {float(w)!r}" for c, w in zip(columns, weights, strict=False)) + (f" + {weights[len(columns)]!r}" if len(weights) > len(columns) else "") + ")"


query("f8_optical_density", sql(f"SELECT tile_id, x, y, round({OD.format('r')}, 6) AS od, round(exp(-({OD.format('r')} - 255) * ln(255.0) / 255), 6) AS back FROM pixels", "pixels"))(
    lambda s, d: rounded(fx.pixels(s, d).select("tile_id", "x", "y", px.density(F.col("r")).alias("od"), px.intensity(px.density(F.col("r"))).alias("back"))))
INV, MIX = np.linalg.inv(px.stain_matrix()).tolist(), px.stain_matrix().tolist()
UNMIX = "SELECT tile_id, x, y, " + ", ".join(f"{line([OD.format(c) for c in 'rgb'], INV[k])} AS stain{k + 1}" for k in range(3)) + " FROM pixels"
query("f9_unmix_stains", sql(f"SELECT tile_id, x, y, {ROUND('stain1 stain2 stain3', 4)} FROM ({UNMIX})", "pixels"))(lambda s, d: rounded(px.unmixed(fx.pixels(s, d)), 4))
query("f9_stain_intensities", sql("SELECT tile_id, x, y, " + ", ".join(f"round(exp(-(stain{k} - 255) * ln(255.0) / 255), 4) AS stain{k}" for k in (1, 2, 3)) + f" FROM ({UNMIX})", "pixels"))(
    lambda s, d: rounded(px.stain_intensities(px.unmixed(fx.pixels(s, d))), 4))
query("f10_remix_stains", sql("SELECT tile_id, x, y, " + ", ".join(f"round(exp(-({line(['stain1', 'stain2', 'stain3'], MIX[k])} - 255) * ln(255.0) / 255), 4) AS {c}" for k, c in enumerate("rgb")) + f" FROM ({UNMIX})", "pixels"))(
    lambda s, d: rounded(px.remixed(px.unmixed(fx.pixels(s, d))), 4))
TISSUE = f"{line('rgb', px.TISSUE[0])} < {line('rgb', px.TISSUE[1])}"
query("f11_tissue", sql(f"SELECT tile_id, x, y, {TISSUE} AS tissue FROM pixels", "pixels"))(lambda s, d: fx.pixels(s, d).select("tile_id", "x", "y", px.is_tissue().alias("tissue")))
LOGS = ", ".join(f"CASE WHEN {line('rgb', row)} > 0 THEN log10({line('rgb', row)}) END AS {n}" for row, n in zip(px.RGB_TO_LMS, ("l1", "l2", "l3"), strict=True))
LAB = f"SELECT *, (l1 + l2 + l3) / sqrt(3) AS l, (l1 + l2 - 2 * l3) / sqrt(6) AS a, (l1 - l2) / sqrt(2) AS bb FROM (SELECT *, {LOGS}, {TISSUE} AS tissue FROM pixels)"
query("f12_opponent_colours", sql(f"SELECT tile_id, x, y, round(l, 6) AS l, round(a, 6) AS a, round(bb, 6) AS b FROM ({LAB})", "pixels"))(lambda s, d: rounded(px.opponent(fx.pixels(s, d), ["tile_id", "x", "y"])))
STATS = f"SELECT tile_id, avg(l) AS l_mean, stddev_samp(l) AS l_std, avg(a) AS a_mean, stddev_samp(a) AS a_std, avg(bb) AS b_mean, stddev_samp(bb) AS b_std FROM ({LAB}) WHERE tissue AND l IS NOT NULL GROUP BY tile_id"
query("a18_colour_statistics", sql(f"SELECT tile_id, {ROUND('l_mean l_std a_mean a_std b_mean b_std')} FROM ({STATS})", "pixels"))(lambda s, d: rounded(px.colour_statistics(fx.pixels(s, d))))
TARGET = {"l": (3.2, 0.3), "a": (0.02, 0.05), "b": (0.03, 0.04)}
MOVED = "(({0} - {1}_mean) * ({3} / nullif({1}_std, 0)) + {2})"
NEW = {c: MOVED.format("bb" if c == "b" else c, c, *TARGET[c]) for c in "lab"}
LMS = [f"pow(10, {NEW['l']} / sqrt(3) + {NEW['a']} / sqrt(6) + {NEW['b']} / sqrt(2))", f"pow(10, {NEW['l']} / sqrt(3) + {NEW['a']} / sqrt(6) - {NEW['b']} / sqrt(2))", f"pow(10, {NEW['l']} / sqrt(3) - 2 * {NEW['a']} / sqrt(6))"]
query("f13_colour_transfer", sql("SELECT tile_id, x, y, " + ", ".join(f"round(CASE WHEN tissue THEN coalesce({line(LMS, row)}, {c}) ELSE {c} END, 3) AS {c}" for row, c in zip(px.LMS_TO_RGB, "rgb", strict=True)) + f" FROM ({LAB}) LEFT JOIN ({STATS}) USING (tile_id)", "pixels"))(
    lambda s, d: rounded(px.transferred(fx.pixels(s, d), TARGET), 3))
query("f14_green_ratio", sql("SELECT tile_id, x, y, round(g / nullif(r + g + b, 0), 6) AS ratio FROM pixels", "pixels"))(lambda s, d: rounded(fx.pixels(s, d).select("tile_id", "x", "y", px.green_ratio().alias("ratio"))))
query("f15_rings", sql("""SELECT DISTINCT o.tile_id, o.label, n.x, n.y FROM pixels o JOIN pixels n ON o.tile_id = n.tile_id AND abs(o.x - n.x) <= 8 AND abs(o.y - n.y) <= 8
    AND (o.x - n.x) * (o.x - n.x) + (o.y - n.y) * (o.y - n.y) <= 64 WHERE o.label > 0 AND n.label = 0""", "pixels"))(lambda s, d: px.rings(fx.pixels(s, d)))  # fmt: skip
SHAPE = """SELECT *, sqrt(greatest(1 - (minor / major) * (minor / major), 0)) AS eccentricity FROM (SELECT *, 2 * sqrt(2 * (xx + yy + root)) AS major, 2 * sqrt(2 * greatest(xx + yy - root, 0)) AS minor FROM (
    SELECT *, sqrt((xx - yy) * (xx - yy) + 4 * xy * xy) AS root FROM (SELECT tile_id, label, count(*) AS area, avg(x) AS cx, avg(y) AS cy, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1,
    var_pop(x) + 1.0 / 12 AS xx, var_pop(y) + 1.0 / 12 AS yy, covar_pop(x, y) AS xy, count(*) / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1)) AS extent FROM pixels WHERE label > 0 GROUP BY tile_id, label)))"""
query("a12_morphometry", sql(f"SELECT tile_id, label, area, {ROUND('cx cy')}, x0, y0, x1, y1, {ROUND('extent major minor eccentricity')} FROM ({SHAPE})", "pixels"))(lambda s, d: rounded(px.morphometry(fx.pixels(s, d))))
query("p15_area_filter", sql(f"SELECT tile_id, label, area FROM ({SHAPE}) WHERE area > 30 AND area < 1000", "pixels"))(lambda s, d: px.of_area(px.morphometry(fx.pixels(s, d)), 30).select("tile_id", "label", "area"))
query("a15_intensity_group", sql("SELECT tile_id, label, round(avg(r), 6) AS mean, round(avg(r) - median(r), 6) AS mean_median, max(r) AS max, min(r) AS min, round(stddev_samp(r), 6) AS std FROM pixels WHERE label > 0 GROUP BY 1, 2", "pixels"))(
    lambda s, d: rounded(px.intensities(fx.pixels(s, d), "r")))
TEXTURE = """SELECT tile_id, label, entropy, energy, (s3 / n - 3 * m * s2 / n + 2 * m * m * m) / pow(s2 / n - m * m, 1.5) AS skewness, (s4 / n - 4 * m * s3 / n + 6 * m * m * s2 / n - 3 * m * m * m * m) / pow(s2 / n - m * m, 2) AS kurtosis FROM (
    SELECT tile_id, label, count(*) AS n, avg(v) AS m, sum(v * v) AS s2, sum(v * v * v) AS s3, sum(v * v * v * v) AS s4 FROM ({0}) GROUP BY tile_id, label) JOIN (
    SELECT tile_id, label, -sum(c / t * log2(c / t)) AS entropy, sum((c / t) * (c / t)) AS energy FROM (SELECT tile_id, label, bin, count(*) AS c, sum(count(*)) OVER (PARTITION BY tile_id, label) AS t
    FROM (SELECT tile_id, label, CAST(least(greatest(round(v), 0), 255) AS INTEGER) AS bin FROM ({0})) GROUP BY tile_id, label, bin) GROUP BY tile_id, label) USING (tile_id, label)"""
RED = "SELECT tile_id, label, CAST(r AS DOUBLE) AS v FROM pixels WHERE label > 0"
query("a16_texture_group", sql(f"SELECT tile_id, label, {ROUND('entropy energy skewness kurtosis', 5)} FROM ({TEXTURE.format(RED)})", "pixels"))(lambda s, d: rounded(px.textures(fx.pixels(s, d), "r"), 5))
WAY = "CASE WHEN {p} IS NULL THEN {n} - r WHEN {n} IS NULL THEN r - {p} ELSE ({n} - {p}) / 2.0 END"
GRAD = f"""SELECT *, sqrt(gx * gx + gy * gy) AS magnitude FROM (SELECT *, {WAY.format(p="px_", n="nx_")} AS gx, {WAY.format(p="py_", n="ny_")} AS gy FROM (SELECT *, lag(r) OVER h AS px_, lead(r) OVER h AS nx_, lag(r) OVER v AS py_, lead(r) OVER v AS ny_
    FROM pixels WINDOW h AS (PARTITION BY tile_id, y ORDER BY x), v AS (PARTITION BY tile_id, x ORDER BY y)))"""
query("w6_gradient", sql(f"SELECT tile_id, x, y, label, {ROUND('gx gy magnitude')} FROM ({GRAD})", "pixels"))(lambda s, d: rounded(px.gradient(fx.pixels(s, d), "r")))
GV = f"SELECT tile_id, label, magnitude AS v FROM ({GRAD}) WHERE label > 0"
GROUP = f"SELECT * FROM ({TEXTURE.format(GV)}) JOIN (SELECT tile_id, label, avg(v) AS mean, stddev_samp(v) AS std FROM ({GV}) GROUP BY tile_id, label) USING (tile_id, label)"
query("a17_gradient_group", sql(f"SELECT tile_id, label, {ROUND('mean std entropy energy skewness kurtosis', 4)} FROM ({GROUP})", "pixels"))(lambda s, d: rounded(px.gradients(fx.pixels(s, d), "r"), 4))
# ---- object vectors: both stains as intensities, their groups over objects and rings
STAIN = {n: f"least(exp(-({line([OD.format(c) for c in 'rgb'], INV[k])} - 255) * ln(255.0) / 255), 255.0)" for k, n in enumerate(("hematoxylin", "eosin"))}
STAINS = f"SELECT tile_id, x, y, label, {STAIN['hematoxylin']} AS hematoxylin, {STAIN['eosin']} AS eosin FROM pixels"
RING = """SELECT DISTINCT o.tile_id, o.label, n.x, n.y FROM pixels o JOIN pixels n ON o.tile_id = n.tile_id AND abs(o.x - n.x) <= 8 AND abs(o.y - n.y) <= 8
    AND (o.x - n.x) * (o.x - n.x) + (o.y - n.y) * (o.y - n.y) <= 64 WHERE o.label > 0 AND n.label = 0"""


def stain_sql(value: str, of: str) -> str:
    """Intensity, texture and gradient groups of a stain over the rows tile_id, label, x, y of `of`."""
    slopes = GRAD.replace("FROM pixels", f"FROM (SELECT tile_id, x, y, label, {value} AS r FROM ({STAINS}))")
    v = f"SELECT o.tile_id, o.label, s.{value} AS v FROM ({of}) o JOIN ({STAINS}) s ON o.tile_id = s.tile_id AND o.x = s.x AND o.y = s.y"
    g = f"SELECT o.tile_id, o.label, s.magnitude AS v FROM ({of}) o JOIN ({slopes}) s ON o.tile_id = s.tile_id AND o.x = s.x AND o.y = s.y"
    return f"""SELECT tile_id, label, list_transform([i.mean, i.mm, i.mx, i.mn, i.std, t.entropy, t.energy, t.skewness, t.kurtosis, j.mean, j.std, u.entropy, u.energy, u.skewness, u.kurtosis], lambda z: round(z, 4)) AS values
      FROM (SELECT tile_id, label, avg(v) AS mean, avg(v) - median(v) AS mm, max(v) AS mx, min(v) AS mn, stddev_samp(v) AS std FROM ({v}) GROUP BY 1, 2) i JOIN ({TEXTURE.format(v)}) t USING (tile_id, label)
      JOIN (SELECT tile_id, label, avg(v) AS mean, stddev_samp(v) AS std FROM ({g}) GROUP BY 1, 2) j USING (tile_id, label) JOIN ({TEXTURE.format(g)}) u USING (tile_id, label)"""


def four_places(df):
    return df.select("tile_id", "label", F.transform("values", lambda v: F.round(v, 4) + F.lit(0.0)).alias("values"))


query("f27_nuclear_values", sql(stain_sql("hematoxylin", "SELECT tile_id, label, x, y FROM pixels WHERE label > 0"), "pixels"))(lambda s, d: four_places(px.nuclear_values(fx.pixels(s, d))))
query("f27_cytoplasm_values", sql(stain_sql("eosin", RING), "pixels"))(lambda s, d: four_places(px.cytoplasm_values(fx.pixels(s, d))))
query("a17_edge_group")(lambda s, d: px.edge_group(fx.pixels(s, d)))
query("f27_object_vectors")(lambda s, d: px.vectors(fx.pixels(s, d)))
query("a14_solidity")(lambda s, d: px.solidity(fx.pixels(s, d)))
query("f7_fourier_shapes")(lambda s, d: px.fourier_shapes(fx.boundaries(s, d)))
REACH = 64
REACHING = f"""SELECT v.view_id, v.l, v.t, v.r, v.b, o.object_id, o.score, {POINTS} AS p FROM boundaries n JOIN objects o USING (object_id)
    JOIN viewports v ON n.slide = v.slide AND n.x_centroid BETWEEN v.l - {REACH} AND v.r + {REACH} AND n.y_centroid BETWEEN v.t - {REACH} AND v.b + {REACH}"""
EDGES = f"""SELECT * EXCLUDE (p), p[i].x AS x0, p[i].y AS y0, p[i % len(p) + 1].x AS x1, p[i % len(p) + 1].y AS y1 FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM ({REACHING}))"""
CUTS = f"""SELECT view_id, object_id, any_value(score) AS score, any_value(l) AS l, any_value(r) AS r, y, list((x1 - x0) * (y - y0) / (y1 - y0) + x0) AS cut
    FROM (SELECT *, unnest(range(CAST(least(y0, y1) AS INTEGER), CAST(greatest(y0, y1) AS INTEGER) + 1)) AS y FROM ({EDGES})) WHERE (y0 > y) <> (y1 > y) AND y BETWEEN t AND b GROUP BY view_id, object_id, y"""
FILLED = f"""SELECT view_id, x, y, arg_max(score, object_id) AS score FROM (SELECT *, unnest(range(CAST(ceil(greatest(list_min(cut), l)) AS INTEGER), CAST(floor(least(list_max(cut), r)) AS INTEGER) + 1)) AS x FROM ({CUTS}))
    WHERE len(list_filter(cut, lambda c: c > x)) % 2 = 1 GROUP BY view_id, x, y"""
query("f24_score_mask", sql(f"""SELECT view_id, CAST(d.x AS INTEGER) AS x, CAST(d.y AS INTEGER) AS y, coalesce(f.score, 7.0) AS score FROM (SELECT view_id, x, unnest(range(CAST(t AS INTEGER), CAST(b AS INTEGER) + 1)) AS y
    FROM (SELECT *, unnest(range(CAST(l AS INTEGER), CAST(r AS INTEGER) + 1)) AS x FROM viewports WHERE view_id IN (SELECT view_id FROM ({REACHING})))) d LEFT JOIN ({FILLED}) f USING (view_id, x, y)""", "objects", "boundaries", "viewports"))(
    lambda s, d: px.score_mask(reaching(s, d)))


def reaching(s, d):
    """Objects whose polygons can reach into a view: the view's box is enlarged to find them, and its own borders stay."""
    views = fx.viewports(s, d)
    wide = views.selectExpr("view_id", "slide", f"l - {REACH} AS l", f"t - {REACH} AS t", f"r + {REACH} AS r", f"b + {REACH} AS b")
    found = spatial.in_views(fx.boundaries(s, d), wide).select("view_id", "object_id", "boundary")
    return found.join(fx.objects(s, d).select("object_id", "score"), "object_id").join(F.broadcast(views.drop("slide")), "view_id")
