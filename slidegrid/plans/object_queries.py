"""Queries over objects: counts, viewports, lookups, choices, heatmaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidegrid import fixtures as fx
from slidegrid.fixtures import sql
from slidegrid.operators import counts, heatmap, sampling, spatial
from slidegrid.plans.registry import query, rounded, shared

LABEL_SQL = "CASE WHEN score < 0 THEN -1 ELSE 1 END"
HASH_SQL = "md5(concat('{seed}:', object_id))"


query("a1_slide_counts", sql("""SELECT s.name AS slide, count(o.object_id) FILTER (o.score >= 0) AS n_positive,
    count(o.object_id) FILTER (o.score < 0) AS n_negative FROM slides s LEFT JOIN objects o ON o.slide = s.name GROUP BY s.name""", "objects", "slides"))(
    lambda s, d: counts.slide_counts(fx.objects(s, d), fx.slides(s, d), counts.predicted_label(F.col("score"))))
CONFUSION = f"""SELECT count(*) FILTER (label = 1 AND p = 1) AS tp, count(*) FILTER (label = -1 AND p = 1) AS fp, count(*) FILTER (label = -1 AND p = -1) AS tn,
    count(*) FILTER (label = 1 AND p = -1) AS fn, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = -1) AS n
    FROM (SELECT label, {LABEL_SQL} AS p FROM objects)"""


def _confusion(s, d):
    return counts.confusion(fx.objects(s, d), F.col("label"), counts.predicted_label(F.col("score")))


query("a2_confusion", sql(CONFUSION, "objects"))(_confusion)
query("a3_rates", sql(f"""SELECT round(fp / nullif(n, 0), 6) AS fp_rate, round(tp / nullif(p, 0), 6) AS tp_rate, round(tp / nullif(tp + fp, 0), 6) AS precision,
    round((tp + tn) / nullif(p + n, 0), 6) AS accuracy FROM ({CONFUSION})""", "objects"))(lambda s, d: rounded(counts.rates(_confusion(s, d))))  # fmt: skip
query("a4_accuracy", sql(f"SELECT round(avg(CASE WHEN label = {LABEL_SQL} THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM objects", "objects"))(
    lambda s, d: rounded(counts.accuracy(fx.objects(s, d), F.col("label"), counts.predicted_label(F.col("score")))))
query("a5_class_counts", sql("SELECT label, count(*) AS n_samples, count(DISTINCT iteration) AS n_iterations FROM samples GROUP BY label", "samples"))(
    lambda s, d: counts.class_counts(fx.samples(s, d)))
query("a6_review_summary", sql("""SELECT count(DISTINCT slide) AS n_slides, count(*) AS n_total, count(*) FILTER (label = 1) AS n_positive,
    count(*) FILTER (label = -1) AS n_negative FROM samples""", "samples"))(lambda s, d: counts.review_summary(fx.samples(s, d)))  # fmt: skip
query("a7_review_groups", sql("SELECT slide, count(*) AS n, min(object_id) AS first_id, max(object_id) AS last_id FROM samples GROUP BY slide", "samples"))(
    lambda s, d: counts.review_groups(fx.samples(s, d)))
query("a8_picker_count", sql("SELECT count(*) AS n FROM samples", "samples"))(lambda s, d: fx.samples(s, d).agg(F.count("*").alias("n")))
query("a9_slide_offsets", sql("""SELECT slide, CAST(coalesce(sum(n) OVER (ORDER BY slide ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_index,
    n AS n_objects FROM (SELECT slide, count(*) AS n FROM objects GROUP BY slide)""", "objects"))(lambda s, d: counts.slide_offsets(fx.objects(s, d)))  # fmt: skip
query("a10_feature_moments", """SELECT CAST(dim - 1 AS INTEGER) AS dim, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std_dev
    FROM (SELECT generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY dim""")(
    lambda s, d: rounded(counts.feature_moments(fx.table(s, d, "embeddings"), "embedding")))
query("a11_class_priors", sql("SELECT label, round(count(*) / (SELECT count(*) FROM samples), 6) AS prior FROM samples GROUP BY label", "samples"))(
    lambda s, d: rounded(counts.class_priors(fx.samples(s, d))))
query("a25_vocabulary", sql("SELECT slide, CAST(row_number() OVER (ORDER BY slide) - 1 AS INTEGER) AS slide_index FROM (SELECT DISTINCT slide FROM objects)", "objects"))(
    lambda s, d: counts.vocabulary(fx.objects(s, d)))
query("a26_slide_weights", sql("SELECT slide, count(*) AS n, round(count(*) / (SELECT count(*) FROM samples), 6) AS weight FROM samples GROUP BY slide", "samples"))(
    lambda s, d: rounded(counts.slide_weights(fx.samples(s, d))))
query("a28_binary_columns", sql("""SELECT 'label' AS name, count(DISTINCT label) = 2 AS is_binary FROM objects UNION ALL SELECT 'flag', count(DISTINCT flag) = 2 FROM objects
    UNION ALL SELECT 'score', count(DISTINCT score) = 2 FROM objects""", "objects"))(lambda s, d: counts.binary_columns(fx.objects(s, d), ["label", "flag", "score"]))  # fmt: skip

# ---- projections
query("p8_viewports", sql("""SELECT v.view_id, o.object_id FROM objects o JOIN viewports v ON o.slide = v.slide AND o.x_centroid BETWEEN v.l AND v.r
    AND o.y_centroid BETWEEN v.t AND v.b""", "objects", "viewports"))(lambda s, d: spatial.in_views(fx.objects(s, d), fx.viewports(s, d)).select("view_id", "object_id"))  # fmt: skip
query("p8_one_viewport", sql("SELECT object_id, x_centroid, y_centroid FROM objects WHERE slide = 'S07' AND x_centroid BETWEEN 0 AND 800 AND y_centroid BETWEEN 100 AND 900", "objects"))(
    lambda s, d: spatial.in_view(fx.objects(s, d), "S07", 0, 100, 800, 900).select("object_id", "x_centroid", "y_centroid"))
query("p9_viewport_expansion", sql("SELECT view_id, slide, greatest(l - (r - l), 0) AS l, greatest(t - (b - t), 0) AS t, r + (r - l) AS r, b + (b - t) AS b FROM viewports", "viewports"))(
    lambda s, d: spatial.expanded(fx.viewports(s, d)))
MOVING = "view_id, l, t, r, b, (view_id % 4) / CAST(4 AS DOUBLE) AS zoom, CASE WHEN view_id % 5 > 0 THEN l - 250 END AS last_l, t - 10 AS last_t, CASE WHEN view_id % 5 > 0 THEN l + (view_id % 3) * 150 END AS last_r, b + 10 AS last_b"
query("p9_refetch", sql(f"""SELECT view_id, zoom > 0.5 AND NOT coalesce((l + r) / 2 BETWEEN last_l AND last_r AND (t + b) / 2 BETWEEN last_t AND last_b, false) AS fetch FROM (SELECT {MOVING} FROM viewports)""", "viewports"))(
    lambda s, d: spatial.to_fetch(fx.viewports(s, d).selectExpr(*fx.select_list(MOVING))))
KEY_SQL = "concat_ws('_', CAST(CAST(x_centroid AS DECIMAL(10,1)) AS VARCHAR), CAST(CAST(y_centroid AS DECIMAL(10,1)) AS VARCHAR))"
query("p11_centroid_key", sql(f"SELECT object_id, {KEY_SQL} AS key FROM objects", "objects"))(
    lambda s, d: fx.objects(s, d).select("object_id", spatial.centroid_key(F.col("x_centroid"), F.col("y_centroid")).alias("key")))
query("p10_object_shape", sql("SELECT object_id AS id, x_centroid AS cx, y_centroid AS cy, CASE WHEN label = -1 THEN 'lightgrey' ELSE 'lime' END AS colour FROM objects", "objects"))(
    lambda s, d: fx.objects(s, d).select(F.col("object_id").alias("id"), F.col("x_centroid").alias("cx"), F.col("y_centroid").alias("cy"), spatial.colour(spatial.class_code(F.col("label"))).alias("colour")))
query("p12_class_code", sql("SELECT object_id, CASE WHEN label = -1 THEN 0 ELSE 1 END AS code, CASE WHEN label = -1 THEN 'lightgrey' ELSE 'lime' END AS colour FROM objects", "objects"))(
    lambda s, d: fx.objects(s, d).select("object_id", spatial.class_code(F.col("label")).alias("code"), spatial.colour(spatial.class_code(F.col("label"))).alias("colour")))
query("p13_predicted_label", sql(f"SELECT object_id, {LABEL_SQL} AS predicted FROM objects", "objects"))(
    lambda s, d: fx.objects(s, d).select("object_id", counts.predicted_label(F.col("score")).alias("predicted")))
query("p14_probability", sql("SELECT object_id, round((score + 1) / 2, 6) AS probability, round(2 * ((score + 1) / 2) - 1, 6) AS back FROM objects", "objects"))(
    lambda s, d: rounded(fx.objects(s, d).select("object_id", ((F.col("score") + 1) / 2).alias("probability"), (2 * ((F.col("score") + 1) / 2) - 1).alias("back"))))
query("p17_thumbnails", sql("""SELECT object_id, round((x_centroid - 25 * scale) / x_size, 9) AS "left", round((y_centroid - 25 * scale) / y_size, 9) AS top,
    round(50.0 * scale / x_size, 9) AS width, round(50.0 * scale / y_size, 9) AS height FROM samples JOIN slides ON slide = name""", "samples", "slides"))(
    lambda s, d: rounded(spatial.thumbnails(fx.samples(s, d), fx.slides(s, d), 25), 9))
query("p18_slide_lookup", sql("SELECT name, x_size, y_size, pyramid_path FROM slides WHERE name = 'S03'", "slides"))(
    lambda s, d: fx.slides(s, d).where("name = 'S03'").select("name", "x_size", "y_size", "pyramid_path"))
query("p21_review_filter", sql("SELECT object_id, slide, label FROM samples WHERE slide = 'S05'", "samples"))(
    lambda s, d: fx.samples(s, d).where((F.lit("S05") == "All") | (F.col("slide") == "S05")).select("object_id", "slide", "label"))
query("f16_tile_grid", sql("SELECT name, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM (SELECT name, y_size, unnest(range(0, x_size, 512)) AS x FROM slides), unnest(range(0, y_size, 512)) AS u(y)", "slides"))(
    lambda s, d: spatial.tile_grid(fx.slides(s, d), 512))
query("f23_round_centroids", sql("SELECT object_id, CAST(x_centroid AS DECIMAL(10,1)) AS x, CAST(y_centroid AS DECIMAL(10,1)) AS y FROM objects", "objects"))(
    lambda s, d: fx.objects(s, d).select("object_id", F.col("x_centroid").cast("decimal(10,1)").alias("x"), F.col("y_centroid").cast("decimal(10,1)").alias("y")))

# ---- joins
FIRST_SQL = "(SELECT slide, CAST(x_centroid AS DECIMAL(10,1)) AS kx, CAST(y_centroid AS DECIMAL(10,1)) AS ky, min(object_id) AS object_id, count(*) AS n_same_key FROM objects GROUP BY ALL)"
ASKED_SQL = "(SELECT object_id AS sample_id, slide, x_centroid AS x, y_centroid + CASE WHEN iteration >= 8 THEN 0.1 ELSE 0 END AS y FROM samples)"


def _asked(s, d):
    return fx.samples(s, d).selectExpr("object_id AS sample_id", "slide", "x_centroid AS x", "y_centroid + CASE WHEN iteration >= 8 THEN 0.1D ELSE 0D END AS y")


MATCH_SQL = "f.slide = a.slide AND f.kx = CAST(a.x AS DECIMAL(10,1)) AND f.ky = CAST(a.y AS DECIMAL(10,1))"
query("j1_lookup", sql(f"SELECT a.sample_id, f.object_id, f.n_same_key FROM {ASKED_SQL} a JOIN {FIRST_SQL} f ON {MATCH_SQL}", "samples"))(
    lambda s, d: spatial.lookup(_asked(s, d), fx.objects(s, d)).select("sample_id", "object_id", "n_same_key"))
query("j2_unresolved", sql(f"SELECT a.sample_id, a.slide FROM {ASKED_SQL} a WHERE NOT EXISTS (SELECT 1 FROM {FIRST_SQL} f WHERE {MATCH_SQL})", "samples"))(
    lambda s, d: spatial.lookup(_asked(s, d), fx.objects(s, d), "left_anti").select("sample_id", "slide"))
query("j4_viewport_colours", sql(f"""SELECT o.object_id, o.slide, {KEY_SQL.replace("x_c", "o.x_c").replace("y_c", "o.y_c")} AS key, CASE p.code WHEN 0 THEN 'lightgrey' WHEN 1 THEN 'lime' ELSE 'aqua' END AS colour
    FROM objects o LEFT JOIN (SELECT slide, {KEY_SQL} AS key, max(CASE WHEN score < 0 THEN 0 ELSE 1 END) AS code FROM samples GROUP BY ALL) p
    ON o.slide = p.slide AND {KEY_SQL.replace("x_c", "o.x_c").replace("y_c", "o.y_c")} = p.key""", "samples"))(
    lambda s, d: spatial.coloured(fx.objects(s, d), fx.samples(s, d).groupBy("slide", spatial.centroid_key(F.col("x_centroid"), F.col("y_centroid")).alias("key")).agg(F.max(F.when(F.col("score") < 0, 0).otherwise(1)).alias("code"))))
query("j9_nearest", sql("""SELECT click_id, object_id, d2 AS distance2 FROM (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY d2, object_id) AS k FROM (
    SELECT c.click_id, o.object_id, round((o.x_centroid - c.x) * (o.x_centroid - c.x) + (o.y_centroid - c.y) * (o.y_centroid - c.y), 6) AS d2
    FROM clicks c JOIN objects o ON o.slide = c.slide AND abs(o.x_centroid - c.x) <= 10 AND abs(o.y_centroid - c.y) <= 10)) WHERE k = 1""", "objects", "clicks"))(
    lambda s, d: rounded(spatial.nearest(fx.clicks(s, d), fx.objects(s, d), 10.0)))
query("j9_nearest_region", sql("""SELECT click_id, object_id, d2 AS distance2 FROM (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY d2, object_id) AS k FROM (
    SELECT c.click_id, o.object_id, round((o.x_centroid - c.x) * (o.x_centroid - c.x) + (o.y_centroid - c.y) * (o.y_centroid - c.y), 6) AS d2
    FROM clicks c JOIN objects o ON o.slide = c.slide AND abs(o.x_centroid - c.x) <= 256 AND abs(o.y_centroid - c.y) <= 256)) WHERE k = 1""", "objects", "clicks"))(
    lambda s, d: rounded(spatial.nearest(fx.clicks(s, d), fx.objects(s, d), 256.0, 16.0)))
query("j10_unlabelled", sql("SELECT object_id, score FROM objects WHERE object_id NOT IN (SELECT object_id FROM samples)", "samples"))(
    lambda s, d: fx.objects(s, d).join(fx.samples(s, d).select("object_id"), "object_id", "left_anti").select("object_id", "score"))
query("j15_label_override", sql("""SELECT o.object_id, CASE WHEN e.n % 2 = 1 THEN -o.label ELSE o.label END AS label FROM objects o LEFT JOIN (
    SELECT object_id, count(*) AS n FROM (SELECT object_id FROM samples UNION ALL SELECT object_id FROM samples WHERE iteration < 3) GROUP BY object_id) e ON o.object_id = e.object_id""", "samples"))(
    lambda s, d: spatial.overridden(fx.objects(s, d), fx.samples(s, d).select("object_id").unionAll(fx.samples(s, d).where("iteration < 3").select("object_id"))))

# ---- choices
query("k1_most_uncertain", sql("SELECT object_id, score FROM objects ORDER BY abs(score), object_id LIMIT 1", "objects"))(lambda s, d: sampling.most_uncertain(fx.objects(s, d), 1))
query("k2_top_uncertain", sql("SELECT object_id, score FROM objects WHERE object_id NOT IN (SELECT object_id FROM samples) ORDER BY abs(score), object_id LIMIT 8", "samples"))(
    lambda s, d: sampling.most_uncertain(fx.objects(s, d).join(fx.samples(s, d), "object_id", "left_anti"), 8))
query("k3_tied_uncertain", sql(f"SELECT object_id, score_tied AS score FROM objects ORDER BY abs(score_tied), {HASH_SQL.format(seed=17)}, object_id LIMIT 8", "objects"))(
    lambda s, d: sampling.most_uncertain_or_any(fx.objects(s, d), 8, 17))
query("k4_weighted_uncertain", sql("""SELECT object_id, rank_by FROM (SELECT object_id, round(abs(score) + coalesce(w, 0), 9) AS rank_by FROM objects LEFT JOIN
    (SELECT slide, count(*) / (SELECT count(*) FROM samples) AS w FROM samples GROUP BY slide) USING (slide)) ORDER BY rank_by, object_id LIMIT 8""", "samples"))(
    lambda s, d: sampling.weighted_uncertain(fx.objects(s, d), counts.slide_weights(fx.samples(s, d)), 8))
query("k5_uncertain_of_share", sql(f"SELECT object_id, score FROM objects WHERE {HASH_SQL.format(seed=5)} < '{sampling.share_end(10)}' ORDER BY abs(score), object_id LIMIT 8", "objects"))(
    lambda s, d: sampling.uncertain_of_share(fx.objects(s, d), 8, 10, 5))
BIN_SQL = "CASE " + " ".join(f"WHEN score <= {e} THEN {i}" for i, e in enumerate(sampling.BIN_ENDS)) + " END"
query("k6_one_of_each_bin", sql(f"""SELECT a.asks AS score_bin, r.object_id, r.score FROM (SELECT asks, bin, row_number() OVER (PARTITION BY bin ORDER BY away, asks) AS k FROM (
      SELECT CAST(asks AS INTEGER) AS asks, min((bin - asks + 8) % 8) AS away, arg_min(bin, (bin - asks + 8) % 8) AS bin
      FROM range(8) t(asks), (SELECT DISTINCT {BIN_SQL} AS bin FROM objects) GROUP BY asks)) a
    JOIN (SELECT object_id, score, {BIN_SQL} AS bin, row_number() OVER (PARTITION BY {BIN_SQL} ORDER BY {HASH_SQL.format(seed=3)}, object_id) AS k FROM objects) r
    ON a.bin = r.bin AND a.k = r.k""", "objects"))(lambda s, d: sampling.one_of_each_bin(fx.objects(s, d), 3))  # fmt: skip
query("k7_random_objects", sql(f"SELECT object_id FROM objects ORDER BY {HASH_SQL.format(seed=11)}, object_id LIMIT 20", "objects"))(lambda s, d: sampling.random_objects(fx.objects(s, d), 20, 11))
STRATA_SQL = f"""SELECT class, CAST(stratum AS INTEGER) AS stratum, rank, object_id, score FROM (
      SELECT object_id, score, {LABEL_SQL} AS class, row_number() OVER (PARTITION BY {LABEL_SQL} ORDER BY score, object_id) - 1 AS rank FROM objects) o
    JOIN (SELECT class AS c, stratum, CASE WHEN stratum = 3 THEN greatest(n - 3, 0) ELSE CAST(floor(stratum * n / 3) AS BIGINT) END + k AS at
      FROM (SELECT {LABEL_SQL} AS class, count(*) AS n FROM objects GROUP BY 1), range(4) t(stratum), range(2) g(k)) p ON o.class = p.c AND o.rank = p.at"""
query("k8_strata", sql(STRATA_SQL, "objects"))(lambda s, d: sampling.strata(fx.objects(s, d), 4, 2))
query("w1_stratified_ranks", sql(STRATA_SQL.replace("stratum = 3", "stratum = 1").replace("n - 3", "n - 5").replace("n / 3", "n / 1").replace("range(4)", "range(2)").replace("range(2) g", "range(4) g"), "objects"))(
    lambda s, d: sampling.strata(fx.objects(s, d), 2, 4))

# ---- heatmaps
CELLS_SQL = """SELECT slide, CAST(ceil(x_centroid / 40) AS INTEGER) AS cx, CAST(ceil(y_centroid / 40) AS INTEGER) AS cy, max(1 - abs(score)) AS uncertainty,
    avg(CASE WHEN score >= 0 THEN 1.0 ELSE 0.0 END) AS positive, count(*) AS density FROM objects GROUP BY 1, 2, 3"""
query("a19_heatmap_cells", sql(f"SELECT slide, cx, cy, round(uncertainty, 6) AS uncertainty, round(positive, 6) AS positive, density FROM ({CELLS_SQL})", "objects"))(
    lambda s, d: rounded(heatmap.cells(fx.objects(s, d))))
MEDIAN_SQL = "SELECT slide, u AS median FROM (SELECT slide, round(1 - abs(score), 6) AS u, row_number() OVER (PARTITION BY slide ORDER BY 1 - abs(score)) AS k, count(*) OVER (PARTITION BY slide) AS n FROM objects) WHERE k = n // 2 + 1"
query("a21_upper_median", sql(MEDIAN_SQL, "objects"))(lambda s, d: rounded(heatmap.upper_medians(fx.objects(s, d))))
query("a20_region_cells", sql(f"""SELECT slide, CAST(ceil(x_centroid / 40) AS INTEGER) AS cx, CAST(ceil(y_centroid / 40) AS INTEGER) AS cy,
    round(avg(CASE WHEN round(1 - abs(score), 6) > median THEN 1.0 ELSE 0.0 END), 6) AS uncertain_share, round(avg(CASE WHEN score >= 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_share
    FROM objects JOIN ({MEDIAN_SQL}) USING (slide) GROUP BY 1, 2, 3""", "objects"))(lambda s, d: rounded(heatmap.region_cells(fx.objects(s, d))))  # fmt: skip
KERNEL_SQL = "SELECT CAST(i - 19 AS INTEGER) AS o, exp(-((i - 19) * (i - 19)) / 24.5) / (SELECT sum(exp(-((j - 19) * (j - 19)) / 24.5)) FROM range(39) q(j)) AS w FROM range(39) t(i)"
MIRROR = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > {1} - 1 THEN 2 * ({1} - 1) - ({0}) ELSE {0} END"
BLUR_SQL = f"""WITH kernel AS ({KERNEL_SQL}), cells AS ({CELLS_SQL}),
    dense AS (SELECT g.slide, g.cx, g.cy, g.nx, g.ny, coalesce(c.uncertainty, 0) AS u, coalesce(c.positive, 0) AS p FROM (
      SELECT slide, CAST(x AS INTEGER) AS cx, CAST(y AS INTEGER) AS cy, nx, ny FROM (SELECT name AS slide, x_size // 40 + 1 AS nx, y_size // 40 + 1 AS ny FROM slides), range(0, 51) a(x), range(0, 41) b(y)) g
      LEFT JOIN cells c ON c.slide = g.slide AND c.cx = g.cx AND c.cy = g.cy),
    rows_ AS (SELECT t.slide, t.cx, t.cy, t.ny, sum(k.w * d.u) AS u, sum(k.w * d.p) AS p FROM dense t, kernel k JOIN dense d ON d.slide = t.slide AND d.cy = t.cy AND d.cx = {MIRROR.format("t.cx + k.o", "t.nx")} GROUP BY ALL)
    SELECT t.slide, t.cx, t.cy, sum(k.w * d.u) AS uncertainty, sum(k.w * d.p) AS positive FROM rows_ t, kernel k JOIN rows_ d ON d.slide = t.slide AND d.cx = t.cx AND d.cy = {MIRROR.format("t.cy + k.o", "t.ny")} GROUP BY t.slide, t.cx, t.cy"""


def _blurred(s, d):
    return heatmap.blurred(heatmap.cells(fx.objects(s, d)), fx.slides(s, d))


query("w5_blur", sql(f"SELECT slide, cx, cy, round(uncertainty, 6) AS uncertainty, round(positive, 6) AS positive FROM ({BLUR_SQL})", "objects", "slides"))(lambda s, d: rounded(_blurred(s, d)))
RANGES_SQL = f"SELECT slide, min(uncertainty) AS u_min, max(uncertainty) AS u_max, min(positive) AS p_min, max(positive) AS p_max FROM ({BLUR_SQL}) GROUP BY slide"
query("a22_blurred_ranges", sql(f"SELECT slide, round(u_min, 6) AS u_min, round(u_max, 6) AS u_max, round(p_min, 6) AS p_min, round(p_max, 6) AS p_max FROM ({RANGES_SQL})", "objects", "slides"))(
    lambda s, d: rounded(heatmap.ranges(_blurred(s, d))))
NORM_SQL = f"""SELECT slide, min(bin) / 20 AS norm FROM (SELECT slide, bin, sum(c) OVER (PARTITION BY slide ORDER BY bin) AS upto, sum(c) OVER (PARTITION BY slide) AS n FROM (
    SELECT slide, CASE WHEN u_max = u_min THEN 0 ELSE least(floor(round(uncertainty / (u_max - u_min) * 20, 9)), 19) END AS bin, count(*) AS c FROM ({BLUR_SQL}) JOIN ({RANGES_SQL}) USING (slide) GROUP BY 1, 2))
    WHERE upto > 0.9 * n GROUP BY slide"""
query("a23_normalizer", sql(f"SELECT slide, round(norm, 6) AS norm FROM ({NORM_SQL})", "objects", "slides"))(lambda s, d: rounded(heatmap.normalizers(_blurred(s, d))))
GRAY_SQL = f"""SELECT slide, cx, cy, round(CASE WHEN norm > 0 THEN least(255.0, 255 * uncertainty / norm) ELSE 0 END, 4) AS u_gray, round(CASE WHEN p_max > 0 THEN 255 * positive / p_max ELSE 0 END, 4) AS p_gray
    FROM ({BLUR_SQL}) JOIN ({NORM_SQL}) USING (slide) JOIN ({RANGES_SQL}) USING (slide)"""
query("f17_gray_levels", sql(GRAY_SQL, "objects", "slides"))(lambda s, d: rounded(heatmap.gray(_blurred(s, d)), 4))
query("k10_ranked_slides", sql(f"SELECT slide, round(u_max, 6) AS u_max FROM ({RANGES_SQL})", "objects", "slides"))(lambda s, d: rounded(heatmap.ranked(_blurred(s, d))))


def _heatmap_set(s, d):
    """Made for all slides at iteration 3; a second call at the same iteration reads them, as a call at another would make them anew."""
    path = shared(s, "heatmaps")
    heatmap.heatmap_set(s, path, 3, lambda: heatmap.gray(_blurred(s, d)))
    return heatmap.heatmap_set(s, path, 3, lambda: heatmap.gray(_blurred(s, d).where("false")))


query("l12_heatmap_set", sql(GRAY_SQL, "objects", "slides"))(lambda s, d: rounded(_heatmap_set(s, d), 4))
