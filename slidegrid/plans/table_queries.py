"""Queries over label tables, the catalog, survival tables and boundaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidegrid import fixtures as fx
from slidegrid.fixtures import sql
from slidegrid.functions import boundaries as b
from slidegrid.operators import catalog, labels, spatial, survival
from slidegrid.plans.registry import query, rounded, shared
from slidegrid.sources import files

# ---- labels
SUBMITTED = "SELECT object_id, -label AS label, iteration > 5 AS picked FROM objects WHERE iteration >= 9 UNION ALL SELECT -object_id, 1, false FROM objects WHERE iteration = 10"


def _submitted(s, d):
    o = fx.objects(s, d)
    return o.where("iteration >= 9").selectExpr("object_id", "-label AS label", "iteration > 5 AS picked").unionAll(o.where("iteration = 10").selectExpr("-object_id", "1", "false"))


query("m1_append_labels", sql(f"""SELECT object_id, label, iteration FROM samples UNION ALL SELECT object_id, label, CASE WHEN picked THEN -11 ELSE 11 END FROM ({SUBMITTED})
    WHERE object_id IN (SELECT object_id FROM objects)""", "samples"))(lambda s, d: labels.appended(fx.samples(s, d), _submitted(s, d), fx.objects(s, d), 11))  # fmt: skip
query("m2_in_training", sql("SELECT object_id, label FROM samples WHERE label <> 0", "samples"))(lambda s, d: labels.in_training(fx.samples(s, d)).select("object_id", "label"))
EDITS = "(SELECT object_id, -label AS label, 1 AS seq FROM samples WHERE iteration < 5 UNION ALL SELECT object_id, 1, 2 FROM samples WHERE iteration < 2 OR iteration = 10)"


def _edits(s, d):
    x = fx.samples(s, d)
    return x.where("iteration < 5").selectExpr("object_id", "-label AS label", "1 AS seq").unionAll(x.where("iteration < 2 OR iteration = 10").selectExpr("object_id", "1", "2"))


RELABELLED = f"SELECT s.object_id, coalesce(e.label, s.label) AS label, e.label IS NOT NULL AS changed FROM samples s LEFT JOIN (SELECT object_id, arg_max(label, seq) AS label FROM {EDITS} GROUP BY object_id) e USING (object_id)"
query("m3_relabel", sql(RELABELLED, "samples"))(lambda s, d: labels.relabelled(fx.samples(s, d), _edits(s, d)))
query("m3_relabel_count", sql(f"SELECT count(*) FILTER (changed) AS n_updated FROM ({RELABELLED})", "samples"))(
    lambda s, d: labels.relabelled(fx.samples(s, d), _edits(s, d)).agg(F.count_if("changed").alias("n_updated")))
query("m4_back_in_training", sql(f"SELECT r.object_id, r.label FROM ({RELABELLED}) r JOIN samples s USING (object_id) WHERE s.label = 0 AND r.label <> 0", "samples"))(
    lambda s, d: labels.in_training(labels.relabelled(fx.samples(s, d).where("label = 0"), _edits(s, d))).select("object_id", "label"))
query("m5_remove_duplicates", sql("SELECT DISTINCT l_orderkey, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS l_linenumber FROM lineitem"))(
    lambda s, d: labels.without_duplicates(fx.table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber"))
KEYED = "SELECT object_id, slide, CAST(x_centroid AS DECIMAL(10,1)) AS kx, CAST(y_centroid AS DECIMAL(10,1)) AS ky FROM samples"
query("m6_reject_duplicates", sql(f"SELECT slide, kx, ky, min(object_id) AS object_id FROM ({KEYED}) GROUP BY slide, kx, ky", "samples"))(
    lambda s, d: labels.without_duplicates(fx.samples(s, d).selectExpr("object_id", "slide", "CAST(x_centroid AS DECIMAL(10,1)) AS kx", "CAST(y_centroid AS DECIMAL(10,1)) AS ky"), ["slide", "kx", "ky"], "object_id"))
query("m7_priming", sql("SELECT label, count(*) AS n, count(*) >= 4 AS complete FROM samples WHERE label <> 0 GROUP BY label", "samples"))(lambda s, d: labels.priming_complete(fx.samples(s, d)))
query("m8_finalize_ids", sql("""SELECT object_id, (SELECT max(set_id) FROM training_sets) + row_number() OVER (ORDER BY object_id) AS set_id FROM samples""", "samples", "training_sets"))(
    lambda s, d: labels.numbered(fx.samples(s, d).select("object_id"), "object_id", fx.training_sets(s, d), "set_id"))
query("m9_upsert", sql("SELECT object_id, coalesce(n.label, o.label) AS label FROM (SELECT object_id, label FROM samples) o FULL JOIN (SELECT object_id, -label AS label FROM objects WHERE iteration <= 4) n USING (object_id)", "samples"))(
    lambda s, d: labels.upserted(fx.samples(s, d).select("object_id", "label"), fx.objects(s, d).where("iteration <= 4").selectExpr("object_id", "-label AS label"), "object_id", "label"))
query("m10_save_test_set", sql("SELECT set_id, name FROM training_sets UNION ALL SELECT dataset_id + 1000000, name FROM datasets", "training_sets", "datasets"))(
    lambda s, d: catalog.saved(fx.training_sets(s, d).select("set_id", "name"), fx.datasets(s, d).selectExpr("dataset_id + 1000000 AS set_id", "name")))
query("m11_new_datasets", sql("SELECT n_name AS name FROM nation WHERE n_name NOT IN (SELECT name FROM datasets)", "datasets"))(
    lambda s, d: labels.created(fx.datasets(s, d), fx.table(s, d, "nation").selectExpr("n_name AS name"), "name"))
query("m12_delete_cascade", sql("""SELECT t.set_id, count(o.object_id) AS n FROM training_sets t JOIN training_objs o USING (set_id) WHERE t.dataset_id <> 2 GROUP BY t.set_id""", "training_sets", "training_objs"))(
    lambda s, d: (lambda sets: labels.cascaded(fx.training_objs(s, d), sets, sets.where("dataset_id = 2").select("set_id"), "set_id"))(fx.training_sets(s, d))[0].groupBy("set_id").agg(F.count("object_id").alias("n")))
query("m13_replace_boundaries", sql("""SELECT object_id, slide, boundary FROM boundaries WHERE slide NOT IN ('S01', 'S02') UNION ALL
    SELECT object_id, slide, concat(boundary, ' 0,0') FROM boundaries WHERE slide IN ('S01', 'S02')""", "boundaries"))(
    lambda s, d: labels.replaced(fx.boundaries(s, d).select("object_id", "slide", "boundary"), fx.boundaries(s, d).where("slide IN ('S01', 'S02')").selectExpr("object_id", "slide", "concat(boundary, ' 0,0') AS boundary"), "slide"))
query("m14_picker_add", sql("SELECT object_id, label, x_centroid AS x_click, y_centroid AS y_click FROM samples", "samples"))(
    lambda s, d: catalog.picked(fx.samples(s, d), fx.objects(s, d)))
query("m15_mark_selected", sql("SELECT object_id, object_id IN (SELECT object_id FROM samples) AS selected FROM objects WHERE slide = 'S04'", "samples"))(
    lambda s, d: labels.marked(fx.objects(s, d).where("slide = 'S04'"), fx.samples(s, d)))
query("m16_cancel_session", sql("""SELECT event_id, uid FROM requests
    WHERE uid NOT IN (SELECT uid FROM requests WHERE command = 'purchase' AND uid % 2 = 0)""", "requests"))(
    lambda s, d: catalog.without_sessions(fx.requests(s, d), fx.requests(s, d).where("command = 'purchase' AND uid % 2 = 0")).select("event_id", "uid"))
query("m17_running_index", sql("SELECT object_id, row_number() OVER (ORDER BY object_id) AS row_id FROM objects", "objects"))(
    lambda s, d: labels.numbered(fx.objects(s, d).select("object_id"), "object_id", s.range(0).selectExpr("id AS row_id"), "row_id"))

# ---- catalog
query("j3_enrich_samples", sql("""SELECT s.object_id, l.x_size, l.y_size, l.scale, l.pyramid_path, b.boundary FROM samples s JOIN slides l ON s.slide = l.name
    LEFT JOIN boundaries b ON b.slide = s.slide AND b.object_id = s.object_id""", "samples", "slides", "boundaries"))(
    lambda s, d: catalog.enriched(fx.samples(s, d), fx.slides(s, d), fx.boundaries(s, d))
    .select("object_id", "x_size", "y_size", "scale", "pyramid_path", "boundary"))
query("j5_dataset_slides", sql("""SELECT s.name, s.pyramid_path FROM slides s JOIN dataset_slides d ON s.name = d.slide JOIN datasets a USING (dataset_id)
    WHERE a.name = 'ASIA' ORDER BY 1""", "slides", "dataset_slides", "datasets"))(
    lambda s, d: catalog.slides_of("ASIA", fx.datasets(s, d), fx.dataset_slides(s, d), fx.slides(s, d)).select("name", "pyramid_path"))
query("j6_training_sets", sql("SELECT t.set_id, t.name, a.name AS dataset FROM training_sets t JOIN datasets a USING (dataset_id)", "training_sets", "datasets"))(
    lambda s, d: catalog.sets_with_datasets(fx.training_sets(s, d), fx.datasets(s, d)).select("set_id", "name", "dataset"))
query("j7_set_classes", sql("""SELECT DISTINCT set_id, label, CASE label WHEN 1 THEN 'positive' ELSE 'negative' END AS class
    FROM training_objs ORDER BY label""", "training_objs"))(lambda s, d: catalog.classes_of_sets(fx.training_objs(s, d)))  # fmt: skip
query("j8_boundaries_of_list", sql("""SELECT b.object_id, b.boundary FROM boundaries b
    JOIN (SELECT object_id, slide FROM samples WHERE iteration = 7) USING (slide, object_id)""", "samples", "boundaries"))(
    lambda s, d: catalog.boundaries_of(fx.samples(s, d).where("iteration = 7"), fx.boundaries(s, d)).select("object_id", "boundary"))
query("j11_new_slides", sql("SELECT name FROM slides WHERE name NOT IN (SELECT slide FROM dataset_slides WHERE dataset_id < 3)", "slides", "dataset_slides"))(
    lambda s, d: catalog.new_only(fx.slides(s, d), fx.dataset_slides(s, d).where("dataset_id < 3"), "name", "slide").select("name"))
query("j12_reload", sql("""SELECT s.slide, count(*) AS n, max(abs(s.iteration)) AS iteration FROM samples s JOIN slides l ON s.slide = l.name
    JOIN objects o USING (object_id) GROUP BY s.slide""", "samples", "slides"))(
    lambda s, d: catalog.reloaded(fx.samples(s, d), fx.slides(s, d), fx.objects(s, d)))
query("j13_mask_objects", sql("""SELECT v.view_id, o.object_id, o.boundary FROM boundaries o
    JOIN viewports v ON o.slide = v.slide AND x_centroid BETWEEN l - 32 AND r + 32 AND y_centroid BETWEEN t - 32 AND b + 32""", "boundaries", "viewports"))(
    lambda s, d: catalog.mask_objects(fx.boundaries(s, d), fx.viewports(s, d), 32).select("view_id", "object_id", "boundary"))
query("k11_listings", sql("SELECT set_id, name FROM training_sets", "training_sets"))(lambda s, d: fx.training_sets(s, d).select("set_id", "name").orderBy("name"))
query("a29_slides_with_boundaries", sql("SELECT DISTINCT slide FROM boundaries", "boundaries"))(lambda s, d: catalog.slides_with_boundaries(fx.boundaries(s, d)))


def _slide_list(s, d):
    """A slide file, of which only the first field of each line is read."""
    path = shared(s, "slide-list")
    fx.slides(s, d).select("name", "x_size", "y_size", "pyramid_path", "scale").write.csv(path)
    return files.read_slide_list(s, path)


query("s6_slide_list", sql("SELECT name FROM slides", "slides"))(_slide_list)
KINDS = "CASE WHEN {0} LIKE '%spfeatures%' THEN 'region' WHEN {0} LIKE '%pofeatures%' THEN 'cell' ELSE 'nuclei' END"
FILES = "concat('/data/', name, CASE set_id % 3 WHEN 0 THEN '-spfeatures' WHEN 1 THEN '-pofeatures' ELSE '-features' END, '.h5')"
query("s9_dataset_kinds", sql(f"SELECT file, {KINDS.format('file')} AS kind FROM (SELECT {FILES} AS file FROM training_sets)", "training_sets"))(
    lambda s, d: files.with_kinds(fx.training_sets(s, d).select(F.expr(FILES).alias("file")), "file").select("file", "kind"))
LOGGED = "SELECT event_id, CASE WHEN uid % 7 > 0 THEN CAST(uid AS {0}) ELSE '' END AS remote_addr, upper(command) AS type, CASE WHEN uid % 5 = 0 THEN '' ELSE concat(command, ' of ', uid) END AS message, ts FROM requests"


def _logged(s, d):
    """Two appends to one log, read back."""
    path = shared(s, "logs")
    rows = fx.requests(s, d).selectExpr("event_id", "CASE WHEN uid % 7 > 0 THEN CAST(uid AS STRING) ELSE '' END AS remote_addr", "upper(command) AS type", "CASE WHEN uid % 5 = 0 THEN '' ELSE concat(command, ' of ', uid) END AS message", "ts")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        files.append_log(rows.where(part), path)
    return files.read_log(s, path, "event_id bigint")


query("s14_log_rows", sql(f"SELECT event_id, CASE WHEN remote_addr = '' THEN 'UNKNOWN' ELSE remote_addr END AS remote_addr, type, message, strftime(ts, '%Y-%m-%d %H:%M:%S') AS written FROM ({LOGGED.format('VARCHAR')}) WHERE message <> ''", "requests"))(
    lambda s, d: _logged(s, d).select("event_id", "remote_addr", "type", "message", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("written")))
query("s16_safe_names", sql("""SELECT set_id, CASE WHEN name IN (SELECT name FROM training_sets WHERE set_id % 3 = 0) THEN concat(name, '_', right(concat('uid-', set_id * 7919), 3)) ELSE name END AS name FROM (
    SELECT set_id, CASE WHEN set_id % 2 = 0 THEN name ELSE concat('new ', name) END AS name FROM training_sets)""", "training_sets"))(
    lambda s, d: (lambda t: labels.safe_names(t.selectExpr("set_id", "CASE WHEN set_id % 2 = 0 THEN name ELSE concat('new ', name) END AS name", "concat('uid-', set_id * 7919) AS uid"), t.where("set_id % 3 = 0").select("name")).select("set_id", "name"))(fx.training_sets(s, d)))
STATUS = """SELECT uid, max(ts) AS last_seen, CAST(date_diff('second', max(ts), (SELECT max(ts) FROM requests)) AS BIGINT) AS idle_seconds FROM requests GROUP BY uid
    HAVING arg_max(command, ts) <> 'logout' AND date_diff('second', max(ts), (SELECT max(ts) FROM requests)) <= 86400"""
query("a27_session_status", sql(f"SELECT *, count(*) OVER () AS n_open FROM ({STATUS})", "requests"))(
    lambda s, d: labels.session_status(fx.requests(s, d), 86400).withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz")))

# ---- survival
KM = """SELECT "group", time, at_risk, events, censored, CASE WHEN ended = 1 THEN 0 ELSE exp(logs) END AS survival, CASE WHEN ended = 0 THEN exp(logs) * sqrt(green) END AS se,
    CASE WHEN ended = 0 THEN sqrt(green) END AS se_log, CASE WHEN ended = 0 AND exp(logs) < 1 THEN sqrt(green) / abs(logs) END AS se_loglog FROM (
    SELECT *, max(CASE WHEN events = at_risk THEN 1 ELSE 0 END) OVER w AS ended, sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER w AS logs,
      sum(CASE WHEN events < at_risk THEN events / (at_risk * (at_risk - events)) ELSE 0 END) OVER w AS green FROM (
    SELECT "group", time, CAST(sum(event) AS BIGINT) AS events, count(*) FILTER (event = 0) AS censored, CAST(sum(count(*)) OVER (PARTITION BY "group" ORDER BY time DESC) AS BIGINT) AS at_risk
    FROM survival GROUP BY "group", time) WINDOW w AS (PARTITION BY "group" ORDER BY time))"""
ROUND = lambda columns: ", ".join(f"round({x}, 6) AS {x}" for x in columns.split())


def _km(s, d):
    return survival.kaplan_meier(fx.survival(s, d))


query("a24_kaplan_meier", sql(f'SELECT "group", time, at_risk, events, censored FROM ({KM})', "survival"))(lambda s, d: _km(s, d).select("group", "time", "at_risk", "events", "censored"))
query("w3_survival", sql(f'SELECT "group", time, {ROUND("survival se se_log se_loglog")} FROM ({KM})', "survival"))(lambda s, d: rounded(_km(s, d).select("group", "time", "survival", "se", "se_log", "se_loglog")))
query("w4_step_points", sql(f"""SELECT "group", time AS x, CAST(step AS INTEGER) AS step, round(CASE WHEN step = 0 THEN coalesce(lag, 1) ELSE survival END, 6) AS y FROM
    (SELECT *, lag(survival) OVER (PARTITION BY "group" ORDER BY time) AS lag FROM ({KM})), range(2) t(step)""", "survival"))(lambda s, d: rounded(survival.step_points(_km(s, d))))  # fmt: skip
CLIP = lambda x: f"greatest(0, least(1, {x}))"
query("f18_confidence", sql(f"""SELECT "group", time, round(CASE WHEN se IS NOT NULL THEN {CLIP("survival - 1.96 * se")} END, 6) AS low, round(CASE WHEN se IS NOT NULL THEN {CLIP("survival + 1.96 * se")} END, 6) AS high,
    round(CASE WHEN se_log IS NOT NULL THEN {CLIP("survival * exp(-1.96 * se_log)")} END, 6) AS log_low, round(CASE WHEN se_log IS NOT NULL THEN {CLIP("survival * exp(1.96 * se_log)")} END, 6) AS log_high,
    round(CASE WHEN se_loglog IS NOT NULL THEN {CLIP("pow(survival, exp(1.96 * se_loglog))")} END, 6) AS loglog_low, round(CASE WHEN se_loglog IS NOT NULL THEN {CLIP("pow(survival, exp(-1.96 * se_loglog))")} END, 6) AS loglog_high
    FROM ({KM})""", "survival"))(lambda s, d: rounded(survival.confidence(_km(s, d))))  # fmt: skip
RAW = """SELECT subject, CASE WHEN odd = 1 AND event = 0 THEN 'n/a' ELSE CAST(time AS VARCHAR) END AS time, CASE WHEN odd = 1 THEN CAST(event AS VARCHAR) END AS event, CASE WHEN event = 1 THEN "group" END AS "group" FROM survival"""
query("f19_validate", sql(f"""SELECT subject, try_cast(time AS DOUBLE) AS time, CASE WHEN event IS NULL THEN 1 ELSE try_cast(event AS INTEGER) END AS event, coalesce("group", 'Default Group') AS "group",
    CASE WHEN try_cast(time AS DOUBLE) IS NULL THEN 'time' END AS error FROM ({RAW})""", "survival"))(lambda s, d: survival.checked(fx.survival(s, d).selectExpr(
    "subject", "CASE WHEN odd = 1 AND event = 0 THEN 'n/a' ELSE CAST(time AS STRING) END AS time", "CASE WHEN odd = 1 THEN CAST(event AS STRING) END AS event", "CASE WHEN event = 1 THEN `group` END AS `group`")))
query("f20_standardize", sql("SELECT subject, round((price - avg(price) OVER ()) / stddev_samp(price) OVER (), 6) AS price, CAST(odd AS DOUBLE) AS odd FROM survival", "survival"))(
    lambda s, d: rounded(survival.standardized(fx.survival(s, d).select("subject", "price", "odd"), ["price", "odd"])))
query("f21_complete_flipped", sql("SELECT subject, price2 AS price, 1 - event AS event FROM (SELECT *, CASE WHEN odd = 1 THEN price END AS price2 FROM survival) WHERE price2 IS NOT NULL", "survival"))(
    lambda s, d: survival.complete(fx.survival(s, d).selectExpr("subject", "CASE WHEN odd = 1 THEN price END AS price", "event"), True))
query("f22_rounding", sql("SELECT subject, round(round(price / pow(10, floor(log10(price))), 1) * pow(10, floor(log10(price))), 6) AS p, CAST(round(CAST(price AS DECIMAL(18, 4)), 2) AS DOUBLE) AS r FROM survival", "survival"))(
    lambda s, d: rounded(fx.survival(s, d).select("subject", survival.two_figures(F.col("price")).alias("p"), F.round(F.col("price").cast("decimal(18,4)"), 2).cast("double").alias("r"))))


def _survival_file(s, d):
    """A survival table with carriage returns in its header, as other systems write it."""
    path = shared(s, "survival")
    named = fx.survival(s, d).select("subject", "time", "event", F.col("group").alias(" group"), "price", F.col("odd").alias("odd\r"))
    named.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("quoteAll", True).csv(path)
    return files.read_survival(s, path).selectExpr("CAST(subject AS BIGINT) AS subject", "time", "event", "`group`", "CAST(price AS DOUBLE) AS price", "CAST(odd AS INT) AS odd")


query("s12_survival_source", sql('SELECT subject, time, event, "group", CAST(price AS DOUBLE) AS price, odd FROM survival', "survival"))(_survival_file)


def _covariates(s, d):
    return survival.standardized(fx.survival(s, d).select("time", "event", "price", "odd"), ["price", "odd"])


query("w9_risk_sums", sql("""SELECT time, deaths, round(r_w, 3) AS r_w, round(r_x0, 3) AS r_x0 FROM (SELECT time, CAST(sum(event) AS BIGINT) AS deaths,
    sum(sum(exp(odd * 0.5))) OVER (ORDER BY time DESC) AS r_w, sum(sum(odd * exp(odd * 0.5))) OVER (ORDER BY time DESC) AS r_x0 FROM survival GROUP BY time) WHERE deaths > 0""", "survival"))(
    lambda s, d: rounded(survival.risk_sums(fx.survival(s, d), ["odd"], [0.5]).select("time", "deaths", "r_w", "r_x0"), 3))
query("l14_cox_univariate")(lambda s, d: survival.cox_each_table(s, _covariates(s, d), ["price", "odd"]))
query("l15_cox_multivariate")(lambda s, d: survival.cox_table(s, _covariates(s, d), ["price", "odd"]))
query("j14_side_by_side", sql("""SELECT coalesce(a.variable, b.variable) AS variable, coalesce(a.n, 0) AS uni_n, coalesce(b.n, 0) AS multi_n FROM (SELECT slide AS variable, count(*) AS n FROM samples WHERE label = 1 GROUP BY 1) a
    FULL JOIN (SELECT slide AS variable, count(*) AS n FROM samples WHERE label = 0 AND slide <> 'S03' GROUP BY 1) b ON a.variable = b.variable""", "samples"))(lambda s, d: survival.side_by_side(
    *[fx.samples(s, d).where(w).groupBy(F.col("slide").alias("variable")).agg(F.count("*").alias("n")) for w in ("label = 1", "label = 0 AND slide <> 'S03'")]).na.fill(0))
query("j14_cox_side_by_side")(lambda s, d: survival.side_by_side(
    survival.cox_each_table(s, _covariates(s, d), ["price", "odd"]), survival.cox_table(s, _covariates(s, d), ["price", "odd"])))

# ---- boundaries
POINTS = "list_transform(string_split(boundary, ' '), lambda p: struct_pack(x := CAST(string_split(p, ',')[1] AS DOUBLE), y := CAST(string_split(p, ',')[2] AS DOUBLE)))"
TEXT = "array_to_string(list_transform({0}, lambda pt: concat(CAST(CAST(pt.x AS DECIMAL(12,1)) AS VARCHAR), ',', CAST(CAST(pt.y AS DECIMAL(12,1)) AS VARCHAR))), '{1}')"


def _points(s, d):
    return fx.boundaries(s, d).withColumn("p", b.parsed(F.col("boundary")))


def points_query(name, column, text):
    query(name, sql(f"SELECT object_id, {TEXT.format(text, ' ')} AS boundary FROM (SELECT object_id, x_centroid, y_centroid, {POINTS} AS p FROM boundaries)", "boundaries"))(
        lambda s, d: _points(s, d).select("object_id", b.written(column()).alias("boundary")))


PREV = "p[i - 1]"
CROSS = "((q[i].x - q[i - 1].x) * (q[i + 1].y - q[i].y) - (q[i + 1].x - q[i].x) * (q[i].y - q[i - 1].y))"
DOT = "((q[i].x - q[i - 1].x) * (q[i + 1].x - q[i].x) + (q[i].y - q[i - 1].y) * (q[i + 1].y - q[i].y))"
BY_INDEX = "list_transform(list_filter(range(1, len({0}) + 1), lambda i: {1}), lambda i: {0}[i])"
NO_REPEATS = BY_INDEX.format("p", "i = 1 OR p[i].x <> p[i - 1].x OR p[i].y <> p[i - 1].y")
DISTINCT = BY_INDEX.format("p", "(i = len(p) AND p[1] = p[i]) OR list_position(p, p[i]) = i")
points_query("p5_parse_boundary", lambda: F.col("p"), "p")
points_query("p6_to_slide", lambda: b.moved(F.col("p"), F.col("x_centroid"), F.col("y_centroid")), "list_transform(p, lambda v: struct_pack(x := v.x + x_centroid, y := v.y + y_centroid))")
points_query("p2_rescale", lambda: b.scaled(F.col("p"), F.when(F.col("object_id") % 2 == 0, 2.0).otherwise(1.0)), "list_transform(p, lambda v: struct_pack(x := v.x * CASE WHEN object_id % 2 = 0 THEN 2.0 ELSE 1.0 END, y := v.y * CASE WHEN object_id % 2 = 0 THEN 2.0 ELSE 1.0 END))")
points_query("f4_distinct_vertices", lambda: b.distinct(F.col("p")), DISTINCT)
query("f2_merge_collinear", sql(f"""SELECT object_id, {TEXT.format(BY_INDEX.format("q", f"i = 1 OR i = len(q) OR {CROSS} <> 0"), " ")} AS boundary
    FROM (SELECT object_id, {NO_REPEATS} AS q FROM (SELECT object_id, {POINTS} AS p FROM boundaries))""", "boundaries"))(lambda s, d: _points(s, d).select("object_id", b.written(b.merged(F.col("p"))).alias("boundary")))  # fmt: skip
query("f3_remove_spurs", sql(f"""SELECT object_id, {TEXT.format(BY_INDEX.format("q", f"i = 1 OR i = len(q) OR {CROSS} <> 0 OR {DOT} >= 0"), " ")} AS boundary
    FROM (SELECT object_id, {NO_REPEATS} AS q FROM (SELECT object_id, {POINTS} AS p FROM boundaries))""", "boundaries"))(lambda s, d: _points(s, d).select("object_id", b.written(b.without_spurs(F.col("p"))).alias("boundary")))  # fmt: skip
query("f5_clean_boundaries", sql(f"""SELECT object_id, {TEXT.format(BY_INDEX.format("q", f"i = 1 OR i = len(q) OR {CROSS} <> 0 OR {DOT} >= 0"), " ")} AS boundary FROM (SELECT object_id, {DISTINCT} AS q FROM (
    SELECT object_id, {BY_INDEX.format("q", f"i = 1 OR i = len(q) OR {CROSS} <> 0")} AS p FROM (SELECT object_id, {NO_REPEATS} AS q FROM (SELECT object_id, {POINTS} AS p FROM boundaries))))""", "boundaries"))(
    lambda s, d: _points(s, d).select("object_id", b.written(b.cleaned(F.col("p"))).alias("boundary")))
SIDES = "list_transform(range(1, len({0})), lambda i: sqrt(pow({0}[i + 1].x - {0}[i].x, 2) + pow({0}[i + 1].y - {0}[i].y, 2)))"
query("w7_side_lengths", sql(f"SELECT object_id, i AS side, round(unnest, 6) AS length FROM (SELECT object_id, unnest({SIDES.format('p')}) AS unnest, generate_subscripts({SIDES.format('p')}, 1) - 1 AS i FROM (SELECT object_id, {POINTS} AS p FROM boundaries))", "boundaries"))(
    lambda s, d: rounded(_points(s, d).select("object_id", F.posexplode(b.lengths(F.col("p"))).alias("side", "length")).select("object_id", F.col("side").cast("bigint").alias("side"), "length")))
query("w8_arc_length", sql(f"SELECT object_id, i AS vertex, round(coalesce(list_sum(sides[1:i]), 0), 6) AS arc FROM (SELECT object_id, {SIDES.format('p')} AS sides, unnest(range(0, len(p))) AS i FROM (SELECT object_id, {POINTS} AS p FROM boundaries))", "boundaries"))(
    lambda s, d: rounded(_points(s, d).select("object_id", F.posexplode(b.arc_lengths(F.col("p"))).alias("vertex", "arc")).select("object_id", F.col("vertex").cast("bigint").alias("vertex"), "arc")))
query("a13_circularity", sql(f"""SELECT object_id, round(per, 6) AS perimeter, round(CASE WHEN per > 0 THEN 4 * pi() * area / (per * per) END, 6) AS circularity FROM (
    SELECT object_id, list_sum({SIDES.format('r')}) AS per, abs(list_sum(list_transform(range(1, len(r)), lambda i: r[i].x * r[i + 1].y - r[i + 1].x * r[i].y))) / 2 AS area
    FROM (SELECT object_id, list_append(p, p[1]) AS r FROM (SELECT object_id, {POINTS} AS p FROM boundaries)))""", "boundaries"))(
    lambda s, d: rounded(_points(s, d).select("object_id", b.perimeter(F.col("p")).alias("perimeter"), b.circularity(F.col("p")).alias("circularity"))))
