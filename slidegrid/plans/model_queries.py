"""Queries of models, streams and sources."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidegrid import fixtures as fx
from slidegrid.fixtures import sql
from slidegrid.functions import boundaries as b
from slidegrid.operators import counts, models, svm
from slidegrid.plans.registry import query, rounded, shared
from slidegrid.sources import files
from slidegrid.streaming import intake, jobs, sessions

DIMS = 64


def vectors(s, d):
    return fx.table(s, d, "embeddings").selectExpr("CAST(vec_id AS BIGINT) AS object_id", "concat('S0', CAST(vec_id % 5 AS STRING)) AS slide", "CAST(embedding AS ARRAY<DOUBLE>) AS features", "CASE WHEN label < 5 THEN -1 ELSE 1 END AS label", "label AS class")


def known(s, d):
    """Labelled vectors: those of four of the ten classes, two of either label; the others stay unlabelled, as in a session's beginning."""
    return vectors(s, d).where("class IN (0, 2, 6, 8)")


NORM = "(SELECT dim, avg(v) AS m, stddev_samp(v) AS sd FROM (SELECT generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings {0}) GROUP BY dim)"
query("f1_normalize", f"""SELECT object_id, dim, round((v - m) / sd, 6) AS z FROM (SELECT CAST(vec_id AS BIGINT) AS object_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings)
    JOIN {NORM.format('')} USING (dim)""")(lambda s, d: rounded(models.normalized(vectors(s, d), models.moments(vectors(s, d))).select("object_id", F.posexplode("features").alias("dim", "z")).select("object_id", (F.col("dim") + 1).cast("bigint").alias("dim"), "z")))  # fmt: skip
query("f1_renormalize", f"""SELECT object_id, dim, round((v - n.m) / n.sd, 6) AS z FROM (SELECT CAST(vec_id AS BIGINT) AS object_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings WHERE label IN (0, 2, 6, 8))
    JOIN {NORM.format('')} n USING (dim)""")(lambda s, d: rounded(models.renormalized(models.normalized(known(s, d), models.moments(known(s, d))), models.moments(known(s, d)), models.moments(vectors(s, d)))
    .select("object_id", F.posexplode("features").alias("dim", "z")).select("object_id", (F.col("dim") + 1).cast("bigint").alias("dim"), "z")))


def _scored(s, d):
    return models.scored(models.forest(known(s, d), DIMS), vectors(s, d), ["object_id", "slide", "label"])


query("l1_train_forest")(lambda s, d: s.createDataFrame([(i, float(v)) for i, v in enumerate(models.forest(known(s, d), DIMS).featureImportances.toArray())], "dim int, importance double"))
query("l2_classify")(lambda s, d: _scored(s, d).select("object_id", "predicted"))
query("l3_score")(lambda s, d: _scored(s, d).select("object_id", "score"))


def _stored(s, d, root=None, make=None):
    """The folder of the forest of the known vectors."""
    return models.stored(s, root or shared(s, "models"), "known", 1, make or (lambda: models.forest(known(s, d), DIMS)))


query("l3_votes")(lambda s, d: models.voted(s, _stored(s, d), vectors(s, d), ["object_id"]))


def _margins(s, d):
    return svm.margins(svm.fitted(known(s, d), DIMS), vectors(s, d), ["object_id"])


query("l4_svm")(lambda s, d: _margins(s, d).groupBy("predicted").agg(F.count("*").alias("n")))
query("l5_svm_margin")(_margins)


def _fourier_margins(s, d):
    model, n = models.svm(known(s, d), DIMS)
    return models.margins(model, n, vectors(s, d), DIMS, ["object_id"])


query("l4_svm_fourier")(lambda s, d: _fourier_margins(s, d).groupBy("predicted").agg(F.count("*").alias("n")))
query("l6_samplers")(lambda s, d: (lambda scored: functools.reduce(
    DataFrame.unionByName, [f(scored, 8, 3).select(F.lit(n).alias("sampler"), "object_id") for n, f in models.SAMPLERS.items()]))(_scored(s, d)))
query("l7_apply_to_slide")(lambda s, d: models.scored(models.forest(known(s, d), DIMS), vectors(s, d).where("slide = 'S02'"), ["object_id"]))


def placed(s, d):
    """Vectors at places on their slides."""
    return vectors(s, d).selectExpr("*", "CAST(object_id * 37 % 2000 AS DOUBLE) AS x_centroid", "CAST(object_id * 53 % 1600 AS DOUBLE) AS y_centroid")


def _stored_on_viewport(s, d):
    """The first call trains and publishes; the second one finds the classifier, and would fail if it trained."""
    root = shared(s, "models")
    _stored(s, d, root)

    def never():
        raise AssertionError("trained again")

    return models.applied(_stored(s, d, root, never), placed(s, d), "S02", 400, 1600, 300, 1200, ["object_id", "x_centroid", "y_centroid"])


query("l7_stored_on_viewport")(_stored_on_viewport)
query("l8_scored_dataset")(lambda s, d: _scored(s, d).withColumnRenamed("score", "pred_score"))
query("l9_score_map", sql("SELECT score, x_centroid AS x, y_centroid AS y FROM objects WHERE slide = 'S06'", "objects"))(
    lambda s, d: fx.objects(s, d).where("slide = 'S06'").select("score", F.col("x_centroid").alias("x"), F.col("y_centroid").alias("y")))
query("l10_roc", sql("""SELECT 'label' AS kind, object_id, CAST(label AS DOUBLE) AS value FROM samples WHERE label <> 0 UNION ALL
    SELECT 'probability', object_id, round((score + 1) / 2, 6) FROM samples WHERE label <> 0 UNION ALL
    SELECT kind, 0, round(value, 6) FROM (SELECT tp, fp, tn, p, n, unnest(['fp_rate', 'tp_rate', 'precision', 'accuracy']) AS kind, unnest([fp / nullif(n, 0), tp / nullif(p, 0), tp / nullif(tp + fp, 0), (tp + tn) / nullif(p + n, 0)]) AS value FROM (
      SELECT count(*) FILTER (label = 1 AND score >= 0) AS tp, count(*) FILTER (label = -1 AND score >= 0) AS fp, count(*) FILTER (label = -1 AND score < 0) AS tn, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = -1) AS n FROM samples))""", "samples"))(
    lambda s, d: rounded(models.roc_report(fx.samples(s, d))))
query("l11_active_round")(lambda s, d: models.active_round(vectors(s, d), known(s, d), DIMS))
query("l11_active_rounds")(lambda s, d: models.active_rounds(vectors(s, d), known(s, d), lambda batch, k: vectors(s, d).join(batch.select("object_id"), "object_id").select("object_id", "label"), DIMS, trees=20)[0])
query("l13_class_names", sql("SELECT DISTINCT label, CASE label WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE 'ignored' END AS name FROM samples", "samples"))(
    lambda s, d: fx.samples(s, d).select("label").distinct().withColumn("name", F.when(F.col("label") == 1, "positive").when(F.col("label") == -1, "negative").otherwise("ignored")))
query("w2_folds", sql("SELECT object_id, CAST((row_number() OVER (ORDER BY md5(concat('1:', object_id)), object_id) - 1) % 5 AS INTEGER) AS fold FROM samples", "samples"))(lambda s, d: models.folds(fx.samples(s, d)))
TOP8 = "SELECT slide AS uid, {0} AS iteration, object_id FROM (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY abs(score), object_id) AS k FROM {1}) WHERE k <= 8"


def _top8(rows):
    """The eight most uncertain objects of each slide."""
    w = Window.partitionBy("slide").orderBy(F.abs("score"), "object_id")
    return rows.withColumn("k", F.row_number().over(w)).where("k <= 8").select(F.col("slide").alias("uid"), "object_id")


def _pending(s, d):
    """Slides stand for sessions: each was sent its most uncertain samples at iteration 3; every other one has submitted since."""
    sent = _top8(fx.samples(s, d)).select("uid", F.lit(3).alias("iteration"), "object_id")
    now = fx.slides(s, d).select(F.col("name").alias("uid"), F.expr("3 + CAST(substring(name, 2) AS INT) % 2").alias("iteration"))
    return models.next_batch(sent, _top8(fx.objects(s, d)), now)


query("k9_pending_batch", sql(f"""SELECT uid, iteration, object_id, iteration = 3 AS resent FROM (SELECT name AS uid, 3 + CAST(substring(name, 2) AS INTEGER) % 2 AS iteration FROM slides)
    JOIN ({TOP8.format(3, 'samples')} UNION ALL {TOP8.format(4, 'objects')}) USING (uid, iteration)""", "samples", "slides"))(_pending)  # fmt: skip

# ---- streams, on batches
SESSIONS = """SELECT uid, min(ts) AS started, max(ts) AS last_seen, count(*) AS n_requests FROM (SELECT *, sum(new) OVER (PARTITION BY uid ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (
    SELECT uid, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY uid ORDER BY ts), ts) <= 1800000000 THEN 0 ELSE 1 END AS new FROM requests)) GROUP BY uid, k"""
query("t1_sessions", sql(SESSIONS, "requests"))(lambda s, d: jobs.sessions(fx.requests(s, d)).select("uid", F.col("started").cast("timestamp_ntz").alias("started"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "n_requests"))
ENDS = {"purchase": "ended", "error": "cancelled"}
query("t1_ended_sessions", sql("""SELECT CAST(uid AS VARCHAR) AS uid, min(ts) AS started, max(ts) AS last_seen, count(*) AS n_requests,
    CASE arg_max(command, (ts, event_id)) WHEN 'purchase' THEN 'ended' WHEN 'error' THEN 'cancelled' ELSE CASE WHEN date_diff('microsecond', max(ts), (SELECT max(ts) FROM requests)) > 1800000000 THEN 'idle' END END AS reason
    FROM (SELECT *, sum(new) OVER (PARTITION BY uid ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (
      SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) <= 1800000000 AND lag(command) OVER w NOT IN ('purchase', 'error') THEN 0 ELSE 1 END AS new FROM requests WINDOW w AS (PARTITION BY uid ORDER BY ts, event_id))) GROUP BY uid, k""", "requests"))(
    lambda s, d: sessions.sessions_of(fx.requests(s, d), ends=ENDS).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "last_seen")}))
query("t3_log_counts", sql("SELECT date_trunc('hour', ts) AS started, command, count(*) AS n FROM requests GROUP BY 1, 2", "requests"))(
    lambda s, d: jobs.log_counts(fx.requests(s, d)).withColumn("started", F.col("started").cast("timestamp_ntz")))
query("t5_daily_logs", sql("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, command, count(*) AS n FROM requests WHERE date_diff('day', CAST(ts AS DATE), (SELECT max(CAST(ts AS DATE)) FROM requests)) < 7 GROUP BY 1, 2", "requests"))(
    lambda s, d: jobs.daily_logs(fx.requests(s, d)).groupBy(F.col("day").cast("string").alias("day"), "command").agg(F.count("*").alias("n")))


def _lines(s, d):
    return fx.samples(s, d).select(F.to_json(F.struct(F.lit("submit").alias("command"), F.col("slide").alias("uid"), "iteration", F.array(F.struct(
        F.col("object_id").cast("string").alias("id"), "label", F.col("x_centroid").alias("centX"), F.col("y_centroid").alias("centY"), "slide")).alias("samples"))).alias("value"))


query("f25_json_requests", sql("SELECT slide AS uid, iteration, object_id, label, slide, x_centroid AS x, y_centroid AS y FROM samples", "samples"))(lambda s, d: jobs.submissions(_lines(s, d)))
def _two_lines(s, d):
    """Each sample's submission, and for some a later one with another label, or one with a label that is none."""
    later = F.regexp_replace("value", r'"iteration":[0-9]+', '"iteration":99')
    lines = _lines(s, d)
    return lines.unionAll(lines.where(F.col("value").contains('"label":1')).select(F.regexp_replace(later, '"label":1', '"label":-1'))).unionAll(
        lines.where(F.col("value").contains('"label":0')).select(F.regexp_replace(later, '"label":0', '"label":7')))


query("t2_latest_labels", sql("SELECT object_id, CASE WHEN label = 1 THEN -1 ELSE label END AS label, CASE WHEN label = 1 THEN 99 ELSE iteration END AS iteration FROM samples", "samples"))(
    lambda s, d: jobs.latest(jobs.accepted(jobs.submissions(_two_lines(s, d)))))



def _judged(s, d):
    """Each sample's submission at its iteration's hour, and its second one as another line; some for objects that are not there, or late."""
    hour = lambda c: F.timestamp_seconds(F.lit(1_700_000_000) + 3600 * c)
    lines = _two_lines(s, d).withColumn("ts", hour(F.get_json_object("value", "$.iteration").cast("long")))
    lines = lines.unionAll(lines.where(F.col("value").contains('"label":-1')).withColumn("ts", hour(F.lit(50))))
    objects = fx.objects(s, d).where("object_id % 8 <> 3").select("object_id")
    mark = s.range(1).select(hour(F.lit(6)).alias("at"))
    taken = s.createDataFrame([], "uid string, iteration int, object_id bigint, label int")
    found = intake.judged(intake.parsed(lines), objects, taken, mark, 3600)
    return found.groupBy("fate", "reason").agg(F.count("*").alias("n"))


query("t2_dead_letters", sql("""SELECT CASE WHEN reason IS NULL THEN 'taken' ELSE 'dead' END AS fate, reason, count(*) AS n FROM (
      SELECT CASE WHEN label NOT IN (-1, 0, 1) THEN 'malformed' WHEN h < 5 THEN 'late' WHEN object_id % 8 = 3 THEN 'unknown' WHEN k > 1 THEN 'duplicate' END AS reason
      FROM (SELECT *, row_number() OVER (PARTITION BY uid, iteration, object_id, label, h >= 5 ORDER BY h) AS k FROM (
        SELECT *, unnest(CASE WHEN label = -1 THEN [iteration, 50] ELSE [iteration] END) AS h FROM (
          SELECT slide AS uid, iteration, object_id, label FROM samples UNION ALL
          SELECT slide, 99, object_id, CASE label WHEN 1 THEN -1 ELSE 7 END FROM samples WHERE label IN (0, 1))))) GROUP BY 1, 2""", "samples"))(_judged)  # fmt: skip

# ---- sources
query("p1_nan_features", "SELECT 'S0' || CAST(vec_id % 5 AS VARCHAR) AS slide, count(*) FILTER (label = 3) AS n_rejected FROM embeddings GROUP BY 1")(
    lambda s, d: files.rejected(vectors(s, d).withColumn("features", F.when(F.col("class") == 3, F.transform("features", lambda v: F.lit(float("nan")))).otherwise(F.col("features")))))
query("p3_slide_name", sql("SELECT object_id, split_part(concat(slide, '.seg.', object_id), '.', 1) AS slide FROM objects", "objects"))(
    lambda s, d: fx.objects(s, d).select("object_id", F.substring_index(F.concat("slide", F.lit(".seg."), F.col("object_id").cast("string")), ".", 1).alias("slide")))
query("p4_reencode_boundary", sql("SELECT object_id, array_to_string(list_transform(string_split(boundary, ' '), lambda q: concat(string_split(q, ',')[1], '.0,', string_split(q, ',')[2], '.0')), ' ') AS boundary FROM boundaries", "boundaries"))(
    lambda s, d: fx.boundaries(s, d).select("object_id", b.written(b.parsed(F.concat(F.replace("boundary", F.lit(" "), F.lit(";")), F.lit(";bad;")), ";")).alias("boundary")))
query("p7_magnifications", sql("SELECT object_id, CAST(20.0 AS DOUBLE) * scale AS scan_mag, CAST(20.0 AS DOUBLE) AS analysis_mag FROM objects JOIN slides ON slide = name", "objects", "slides"))(
    lambda s, d: fx.objects(s, d).join(F.broadcast(fx.slides(s, d)), F.col("slide") == F.col("name")).select("object_id", (F.lit(20.0) * F.col("scale")).alias("scan_mag"), F.lit(20.0).alias("analysis_mag")))
query("p16_array_predicates", """SELECT CAST(vec_id AS BIGINT) AS object_id, len(list_filter(embedding, lambda v: v > 0)) AS n_positive, len(list_concat(embedding, embedding)) AS n_twice,
    list_contains(list_transform(embedding, lambda v: v > 0.5), true) AS has_large FROM embeddings""")(
    lambda s, d: vectors(s, d).select("object_id", F.size(F.filter("features", lambda v: v > 0)).cast("bigint").alias("n_positive"), F.size(F.concat("features", "features")).cast("bigint").alias("n_twice"), F.array_contains(F.transform("features", lambda v: v.cast("float") > F.lit(0.5)), True).alias("has_large")))
query("p20_coercion", sql("SELECT object_id, x_centroid AS x FROM objects", "objects"))(lambda s, d: fx.objects(s, d).select("object_id", F.col("x_centroid").cast("string").try_cast("double").alias("x")))
query("s8_provenance")(lambda s, d: fx.objects(s, d).groupBy("slide").agg(F.count("*").alias("n")).crossJoin(files.provenance(s, "1")))
