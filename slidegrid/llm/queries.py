"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidegrid.llm import bpe, licenses, lm, manifest, media, packing, periodic, quality, secrets, simhash, substring, topk, toxicity
from slidegrid.llm.common import documents
from slidegrid.llm.labelled import held_out


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["no"] < len(secrets.BASE))
    count = [F.expr(f"CAST(size(filter(spans, s -> s.no = {k})) AS BIGINT)").alias(f"n_{kind[0]}") for k, kind in enumerate(secrets.BASE)]
    return found.select(
        F.col("id").alias("doc_id"), *count, F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"),
        F.size(F.filter("shared", lambda x: ~x)).cast("bigint").alias("n_live"), F.size(F.filter("shared", lambda x: x)).cast("bigint").alias("n_example"),
    )


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), words=4, budget=4)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return found.withColumnRenamed("id", "doc_id")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)
    return found.withColumnRenamed("id", "vec_id")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir)).select("row.doc_id", "held_out", "score", "predicted")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(documents(spark, sf_dir), labels(spark, sf_dir))
    return found.select("row.doc_id", "held_out", "score", "predicted")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.without_repeats(documents(spark, sf_dir), window=13)
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    made = manifest.manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    proof = F.sha2(manifest.proof(F.col("path")), 256).alias("proof_sha256")
    return made.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(documents(spark, sf_dir), planted=True), "row.doc_id")


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, known = lm.scored(documents(spark, sf_dir), ~held_out("doc_id", 5, 1))
    return found.select("row.doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", F.lit(known.total).cast("bigint").alias("train_tokens"), "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_media_columns": op5_media_columns,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_secret_scans": op8_secret_scans,
    "op9_license_scans": op9_license_scans,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_lm_scores": op13_lm_scores,
}

def _licence_sql() -> str:
    """Phrases and templates by brute force: every block with every template."""
    places = []
    for phrase, label in licenses.PHRASES.items():
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        places.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {test}), lambda i: struct_pack(at := i - 1, label := '{label}'))")
    templates = ", ".join(f"('{' '.join(sorted(set(text.split())))}', '{label}', {licenses.stride(len(text.split()))})" for text, label in licenses.TEMPLATES)
    return rf"""
    WITH docs AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
    words AS (SELECT doc_id, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM docs),
    base AS (SELECT doc_id, len(w) AS n, list_concat({places[0]}, {places[1]}, {places[2]}) AS p FROM words),
    templates AS (SELECT string_split(words, ' ') AS t, label, stride FROM (VALUES {templates}) v(words, label, stride)),
    blocks AS (SELECT doc_id, stride, list_distinct(w[k + 1:k + 2 * stride]) AS w FROM (SELECT doc_id, w, stride, unnest(range(0, len(w), stride)) AS k FROM words, (SELECT DISTINCT stride FROM templates))),
    shares AS (SELECT doc_id, label, len(list_intersect(t, w)) / len(t) AS share FROM blocks JOIN templates USING (stride)),
    found AS (SELECT doc_id, list(DISTINCT label) AS more, max(share) AS best FROM shares WHERE share >= {licenses.THRESHOLD} - 1e-9 GROUP BY doc_id)
    SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(list_transform(p, lambda x: x.at)) AS BIGINT) AS first_word,
      CAST(list_max(list_transform(p, lambda x: x.at)) AS BIGINT) AS last_word, array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') AS base_labels,
      array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda x: x.label), coalesce(more, [])))), ',') AS labels,
      CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
    FROM base LEFT JOIN found USING (doc_id)"""


def _secret_sql() -> str:
    """Spans from what lies between matches, and owners by counting."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def kind(no: int, name: str, pattern: str, group: int, least: int, measured: int) -> str:
        p = quoted(pattern)
        whole, inner = f"regexp_extract_all(t, {p}, 0)", f"regexp_extract_all(t, {p}, {group})"
        start = f"CAST(list_sum(list_transform(string_split_regex(t, {p})[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({whole}[1:i - 1], lambda x: length(x))), 0) AS INTEGER)"
        one = f"struct_pack(s := {start}, no := {no}, e := {start} + CAST(length({whole}[i]) AS INTEGER), kind := '{name}', v := {inner}[i])"
        fits = f"length({inner if measured else whole}[i]) >= {least}"
        return f"list_transform(list_filter(range(1, len({whole}) + 1), lambda i: {fits}), lambda i: {one})"

    kinds = [kind(i, *k) for i, k in enumerate((*secrets.BASE, *secrets.ADDED))]
    written = "array_to_string(list_transform({0}, lambda x: concat(x.kind, ':', x.s, ':', x.e)), ',')"
    counts = ", ".join(f"CAST(len(list_filter(p, lambda x: x.no = {i})) AS BIGINT) AS n_{k[0]}" for i, k in enumerate(secrets.BASE))
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, source, lang FROM documents),
    spans AS (SELECT doc_id, source, lang, CASE WHEN regexp_matches(t, {quoted(secrets.HINT)}) THEN list_sort(list_concat(list_concat({kinds[0]}, {kinds[1]}), list_concat({kinds[2]}, {kinds[3]}))) ELSE [] END AS p FROM docs),
    held AS (SELECT x.v AS v, count(DISTINCT source) >= {secrets.OWNERS} OR count(DISTINCT concat_ws('/', source, lang)) >= {secrets.REPOSITORIES} AS shared
      FROM (SELECT source, lang, unnest(p) AS x FROM spans) GROUP BY x.v),
    judged AS (SELECT doc_id, count(*) FILTER (shared) AS n_example, count(*) FILTER (NOT shared) AS n_live FROM (SELECT doc_id, unnest(p) AS x FROM spans) JOIN held ON x.v = held.v GROUP BY doc_id)
    SELECT doc_id, {counts}, sha256({written.format(f"list_filter(p, lambda x: x.no < {len(secrets.BASE)})")}) AS base_sha256, {written.format("p")} AS spans,
      coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
    FROM spans LEFT JOIN judged USING (doc_id)"""


#: The CRC-32 of an id as decimal text, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"""
#: Levels of a tree that SQL spells out: 8 ** 12 leaves.
_LEVELS = 12


def _manifest_sql() -> str:
    """Sorted leaves, trees level by level, and siblings by looking up each level's run."""
    field = "coalesce(concat(strlen(CAST({0} AS VARCHAR)), ':', CAST({0} AS VARCHAR)), '-')"
    leaf = lambda text: "sha256(concat(" + ", ".join(field.format(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    low = f"translate(text, '{manifest.ASCII_UP}', '{manifest.ASCII_LOW}')"

    def tree(name: str, nodes: str, levels: int) -> str:
        """Tables name_k: g, run, hs, n: the runs of level k of each group, and its number of nodes."""
        parts = []
        for k in range(levels):
            source = nodes if not k else f"SELECT g, run AS i, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {name}_{k - 1}"
            parts.append(f"{name}_{k} AS MATERIALIZED (SELECT g, i // 8 AS run, list(h ORDER BY i) AS hs, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM ({source})) GROUP BY g, i // 8)")
        return ",\n    ".join(parts)

    def fold(name: str, levels: int, keep: str, start: str, g: str, i: str) -> tuple[str, str]:
        """A chain of tables from `start` that go up a tree: p and f, siblings so far and the folded node."""
        parts, last = [], start
        for k in range(levels):
            at = f"(l.{i} // {8**k}) % 8"
            others = f"array_to_string(list_concat(t.hs[1:{at}], t.hs[{at} + 2:]), '')"
            folded = f"sha256(array_to_string(list_concat(list_append(t.hs[1:{at}], l.f), t.hs[{at} + 2:]), ''))"
            parts.append(f"{name}_up_{k} AS (SELECT l.* EXCLUDE (p, f), CASE WHEN t.n > 1 THEN concat(l.p, {others}) ELSE l.p END AS p, CASE WHEN t.n > 1 THEN {folded} ELSE l.f END AS f FROM {last} l JOIN {name}_{k} t ON t.g = {g} AND t.run = l.{i} // {8 ** (k + 1)})")
            last = f"{name}_up_{k}"
        return ",\n    ".join(parts), last

    langs, last_lang = fold("lang", _LEVELS, "", "leaves", "l.g", "i")
    roots, last_root = fold("all", 4, "", "tops", "0", "top")
    return f"""
    WITH leaves AS (SELECT doc_id, coalesce(concat('=', lang), '-') AS g, {leaf("text")} AS leaf, '' AS p,
        CASE WHEN {_CRC.format("doc_id")} % 3 = 0 THEN {leaf(low)} ELSE {leaf("text")} END AS f,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, {leaf("text")}) - 1 AS i FROM documents),
    {tree("lang", "SELECT g, i, leaf AS h FROM leaves", _LEVELS)},
    {langs},
    subroots AS (SELECT g AS name, hs[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS top FROM lang_{_LEVELS - 1}),
    {tree("all", "SELECT 0 AS g, top AS i, subroot AS h FROM subroots", 4)},
    tops AS (SELECT l.*, s.subroot, s.top FROM {last_lang} l JOIN subroots s ON l.g = s.name),
    {roots}
    SELECT doc_id, leaf, subroot, r.hs[1] AS root, sha256(p) AS proof_sha256, f AS folded_root, f = r.hs[1] AS verified FROM {last_root}, all_3 r"""


def _runs_sql() -> str:
    """Pairs of equal stretches of six words, joined to stretches at each distance; those that a smaller period fills are left out."""
    return rf"""
    WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o, {_CRC.format("doc_id")} AS h FROM documents),
    dealt AS (SELECT doc_id, o, len(o) AS n, h % 10 = 0 AND len(o) > 0 AS planted, (h // 10) % greatest(len(o), 1) AS a, (h // 10) % 8 AS e FROM docs),
    words AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN o[i + 1] ELSE o[a + (i - a) % (1 + (n - a) // (3 + e)) + 1] END) ELSE o END AS w FROM dealt),
    grams AS (SELECT doc_id, n, unnest(range(0, n - 5)) AS i, unnest(list_transform(range(0, n - 5), lambda k: array_to_string(w[k + 1:k + 6], ' '))) AS x FROM words WHERE n >= 12),
    pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i AND 2 * (b.i - a.i) <= a.n),
    held AS (SELECT doc_id, q, min(i) AS s, count(*) + 5 + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island),
    long AS (SELECT * FROM held WHERE l >= 12 AND l >= 2 * q),
    runs AS (SELECT * FROM long r WHERE NOT EXISTS (SELECT 1 FROM long x WHERE x.doc_id = r.doc_id AND x.q < r.q AND x.s <= r.s AND x.s + x.l >= r.s + r.l)),
    told AS (SELECT doc_id, count(*) AS n_runs, list([s, l, q] ORDER BY l DESC, s, q)[1] AS best, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id),
    gone AS (SELECT doc_id, list(DISTINCT place) AS places FROM (SELECT doc_id, unnest(range(s + q, s + l)) AS place FROM runs) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period, 1000 * best[2] // best[3] AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
      sha256(array_to_string(CASE WHEN places IS NULL THEN w ELSE list_transform(list_filter(range(0, n), lambda i: NOT list_contains(places, i)), lambda i: w[i + 1]) END, ' ')) AS collapsed_sha256
    FROM words d LEFT JOIN told USING (doc_id) LEFT JOIN gone USING (doc_id)"""


ORACLES: dict[str, str] = {
    "op2_exact_top_k": """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
    ranked AS (
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
    SELECT * FROM ranked WHERE rank <= 20""",
    "op6_substring_dedup": r"""
    WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    windows AS (
      SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS key FROM docs),
    hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY key) AS first FROM windows) WHERE first < doc_id),
    gone AS (SELECT doc_id, list(DISTINCT i + k) AS places FROM hits, range(13) t(k) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
      sha256(array_to_string(CASE WHEN places IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(places, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
    FROM docs d LEFT JOIN gone g USING (doc_id)""",
    "op8_secret_scans": _secret_sql(),
    "op9_license_scans": _licence_sql(),
    "op11_merkle_manifest": _manifest_sql(),
    "op12_periodic_runs": _runs_sql(),
}
