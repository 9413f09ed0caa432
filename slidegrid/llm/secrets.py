"""Secret scans: spans of credentials, and who else in the corpus owns the same ones. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidegrid.llm.common import checkpointed, columns, join_hot, out_of_row, quoted, sieved

#: Fixed patterns of the base kinds: name, pattern, group that is the secret, least length and what it is the length of (a group).
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, 2),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, 0),
    ("hex", r"[0-9a-f]+", 0, 32, 0),
)
#: Fixed forms of keys that providers give out, which the base kinds don't name.
PROVIDERS = r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"
ADDED = (("provider", PROVIDERS, 0, 12, 0),)
#: What a text has to contain somewhere to be looked through at all; each kind's matches contain one of these.
HINT = rf"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=])|AKIA[A-Z0-9]{{12}}|[0-9a-f]{{32}}|{PROVIDERS}"""
#: From how many owners or repositories on a value counts as a copied example.
OWNERS, REPOSITORIES = 3, 5
SPAN = "struct<start:int,no:int,end:int,kind:string,value:string,to:int>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _running(values: Column, neutral: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Each value joined with all before it, in log n passes over the array: pass k joins with what stands 2**k before."""
    passes = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1)).otherwise(F.expr("CAST(array() AS array<int>)"))

    def once(done: Column, k: Column) -> Column:
        by = F.pow(F.lit(2), k).cast("int")
        return F.zip_with(done, F.concat(F.array_repeat(neutral, by), F.slice(done, F.lit(1), F.greatest(F.size(done) - by, F.lit(0)))), join)

    return F.aggregate(passes, values, once)


def _spans(text: Column, no: int, kind: str, pattern: str, group: int, least: int, measured: int) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points and bytes: what lies between matches gives their places."""
    whole, inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sizes = lambda gap, x: F.struct((F.length(gap) + F.coalesce(F.length(x), F.lit(0))).alias("chars"), (F.octet_length(gap) + F.coalesce(F.octet_length(x), F.lit(0))).alias("bytes"))
    both = lambda x, y: F.struct((x["chars"] + y["chars"]).alias("chars"), (x["bytes"] + y["bytes"]).alias("bytes"))

    def placed(p: Column) -> Column:
        return _let(F.zip_with(p["gap"], p["whole"], sizes), lambda x: F.arrays_zip(_running(x, F.struct(F.lit(0).alias("chars"), F.lit(0).alias("bytes")), both).alias("to"), p["whole"].alias("whole"), p["inner"].alias("inner")))

    def span(x: Column) -> Column:
        end = x["to"]["chars"]
        return F.struct((end - F.length(x["whole"])).alias("start"), F.lit(no).alias("no"), end.alias("end"), F.lit(kind).alias("kind"), x["inner"].alias("value"), x["to"]["bytes"].alias("to"))

    parts = _let(F.struct(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), inner.alias("inner")), placed)
    fits = F.filter(parts, lambda x: x["whole"].isNotNull() & (F.length(x["inner"] if measured else x["whole"]) >= least))
    return F.transform(fits, span)


def candidates(text: Column) -> Column:
    """All spans of a text by start, then kind; null, empty and harmless texts have none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    found = [_spans(text, i, *kind) for i, kind in enumerate((*BASE, *ADDED))]
    return F.when(text.rlike(HINT), F.array_sort(F.concat(*found))).otherwise(F.expr(f"CAST(array() AS array<{SPAN}>)"))


def ownership(values: DataFrame) -> DataFrame:
    """hash, shared, n: for each candidate value whether many owners or repositories have it, and how many rows do.

    values has hash, owner and repository. A value's owners and repositories are counted before they
    are made distinct, so a value that a third of all documents copies makes few rows.
    """
    held = values.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    counted = held.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"), F.sum("n").alias("n"))
    return counted.select("hash", ((F.col("owners") >= OWNERS) | (F.col("repositories") >= REPOSITORIES)).alias("shared"), "n")


def examples(some: DataFrame) -> DataFrame:
    """key, examples: for each key of rows with spans the hashes of its values that are copied examples.

    some has key, owner, repository and spans. The values that many rows have are joined apart from the others.
    """
    hashes = F.array_distinct(F.transform("spans", lambda s: F.sha2(s["value"], 256)))
    values = some.select("key", "owner", "repository", F.explode(hashes).alias("hash"))
    owned = checkpointed(ownership(values))
    total = owned.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = join_hot(values.select("key", "hash"), owned.where("shared").select("hash", "n"), "hash", "n", total)
    return found.groupBy("key").agg(F.collect_set("hash").alias("examples"))


def _candidates_of(docs: DataFrame, text_col: str, owner: Column | None, repository: Column | None, *keys: Column) -> DataFrame:
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    return docs.select(*keys, owner.alias("owner"), repository.alias("repository"), candidates(F.col(quoted(text_col))).alias("spans"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """id, spans, shared: every row's spans and, in step with them, whether a span's value is a copied example.

    owner is the documents' `source` and repository their source and language, if not given. Null and empty texts have
    no spans; null ids are kept; each row keeps its own spans, whatever its id; an empty table gives no rows.
    A value is an example if OWNERS owners or REPOSITORIES repositories have it anywhere in docs.
    """
    ids = F.col(quoted(id_col)).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("key")
    rows = checkpointed(_candidates_of(docs, text_col, owner, repository, *ids))
    some = rows.where(F.size("spans") > 0)
    judged = some.join(examples(some), "key", "left").select(
        "id", "spans",
        F.transform("spans", lambda s: F.coalesce(F.array_contains("examples", F.sha2(s["value"], 256)), F.lit(False))).alias("shared"),
    )
    none = rows.where(F.size("spans") == 0).select("id", "spans", F.expr("CAST(array() AS array<boolean>)").alias("shared"))
    return judged.union(none)


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, mark: str) -> Column:
    """The text with the mark in place of each span's value; values that overlap have one mark.

    Pieces are cut by places in bytes, each from where the values before it end at the latest, so the work grows with the text and not
    with its square.
    """
    places = F.array_sort(F.transform(spans, lambda s: F.struct((s["to"] - F.octet_length(s["value"])).alias("start"), s["to"].alias("end"))))
    cut = lambda whole, a, n: F.substring(whole, a + 1, n).cast("string")

    def put(p: Column) -> Column:
        ends = _running(F.transform(p["places"], lambda x: x["end"]), F.lit(0), lambda x, y: F.greatest(x, y))
        last = F.coalesce(F.array_max(F.transform(p["places"], lambda x: x["end"])), F.lit(0))
        each = F.zip_with(p["places"], F.concat(F.array(F.lit(0)), ends), lambda x, at: F.when(x["start"] >= at, F.concat(cut(p["text"], at, x["start"] - at), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(each, ""), cut(p["text"], last, F.octet_length(p["text"])))

    return _let(F.struct(text.cast("string").cast("binary").alias("text"), places.alias("places")), put)


def without_live_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", owner: Column | None = None, repository: Column | None = None
) -> DataFrame:
    """docs with the values of owner-specific secrets in the texts replaced by the mark; widely copied examples stay.

    Only the found places of a row change, not the same letters elsewhere. Rows are told apart by id and text, so those with
    null ids don't mask one another. Texts are looked through once; then only rows that can hold a live secret are shuffled.
    """
    names = docs.columns
    held = docs.select(F.struct(F.lit(0).alias("_"), *columns(docs, text_col)).alias("row"), F.col(quoted(text_col)).alias("text"))
    id_ = F.col(f"row.{quoted(id_col)}").cast("string")
    held = held.withColumn("sum", F.xxhash64(id_, F.col("text").cast("string")))
    key = F.md5(F.concat(F.coalesce(F.concat(id_, F.lit(" ")), F.lit("")), F.col("text").cast("string")).cast("binary"))
    owner = F.col("row.source") if owner is None else owner
    repository = F.concat_ws("/", "row.source", "row.lang") if repository is None else repository
    some = checkpointed(_candidates_of(held, "text", owner, repository, F.col("sum"), key.alias("key")).where(F.size("spans") > 0))
    once = some.groupBy("key").agg(F.min("sum").alias("sum"), F.first("spans").alias("spans"), F.count("*").alias("n"))
    live = F.filter("spans", lambda s: ~F.coalesce(F.array_contains("examples", F.sha2(s["value"], 256)), F.lit(False)))
    found = checkpointed(once.join(examples(some), "key", "left").select("key", "sum", live.alias("live"), "n").where(F.size("live") > 0))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    maybe, never = sieved(held, found.select("sum"), "sum")
    maybe = maybe.withColumn("key", key)
    hit = join_hot(maybe, found.select("key", "live", "n"), "key", "n", total)
    rest = maybe.join(found.select("key"), "key", "left_anti")
    text = F.col("text")
    done = hit.select(*out_of_row(names, {text_col: masked(text, F.col("live"), mark)}))
    return done.unionAll(rest.unionByName(never, allowMissingColumns=True).select(*out_of_row(names, {text_col: text})))
