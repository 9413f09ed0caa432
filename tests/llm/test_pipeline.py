"""Stages of the corpus pipeline, each on its own input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from slidegrid.llm import simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_keep_the_columns(spark, docs):
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_near_copies_leave_one(spark, docs):
    twice = docs.union(docs.select((F.col("doc_id") + 100000).alias("doc_id"), F.concat("text", F.lit(" ")), "lang", "source", "n_chars"))
    kept = {r.doc_id for r in p.drop_near_copies(spark, twice, SF).collect()}
    assert kept == {r.doc_id for r in p.drop_near_copies(spark, docs, SF).collect()}


def test_whole_copies_go_in_the_substring_stage(spark, docs):
    twice = docs.union(docs.select((F.col("doc_id") + 100000).alias("doc_id"), "text", "lang", "source", "n_chars"))
    kept = p.drop_repeats(spark, twice, SF).where("doc_id >= 100000").join(docs.select((F.col("doc_id") + 100000).alias("doc_id"), F.size(F.split(F.trim("text"), r"\s+")).alias("n")), "doc_id")
    assert kept.where("n >= 13").count() == 0


def test_run_gives_each_document_a_place(spark):
    rows = p.run(spark, SF).toPandas()
    assert len(rows) and rows.groupby("bin").n_tokens.sum().max() <= 8192


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with labels, and documents with nulls, empty, long and repeated texts, and extra columns."""
    folder = str(tmp_path_factory.mktemp("odd"))
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", passage, passage, "token=onlyhere1234567 " * 2, "long " * 30000, " \n "]
    rows = [(i, t, "en", "s1", None, i, "x") for i, t in enumerate(texts)] + [(None, passage, None, None, 1, 9, "y"), (3, passage, "en", "s1", 1, 3, "x"), (None, None, None, None, None, 8, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, `a.b` int, _key string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_pass_every_stage(spark, odd, empty):
    docs = spark.read.parquet(f"{odd}/documents.parquet").where("false" if empty else "true")
    for name, stage in p.STAGES:
        out = stage(spark, docs, odd)
        if name == "best_fit_packing":
            assert out.count() == (0 if empty else docs.count() + 3)
            return
        assert out.columns == docs.columns
        rows = sorted((r["a.b"], r.text) for r in out.collect())
        assert len(rows) == (0 if empty else {"toxicity": 10, "simhash_near_dedup": 8, "substring_dedup": 7, "secret_scans": 10}[name]), (name, rows)


def test_stages_in_a_row(spark, odd):
    assert p.run(spark, odd).count() > 0


def test_near_copies_go_by_simhash_and_by_sets(spark):
    """Of texts whose fingerprints are near, or whose sets of runs are similar, and of rows with one id that link others, one stays."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(5000)}" for _ in range(120)]
    # many repeats of one run weigh in a fingerprint, but count once in a set; a word changed here and there is within 0.8 of the set
    heavy = ["same"] * 200
    tail = [" ".join(f"{x}{i}" for i in range(25)) for x in "ab"]
    few = [*words[:30], "other", *words[31:]]
    rows = [(1, " ".join([*heavy, tail[0]])), (2, " ".join([*heavy, tail[1]])), (3, " ".join(words)), (4, " ".join(few)), (5, "alone here as a text"), (8, "Alone here as a  text"), (8, "and this other one too"), (6, "and this other one too"), (7, "x y"), (9, " "), (10, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    by_simhash = {r.id for r in simhash.near_duplicates(docs.where("doc_id < 3"), 4, 4).where("id > component").collect()}
    by_sets = {r.id for r in simhash.similar_documents(docs.where("doc_id < 3")).where("id > component").collect()}
    assert by_simhash == {2} and not by_sets
    assert sorted(r.doc_id for r in p.drop_near_copies(spark, docs, SF).collect()) == [1, 3, 5, 7, 9, 10]
