"""A corpus pipeline of five stages, each over all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidegrid.llm import bpe, packing, secrets, simhash, substring, toxicity
from slidegrid.llm.common import checkpointed, out_of_row, sieved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.3. Null and empty texts score as no words do; repeated rows and null ids are rows like others."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = toxicity.toxicity(docs, labels).where("predicted = 0")
    return kept.select(*out_of_row(docs.columns, {"text": F.col("text")}))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    First by SimHash of runs of four words, as in op10: fingerprints of four or fewer differing bits link. Then, among what stays, by sets of
    five-word runs of a similarity of 0.8 or more, which can lie further apart in bits; pairs come from an exact prefix filter. Rows with one
    id stay or go together; null ids and texts without words stay. Rows whose id cannot be among those that go are not shuffled.
    """
    worded = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    docs = checkpointed(_without(docs, simhash.near_duplicates(worded, words=4, budget=4, as_one=True).where("id > component").select("id").distinct()))
    return _without(docs, simhash.similar_documents(docs, words=5, similarity=0.8).where("id != component").select("id"))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is not among these distinct ones."""
    found = checkpointed(ids)
    maybe, kept = sieved(docs, found, "doc_id")
    return kept.unionByName(maybe.join(found, maybe["doc_id"].cast("bigint") == found["id"], "left_anti"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents with smaller ids have; documents of which nothing stays go.

    Texts from which nothing goes stay as they are, but null ones become empty; a null id counts as the largest; rows with one id are one document.
    """
    kept = substring.without_repeats(docs, window=13, tidy=False).where("n_removed = 0 OR kept != ''")
    text = F.col("kept")
    return kept.select(*out_of_row(docs.columns, {"text": text, "n_chars": F.length(text).cast("bigint")}))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with owner-specific secrets masked; widely copied examples stay. Null and empty texts and null ids stay."""
    return secrets.without_live_secrets(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of several lengths, in tokens of the BPE vocabulary."""
    tokens = bpe.counted(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.packed(tokens, id_col="id", length=F.col("n")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack),
]

#: No SQL can express the model of the first stage; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
