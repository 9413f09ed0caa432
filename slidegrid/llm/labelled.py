"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidegrid.llm.common import quoted


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether a document is kept for testing: the remainder of the CRC-32 of its id as text is `part`. id_col: a column as it is written in expressions."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def chosen(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: dict[int, int], id_col: str = "doc_id", text_col: str = "text", longest: int | None = None) -> DataFrame:
    """id, text, label: at most most[v] documents with label v, those of least hash of id among the rows to learn from.

    The labels are cut first, so what is joined to the documents is bounded by `most`, whatever the
    tables' size. Of an id with several labels the largest counts; of rows with one id the text that is least in order, before
    rows move. Texts of more than `longest` bytes are left out.
    """
    own = F.col(quoted(id_col))
    known = labels.select(own.cast("bigint").alias(id_col), F.col(quoted(label)).cast("int").alias("label")).where(own.isNotNull() & F.col("label").isNotNull())
    known = known.where(learn).select(own.alias("id"), "label").groupBy("id").agg(F.max("label").alias("label"))
    parts = [known.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(n) for v, n in most.items()]
    few = parts[0]
    for x in parts[1:]:
        few = few.union(x)
    texts = docs.select(own.cast("bigint").alias("id"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    if longest:
        texts = texts.where(F.octet_length("text") <= longest)
    return texts.join(F.broadcast(few), "id").groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "text", "label")
