"""Text quality by a vote of the nearest labelled documents in a latent-semantic space.

The space's terms are hashed words, shapes of words, pairs of shapes, lengths and repeats.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slidegrid.llm import common as c
from slidegrid.llm.labelled import chosen, held_out

#: Labelled documents that vote at most, by label; the vectors are broadcast.
LEARN = {0: 2000, 1: 4000}
SHAPES, PAIRS, LENGTHS, WORDS, WIDTH, NEIGHBOURS = 1024, 512, 24, 512, 32, 15
TERMS = SHAPES + PAIRS + LENGTHS + WORDS + 3
#: Classes of bytes for the shape of a word: A for capitals, a for other letters, 0 for digits, else the byte.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[0x80:] = ord("a")
_CLASS[ord("0") : ord("9") + 1] = ord("0")


@dataclass
class Space:
    """What turns term counts into vectors, and the labelled documents' vectors and labels."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of words, shapes of words, pairs of shapes, lengths of words, and repeated words and lines, one row a text."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    starts, ends, first = c.words(data, offsets)
    if not len(starts):
        return out
    doc = np.repeat(np.arange(n), np.diff(first))
    kinds = _CLASS[data]
    begin = np.zeros(len(data) + 1, bool)
    begin[starts] = True
    stay = np.r_[True, kinds[1:] != kinds[:-1]] | begin[:-1]
    place = np.r_[0, np.cumsum(stay)]
    shape = c.slice_hashes(c.sums_before(kinds[stay], 11), place[starts], place[ends])
    base = doc * np.int64(TERMS)
    at = [base + (shape % np.uint64(SHAPES)).astype(np.int64)]
    same_text = doc[1:] == doc[:-1]
    pair = c.joined(shape[:-1], shape[1:])[same_text]
    at.append(base[1:][same_text] + SHAPES + (pair % np.uint64(PAIRS)).astype(np.int64))
    at.append(base + SHAPES + PAIRS + np.minimum(ends - starts, LENGTHS) - 1)
    word = c.slice_hashes(c.sums_before(data, 12), starts, ends)
    at.append(base + SHAPES + PAIRS + LENGTHS + (word % np.uint64(WORDS)).astype(np.int64))
    again = same_text & (word[1:] == word[:-1])
    at.append(base[1:][again] + TERMS - 3)
    line_starts, line_ends, line_first = c.words(data, offsets, c.byte_set((10, 10)))
    line = c.slice_hashes(c.sums_before(data, 13), line_starts, line_ends)
    line_doc = np.repeat(np.arange(n), np.diff(line_first))
    order = np.lexsort((line, line_doc))
    repeated = (line[order][1:] == line[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    lines = line_doc[order][1:][repeated]
    out += np.bincount(np.concatenate(at), minlength=n * TERMS).reshape(n, TERMS)
    out /= np.maximum(np.diff(first), 1)[:, None]
    out[:, TERMS - 2] = np.bincount(lines, minlength=n) / np.maximum(np.diff(line_first), 1)
    out[:, TERMS - 1] = np.log1p(np.diff(first)) / 10
    return out


def embedded(weights: np.ndarray, axes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Unit vectors in the latent space (texts without terms have zeros)."""
    v = (np.sqrt(counts) * weights) @ axes
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def all_terms(column: pa.Array) -> Iterator[np.ndarray]:
    data, offsets = c.text_bytes(column)
    for a, b in c.steps(offsets, c.STEP // 2):
        for k in range(a, b, 1024):
            m = min(b, k + 1024)
            yield terms(data[offsets[k] : offsets[m]], offsets[k : m + 1] - offsets[k])


def fit(counts: np.ndarray, labels: np.ndarray) -> Space:
    """Term weights by rarity, and the axes of the largest singular values of the labelled documents' terms (one row a document)."""
    prior = float(labels.mean()) if len(labels) else 0.5
    if not len(counts):
        return Space(np.ones(TERMS), np.zeros((TERMS, WIDTH)), np.zeros((0, WIDTH), np.float32), labels.astype(float), prior)
    weights = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 0.5
    x = np.sqrt(counts) * weights
    _, vectors = np.linalg.eigh(x.T.astype(np.float64) @ x)
    axes = vectors[:, ::-1][:, :WIDTH]
    return Space(weights, axes, embedded(weights, axes, counts), labels.astype(float), prior)


def fitted(known: DataFrame) -> Space:
    """The space of the chosen documents: their terms are counted where they are read, and the axes found in one task.

    A document brings TERMS numbers there, however long it is, and the driver gets the space, whose size is bounded by LEARN.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.zeros((0, TERMS), np.float32), *all_terms(b.column(1))]
            out = pa.array([r.tobytes() for r in np.concatenate(rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), out, b.column(2)], ["id", "terms", "label"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("id", pa.int64()), ("terms", pa.binary()), ("label", pa.int32())])).sort_by("id")
        counts = np.frombuffer(b"".join(table["terms"].to_pylist()), np.float32).reshape(-1, TERMS)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(counts, table["label"].to_numpy()))])], ["space"])

    counted = known.select("id", "text", "label").mapInArrow(count, "id bigint, terms binary, label int")
    found = counted.repartition(1).mapInArrow(learn, "space binary").collect()
    return pickle.loads(found[0].space) if found else fit(np.zeros((0, TERMS)), np.zeros(0))


def vote(space: Space, vectors: np.ndarray, sharp: float = 40.0) -> np.ndarray:
    """Mean label of the nearest labelled vectors, weighted by their cosine similarity, with one vote for the prior."""
    if not len(space.vectors):
        return np.full(len(vectors), space.prior)
    out = np.zeros(len(vectors))
    k = min(NEIGHBOURS, len(space.vectors))
    for a in range(0, len(vectors), 512):
        cosine = vectors[a : a + 512] @ space.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.exp(sharp * (np.take_along_axis(cosine, near, 1) - 1))
        out[a : a + 512] = ((weight * space.labels[near]).sum(1) + 0.2 * space.prior) / (weight.sum(1) + 0.2)
    return out


def quality(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, held_out, score, predicted: every row of docs (without its text, as a struct) with its score from 0 to 1.

    Votes come from at most LEARN labelled documents that are not held out; their vectors are broadcast,
    and the exact cosine with each of them is computed for every document, block by block. Scores depend
    on the text alone; null and empty texts get the prior's score; without labels all scores are 0.5;
    an empty table gives no rows.
    """
    known = chosen(docs, labels, "quality", ~held_out(c.quoted(id_col), parts, part), LEARN, id_col, text_col)
    space = docs.sparkSession.sparkContext.broadcast(fitted(known))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = space.value
            found = [vote(s, embedded(s.weights, s.axes, x)) for x in all_terms(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([np.zeros(0), *found]))], ["row", "score"])

    kept = c.in_row(docs, text_col)
    scored = kept.mapInArrow(work, T.StructType([kept.schema["row"], T.StructField("score", T.DoubleType())]))
    return scored.select("row", held_out(f"row.{c.quoted(id_col)}", parts, part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
