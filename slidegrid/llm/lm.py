"""Language-model scores: exact counts of the corpus, and a log-bilinear model trained by noise-contrastive estimation."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slidegrid.llm import common as c
from slidegrid.llm.common import checkpointed, columns, quoted

#: Words of more bytes than this go by a name of 17 bytes; it starts with a blank, which no word has.
LONGEST = 64
#: Words with more than this share of all tokens are known to every task, so they are fewer than its inverse.
HOT = 1 << 19
#: Words with an output unit of their own, classes of all other words by how they end, words with a vector of their own.
SINGLES, CLASSES, ROWS = 128, 64, 4096
UNITS, PAD = SINGLES + CLASSES, ROWS + CLASSES
#: Size of the vectors, words of context, noise samples of a step, and tokens of a step.
DIMS, CONTEXT, NOISE, STEP = 24, 3, 64, 512
ROUNDS, RATE, SEED = 1, 0.15, 13
#: Tokens that are scored together, words that a task counts before it hands them on, and parts in which parameters are averaged.
BLOCK, MOST, PARTS = 1024, 1 << 20, 16
END = b""


def tokens(text: bytes | None) -> list[bytes]:
    """The words of the text with A-Z in lower case, and the end."""
    return [*(text or b"").lower().split(), END]


def name(word: bytes) -> bytes:
    return word if len(word) <= LONGEST else b" " + xxhash.xxh3_128_digest(word)


def kind(called: bytes) -> int:
    """The class of a word: what its last two bytes are."""
    return zlib.crc32(called[-2:]) % CLASSES


def counts(docs: DataFrame) -> DataFrame:
    """name, kind, n of every token of all texts. Each task counts its words before they are shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").cast(pa.large_binary()):
                words = tokens(text.as_py())
                seen.update(words if max(map(len, words)) <= LONGEST else map(name, words))
            if len(seen) > MOST:
                yield told(seen)
                seen.clear()
        yield told(seen)

    def told(seen: Counter) -> pa.RecordBatch:
        words = list(seen)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(map(kind, words), pa.int32()), pa.array(seen.values(), pa.int64())], ["name", "kind", "n"])

    return docs.select("text").mapInArrow(work, "name binary, kind int, n bigint").groupBy("name", "kind").agg(F.sum("n").alias("n"))


class Codes(dict):
    """Numbers of the words that every task knows; any other word has the number of its class, after them."""

    def __missing__(self, word: bytes) -> int:
        called = name(word)
        return self.get(called, -1) if called is not word and called in self else self.known + kind(called)


@dataclass
class Vocabulary:
    """Rows, units and shares of words by their code: those that every task knows by frequency, then the classes of the others."""

    words: list[bytes]
    #: Training tokens and distinct ones, and, for each class, those that have no unit of their own.
    total: int
    distinct: int
    class_total: np.ndarray
    class_distinct: np.ndarray
    row: np.ndarray
    unit: np.ndarray
    #: Logarithms of a word's share in the corpus and in its class; zero for words that not every task knows.
    base: np.ndarray
    within: np.ndarray
    #: Shares of the units, which are the noise.
    noise: np.ndarray

    def codes(self) -> Codes:
        out = Codes({w: i for i, w in enumerate(self.words)})
        out.known = len(self.words)
        return out

    def base_denominator(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def class_denominators(self) -> np.ndarray:
        return self.class_total + 0.5 * (self.class_distinct + 1)


def vocabulary(counted: DataFrame) -> Vocabulary:
    """What tasks have to know of the counts: fewer than HOT words and figures of the classes."""
    by_class = np.zeros((2, CLASSES), np.int64)
    for k, n, v in counted.groupBy("kind").agg(F.sum("n"), F.count("*")).collect():
        by_class[:, k] = n, v
    total, distinct = by_class.sum(1).tolist()
    hot = sorted((-r.n, bytes(r.name)) for r in counted.where(F.col("n") > total // HOT).select("name", "n").collect())
    words, n = [w for _, w in hot], np.array([-x for x, _ in hot], np.float64)
    kinds = np.array([kind(w) for w in words], np.int64)
    rank = np.arange(len(words))
    for k, c in zip(kinds[:SINGLES], n[:SINGLES], strict=True):
        by_class[:, k] -= int(c), 1
    classes = np.arange(CLASSES)
    row = np.r_[np.where(rank < ROWS, rank, ROWS + kinds), ROWS + classes]
    unit = np.r_[np.where(rank < SINGLES, rank, SINGLES + kinds), SINGLES + classes]
    out = Vocabulary(words, total, distinct, by_class[0], by_class[1], row, unit, np.zeros(len(row)), np.zeros(len(row)), np.zeros(UNITS))
    out.base[: len(words)] = np.log10((n + 0.5) / out.base_denominator())
    out.within[: len(words)] = np.where(rank < SINGLES, 0.0, np.log10((n + 0.5) / out.class_denominators()[kinds]))
    share = np.r_[np.full(SINGLES, 1e-30), by_class[0] + 0.5]  # units that no word has count for nothing
    share[: min(len(n), SINGLES)] = n[:SINGLES] + 0.5
    out.noise = share / share.sum()
    return out


class Model:
    """score(unit | context) = (sum of the context words' vectors, each times its place's matrix) times the unit's vector, plus its bias."""

    shapes = (((PAD + 1), DIMS), (CONTEXT, DIMS, DIMS), (UNITS, DIMS), (UNITS,))
    size = sum(int(np.prod(s)) for s in shapes)

    def __init__(self, flat: np.ndarray) -> None:
        self.flat = np.array(flat, np.float32)
        cuts = np.cumsum([int(np.prod(s)) for s in self.shapes])[:-1]
        self.rows, self.places, self.units, self.bias = (x.reshape(s) for x, s in zip(np.split(self.flat, cuts), self.shapes, strict=True))

    def __reduce__(self) -> tuple:
        return Model, (self.flat,)

    @classmethod
    def start(cls, noise: np.ndarray) -> Model:
        """Small random vectors, the identity for each place, and the noise as biases: the unigram model."""
        rng = np.random.default_rng(SEED)
        out = cls(np.zeros(cls.size))
        out.rows[:] = rng.normal(0, 0.1, out.rows.shape)
        out.places[:] = np.eye(DIMS)
        out.units[:] = rng.normal(0, 0.1, out.units.shape)
        out.bias[:] = np.log(noise)
        return out

    def gradients(self, context: np.ndarray, target: np.ndarray, noise: np.ndarray, drawn: np.ndarray, out: Model | None = None) -> np.ndarray:
        """Of the noise-contrastive loss: is a unit the next word's, or one of NOISE drawn from the noise?

        Units that are neither drawn nor a target have no gradient, so products go with the drawn ones and each token's own.
        They are written over what `out` holds, if it is given.
        """
        out = out or Model(np.zeros(self.size))
        out.flat[:] = 0
        n, some = np.float32(len(target)), np.flatnonzero(drawn)
        p = self.rows.take(context, axis=0).reshape(len(target), -1)
        places = self.places.reshape(-1, DIMS)
        q = p @ places
        odds = np.log(NOISE * noise).astype(np.float32) - self.bias
        mine, few = self.units.take(target, axis=0), self.units[some]
        with np.errstate(over="ignore"):
            off = drawn[some].astype(np.float32) / n / (1 + np.exp(odds[some] - q @ few.T))
            own = (1 / (1 + np.exp(odds[target] - np.einsum("ij,ij->i", q, mine))) - 1) / n
        out.units[some] = off.T @ q
        out.bias[some] = np.ones(len(off), np.float32) @ off
        _scatter(out.units, target, own[:, None] * q)
        np.add.at(out.bias, target, own)
        back = off @ few + own[:, None] * mine
        out.places[:] = (p.T @ back).reshape(out.places.shape)
        _scatter(out.rows, context, back @ places.T)
        return out.flat

    def train(self, steps: Iterator[tuple[np.ndarray, np.ndarray]], noise: np.ndarray, seed: int) -> int:
        """Steps of AdaGrad; returns how many tokens they had."""
        rng, seen, squared, move = np.random.default_rng(seed), 0, np.full(self.size, 1e-6, np.float32), np.empty(self.size, np.float32)
        upto, out = np.cumsum(noise), Model(np.zeros(self.size))
        upto /= upto[-1]
        for context, target in steps:
            g = self.gradients(context, target, noise, np.bincount(upto.searchsorted(rng.random(NOISE), "right"), minlength=UNITS), out)
            np.multiply(g, g, out=move)
            squared += move
            np.sqrt(squared, out=move)
            np.divide(g, move, out=move)
            move *= RATE
            self.flat -= move
            seen += len(target)
        return seen

    def log10(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised log-probabilities of the targets: products with all units, a block at a time."""
        tables = [self.rows @ self.places[k] for k in range(CONTEXT)]
        out = np.empty(len(target))
        for a in range(0, len(target), BLOCK):
            c, t = context[a : a + BLOCK], target[a : a + BLOCK]
            q = tables[0].take(c[:, 0], axis=0)
            for k in range(1, CONTEXT):
                q += tables[k].take(c[:, k], axis=0)
            s = q @ self.units.T
            s += self.bias
            if s.max() > 60:  # beyond what single precision adds up safely
                s -= s.max(1, keepdims=True)
            own = s[np.arange(len(t)), t].astype(np.float64)
            np.exp(s, out=s)
            out[a : a + BLOCK] = own - np.log(s @ np.ones(UNITS, np.float32), dtype=np.float64)
        return out / np.log(10)


def _scatter(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add DIMS values each to rows of a table, which may repeat."""
    np.add.at(table.reshape(-1), (rows.astype(np.intp).reshape(-1, 1) * DIMS + np.arange(DIMS)).reshape(-1), values.reshape(-1))


def contexts(code: np.ndarray, first: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """The rows of the CONTEXT words before each token; what lies before a text is PAD."""
    at = np.arange(len(code))
    place = at - np.repeat(first[:-1], np.diff(first))
    row = vocab.row[code]
    out = np.empty((len(code), CONTEXT), np.int32)
    for k in range(CONTEXT):
        out[:, k] = np.where(place > k, row[np.maximum(at - k - 1, 0)], PAD)
    return out


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """docs with two columns in place of the text: code, its tokens' codes as 32-bit numbers, and rare, the name and n of tokens with the code of a class.

    Tasks handle some ten thousand tokens at a time, or one longer text.
    """
    kept = [x for x in docs.columns if x != "text"]
    rare = T.ArrayType(T.StructType([T.StructField("name", T.BinaryType()), T.StructField("n", T.IntegerType())]))
    out = T.StructType([*docs.select(*kept).schema, T.StructField("code", T.BinaryType()), T.StructField("rare", rare)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = vocab.codes()
        for batch in batches:
            held, n, done = [], 0, 0
            for text in batch.column("text").cast(pa.large_binary()):
                held.append(tokens(text.as_py()))
                n += len(held[-1])
                if n >= 1 << 16 or done + len(held) == batch.num_rows:
                    yield told(batch.slice(done, len(held)), held, codes)
                    done += len(held)
                    held, n = [], 0

    def told(batch: pa.RecordBatch, held: list[list[bytes]], codes: Codes) -> pa.RecordBatch:
        first = np.r_[0, np.cumsum([len(x) for x in held])]
        code = np.fromiter(map(codes.__getitem__, chain.from_iterable(held)), np.int32, int(first[-1]))
        names, often, size = [], [], []
        for words, a, b in zip(held, first[:-1].tolist(), first[1:].tolist(), strict=True):
            new = Counter(name(words[i]) for i in np.flatnonzero(code[a:b] >= codes.known).tolist())
            names += new
            often += new.values()
            size.append(len(new))
        words = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(often, pa.int32())], ["name", "n"])
        coded = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer((4 * first).astype(np.int32)), pa.py_buffer(code)])
        arrays = [*(batch.column(x) for x in kept), coded, pa.ListArray.from_arrays(np.r_[0, np.cumsum(size)].astype(np.int32), words)]
        return pa.RecordBatch.from_arrays(arrays, [*kept, "code", "rare"])

    return docs.mapInArrow(work, out)


def _blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of texts, of some ten thousand tokens or of one longer text, and where texts start."""
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    first = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 4
    code = np.frombuffer(column.buffers()[2], np.int32)
    for a, b in c.steps(first, 1 << 16):
        yield code[first[a] : first[b]], first[a : b + 1] - first[a]


def averaged(docs: DataFrame, vocab: Vocabulary, model: Model, turn: int) -> Model:
    """The mean of the models that the tasks train, from this one on, on their texts' codes; each counts as its tokens do.

    A turn takes every token of every text once. Models are averaged in PARTS, and first in groups of tasks, so no task gets more than
    some thousands of parts.
    """
    size = -(-Model.size // PARTS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(model.flat)
        number = 0

        def steps() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            nonlocal number
            left = np.zeros((0, CONTEXT), np.int32), np.zeros(0, np.int64)
            for batch in batches:
                number += batch.num_rows
                for code, first in _blocks(batch.column("code")):
                    left = np.r_[left[0], contexts(code, first, vocab)], np.r_[left[1], vocab.unit[code]]
                    whole = len(left[1]) // STEP * STEP
                    for a in range(0, whole, STEP):
                        yield left[0][a : a + STEP], left[1][a : a + STEP]
                    left = left[0][whole:], left[1][whole:]
            if len(left[1]):
                yield left

        seen = own.train(steps(), vocab.noise, SEED + turn)
        if seen:
            flat = np.zeros(size * PARTS)
            flat[: Model.size] = own.flat
            parts = pa.array(list(flat.reshape(PARTS, size)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([number % 64] * PARTS, pa.int32()), pa.array([float(seen)] * PARTS), parts], ["part", "team", "weight", "v"])

    trained = docs.select("code").mapInArrow(work, "part int, team int, weight double, v array<double>").withColumn("v", array_to_vector("v"))
    team = trained.groupBy("part", "team").agg(Summarizer.mean(F.col("v"), F.col("weight")).alias("v"), F.sum("weight").alias("weight"))
    mean = team.groupBy("part").agg(Summarizer.mean(F.col("v"), F.col("weight")).alias("v")).select("part", vector_to_array("v").alias("v"))
    found = {r.part: r.v for r in mean.collect()}
    return Model(np.concatenate([found[i] for i in range(PARTS)])[: Model.size]) if found else model


def trained(docs: DataFrame, vocab: Vocabulary) -> Model:
    """The model of the texts, or of their codes if they are encoded."""
    model = Model.start(vocab.noise)
    for turn in range(ROUNDS if vocab.total else 0):
        model = averaged(docs if "code" in docs.columns else encoded(docs.select("text"), vocab), vocab, model, turn)
    return model


def scored(docs: DataFrame, learn: Column, text_col: str = "text") -> tuple[DataFrame, Vocabulary]:
    """row, learnt, n_tokens, n_known, base_score, score of every row of docs; and the vocabulary of those of which `learn` holds.

    Tokens are words parted by blanks and 0x09 to 0x0D, with A-Z in lower case, and one end. base_score adds the logarithms (to 10) of the tokens' shares in the
    training tokens, with half a token more for each distinct one and for one unknown. score is the model's: the probability of the
    next unit from the last CONTEXT words (the commonest words are units, all others are classes by their ending), times the word's
    share in its class, smoothed alike; so probabilities add up to one over all words and an unknown one for each class.

    Counts cover all training texts. Words with at most 1 / HOT of all tokens are looked up by a join, the others are known to every task, so no key of
    the join is hot. Every task trains on its own texts; the models are averaged. Null and empty texts have the end alone; a null `learn` counts as
    false; repeated rows count each; with no training texts every word is unknown; an empty table gives no rows. Texts of any length are whole.
    row is a struct of the other columns, so no names clash.
    """
    row = F.struct(F.lit(0).alias("_"), *columns(docs, text_col)).alias("row")
    held = docs.select(row, F.col(quoted(text_col)).cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learnt"))
    known = held.where("learnt")
    counted = checkpointed(counts(known))
    vocab = vocabulary(counted)
    coded = checkpointed(encoded(held.withColumn("key", F.monotonically_increasing_id()), vocab))
    model = trained(coded.where("learnt"), vocab)
    figures = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    kept = ["row", "learnt", "key"]
    out = T.StructType([*coded.select(*kept).schema, *[T.StructField(*x) for x in figures]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for code, first in _blocks(batch.column("code")):
                own = model.log10(contexts(code, first, vocab), vocab.unit[code]) + vocab.within[code]
                add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731, B023
                found.append((np.diff(first), add((code < len(vocab.words)).astype(np.int64)), add(vocab.base[code]), add(own)))
            if found:
                values = [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), *values], [*kept, *(x for x, _ in figures)])

    part = coded.select(*kept, "code").mapInArrow(work, out)
    share = F.array(*[F.lit(float(x)) for x in vocab.class_denominators()])
    smooth = F.coalesce("c", F.lit(0)) + 0.5
    seen = coded.select("key", F.explode("rare").alias("x")).select("key", "x.*").join(counted.select("name", F.col("n").alias("c")), "name", "left")
    kind_here = (F.crc32(F.substring("name", -2, 2)) % CLASSES).cast("int") + 1
    sums = seen.groupBy("key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * F.log10(smooth / vocab.base_denominator())).alias("b"),
        F.sum(F.col("n") * F.log10(smooth / F.element_at(share, kind_here))).alias("s"),
    )
    plus = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return part.join(sums, "key", "left").select("row", "learnt", "n_tokens", plus("n_known", "k"), plus("base_score", "b"), plus("score", "s")), vocab
