"""Toxicity: texts as averages of their words, words as averages of their character n-grams, and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slidegrid.llm import common as c
from slidegrid.llm.labelled import chosen, held_out

#: Documents that the model learns from at most, by label, and the bytes of the longest that it learns from.
LEARN, LONGEST = {0: 6000, 1: 1500}, 1 << 16
BUCKETS = 1 << 20
WIDTH = 2
DECAY = np.float32(1e-5)
#: Documents that an n-gram must be held by to start at half of its log-odds.
SHRINK = 10
#: Rows that training handles at a time.
PIECE = 1 << 18
#: Bytes that part words: all of ASCII but a to z (texts are lower-cased).
APART = c.byte_set((0, 0x60), (0x7B, 0x7F))


@dataclass
class Model:
    """What n-grams add to the difference of the two logits, and the bias."""

    ngrams: np.ndarray
    bias: float


def word_ngrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, and the word of each (words in the order of their places): runs of 3 to 5 bytes, beginnings, and whole words."""
    sums = c.sums_before(data, 3)
    grams, owner = [c.slice_hashes(sums, starts, ends)], [np.arange(len(starts))]
    word = np.zeros(len(data) + 1, np.int64)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    places = np.flatnonzero(np.cumsum(inside)[:-1])
    word[starts] = 1
    word = np.cumsum(word)[places] - 1
    for n in (3, 4, 5):
        fits = places + n <= ends[word]
        grams.append(c.slice_hashes(sums, places[fits], places[fits] + n))
        owner.append(word[fits])
        long = np.flatnonzero(starts + n <= ends)
        grams.append(c.mix(c.slice_hashes(sums, starts[long], starts[long] + n) + np.uint64(n)))
        owner.append(long)
    return (np.concatenate(grams) & np.uint64(BUCKETS - 1)).astype(np.int32), np.concatenate(owner)


def word_values(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    grams, owner = word_ngrams(data, starts, ends)
    total = np.bincount(owner, model.ngrams[grams], len(starts))
    return total / np.maximum(np.bincount(owner, minlength=len(starts)), 1)


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return c.text_bytes(pc.utf8_lower(column.cast(pa.large_string())))


def score_texts(model: Model, column: pa.Array) -> np.ndarray:
    """The softmax of each text's average: of the words' averages of their n-grams."""
    data, offsets = lowered(column)
    out = np.zeros(len(offsets) - 1)
    for a, b in c.steps(offsets, c.STEP // 4):
        piece = data[offsets[a] : offsets[b]]
        starts, ends, first = c.words(piece, offsets[a : b + 1] - offsets[a], APART)
        n = np.diff(first)
        owner = np.repeat(np.arange(b - a), n)
        out[a:b] = np.bincount(owner, word_values(model, piece, starts, ends), b - a) / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(out + model.bias, -30, 30)))


class _Adam:
    def __init__(self, *shapes: tuple[int, ...]) -> None:
        self.m, self.v, self.t = [np.zeros(s, np.float32) for s in shapes], [np.zeros(s, np.float32) for s in shapes], 0

    def step(self, values: list[np.ndarray], slopes: list[np.ndarray], rate: float) -> None:
        self.t += 1
        for x, g, m, v in zip(values, slopes, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-7)


def spans(first: np.ndarray, n: int) -> Iterator[tuple[int, int, int, int]]:
    """Ranges a to b of groups that start at `first` in n rows, and their rows lo to hi: about PIECE, or one larger group."""
    for a, b in c.steps(np.r_[first, n], PIECE):
        yield a, b, int(first[a]), int(first[b]) if b < len(first) else n


class Bags:
    """Sums of rows by owner and back: `items` are the rows' numbers, in the order of their owners, `sizes` how many each owner has.

    weight has a value for each row, or one for each owner. Rows are handled piece by piece, so beside the two orders little is held.
    """

    def __init__(self, items: np.ndarray, sizes: np.ndarray, n_items: int, weight: np.ndarray, by_owner: bool = False) -> None:
        self.items, self.weight, self.by_owner = items.astype(np.int32, copy=False), weight.astype(np.float32), by_owner
        self.some, self.sizes = np.flatnonzero(sizes), sizes[sizes > 0]
        self.first = np.cumsum(self.sizes) - self.sizes
        self.n_owners, self.n_items = len(sizes), n_items
        count = np.zeros(n_items, np.int64)
        for a in range(0, len(self.items), PIECE):
            count += np.bincount(self.items[a : a + PIECE], minlength=n_items)
        self.held = np.flatnonzero(count)
        self.item_first = np.cumsum(count[self.held]) - count[self.held]
        self.owner_by_item = np.empty(len(self.items), np.int32)
        self.weight_by_item = None if by_owner else np.empty(len(self.items), np.float32)
        owner = np.repeat(self.some.astype(np.int32), self.sizes)
        for a, b, lo, hi in spans(self.item_first, len(self.items)):
            mine = np.flatnonzero((self.items >= self.held[a]) & (self.items <= self.held[b - 1]))
            mine = mine[np.argsort(self.items[mine], kind="stable")]
            self.owner_by_item[lo:hi] = owner[mine]
            if not by_owner:
                self.weight_by_item[lo:hi] = self.weight[mine]

    def forward(self, values: np.ndarray) -> np.ndarray:
        """values has a row for each dimension."""
        out = np.zeros((len(values), self.n_owners), np.float32)
        for a, b, lo, hi in spans(self.first, len(self.items)):
            own, at = self.some[a:b], self.first[a:b] - lo
            weight = np.repeat(self.weight[own], self.sizes[a:b]) if self.by_owner else self.weight[lo:hi]
            for k, v in enumerate(values):
                out[k, own] = np.add.reduceat(v[self.items[lo:hi]] * weight, at)
        return out

    def backward(self, slopes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(slopes), self.n_items), np.float32)
        if self.by_owner:
            slopes = slopes * self.weight
        for a, b, lo, hi in spans(self.item_first, len(self.items)):
            for k, v in enumerate(slopes):
                part = v[self.owner_by_item[lo:hi]]
                out[k, self.held[a:b]] = np.add.reduceat(part if self.by_owner else part * self.weight_by_item[lo:hi], self.item_first[a:b] - lo)
        return out


def train(texts: list[str] | pa.Array, labels: np.ndarray, seed: int = 7, steps: int = 30, rate: float = 0.1) -> Model:
    """Fit the n-gram vectors and the softmax together.

    A word's vector is the average of its n-grams' vectors, a text's that of its words, and the softmax is linear in it;
    each step of Adam moves n-grams, softmax and bias. The vectors start along one direction, at the log-odds with which
    documents of either label hold the n-gram. Every fifth document is left out and sets the scale of the scores. Without two
    classes to learn from, every score is the share of toxic rows.
    """
    toxic = float(labels.mean()) if len(labels) else 0.0
    if not 0 < toxic < 1:
        return Model(np.zeros(BUCKETS, np.float32), 30.0 if toxic else -30.0)
    y = labels.astype(np.int64)
    words, doc, count, grams, per_word = vocabulary(texts)
    if not len(per_word):
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(toxic / (1 - toxic))))
    n_words = len(per_word)
    learn = np.random.default_rng(seed).permutation(len(y)) % 5 != 4
    if not 0 < y[learn].mean() < 1 or not 0 < y[~learn].mean() < 1:
        learn = np.ones(len(y), bool)
    some = np.zeros(BUCKETS, bool)
    some[grams] = True
    used = np.flatnonzero(some)
    where = (np.cumsum(some, dtype=np.int32) - np.int32(1))[grams]
    del texts, grams
    length = np.maximum(np.bincount(doc, count, len(y)), 1)
    of_word = Bags(where, per_word, len(used), 1 / per_word, by_owner=True)
    of_text = Bags(words, np.bincount(doc, minlength=len(y)), n_words, count / length[doc])
    seen, held = np.zeros(len(used)), []
    for v in (0, 1):
        mine = learn[doc] & (y[doc] == v)
        by_word = np.bincount(words[mine], minlength=n_words)
        n = np.zeros(len(used))
        for a, b, lo, hi in spans(np.cumsum(per_word) - per_word, len(where)):
            n += np.bincount(where[lo:hi], np.repeat(by_word[a:b], per_word[a:b]), len(used))
        held.append((n + 1) / ((learn & (y == v)).sum() + 2))
        seen += n
    del words, doc, count, where, mine
    rng = np.random.default_rng(seed)
    way = rng.standard_normal(WIDTH)
    way /= np.linalg.norm(way)
    vectors = np.outer(way, np.log(held[1] / held[0]) * seen / (seen + SHRINK)).astype(np.float32)
    level = way @ of_text.forward(of_word.forward(vectors))
    centre = [level[learn & (y == v)].mean() for v in (0, 1)]
    slope = 6 / max(centre[1] - centre[0], 1e-3)
    top = np.stack([-way * slope / 2, way * slope / 2], 1).astype(np.float32)
    bias = np.array([1, -1], np.float32) * np.float32(slope * (centre[0] + centre[1]) / 4)
    weight = np.where(learn, np.where(y == 1, 0.5 / y[learn].mean(), 0.5 / (1 - y[learn].mean())), 0.0) / learn.sum()
    adam = _Adam(vectors.shape, top.shape, bias.shape)
    for k in range(steps):
        x = of_text.forward(of_word.forward(vectors)).T
        z = x @ top + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= weight[:, None]
        slopes = of_word.backward(of_text.backward((p @ top.T).T.astype(np.float32))) + DECAY * vectors
        adam.step([vectors, top, bias], [slopes, (x.T @ p).astype(np.float32), p.sum(0).astype(np.float32)], rate * (1 - k / steps))
    flat = (top[:, 1] - top[:, 0]) @ vectors
    value = (of_text.forward(of_word.forward(flat[None]))[0] + (bias[1] - bias[0])).astype(float)
    judged = ~learn if not learn.all() else learn
    a, b = scaled(value[judged], y[judged])
    ngrams = np.zeros(BUCKETS, np.float32)
    ngrams[used] = flat * a
    return Model(ngrams, float(bias[1] - bias[0]) * a + b)


def vocabulary(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each document's distinct words as numbers, with the document of each and how often it stands there; n-grams word by word, and how many each word has."""
    column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    known, found, grams, sizes, docs, held, often = np.zeros(0, np.uint64), [], [], [], [], [], []
    for a, b in c.steps(c.text_bytes(column)[1], c.STEP // 8):
        piece, offsets = lowered(column.slice(a, b - a))
        starts, ends, first = c.words(piece, offsets, APART)
        hashes = c.slice_hashes(c.sums_before(piece, 5), starts, ends)
        doc = np.repeat(np.arange(a, b, dtype=np.int32), np.diff(first))
        order = np.lexsort((hashes, doc))
        at = np.flatnonzero(np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])]) if len(order) else order
        keep = order[at]
        often.append(np.diff(np.r_[at, len(order)]).astype(np.int32))
        docs.append(doc[keep])
        held.append(hashes[keep])
        new, at = np.unique(hashes, return_index=True)
        fresh = np.sort(at[~c.among(new, known)])  # in the order of the text, as word_ngrams() needs them
        own, owner = word_ngrams(piece, starts[fresh], ends[fresh])
        grams.append(own[np.argsort(owner, kind="stable")])
        sizes.append(np.bincount(owner, minlength=len(fresh)))
        found.append(hashes[fresh])
        known = np.union1d(known, new)
    if not len(known):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    names = np.concatenate(found)
    order = np.argsort(names)
    names = names[order]
    words = np.concatenate([order[np.searchsorted(names, x)].astype(np.int32) for x in held])
    return words, np.concatenate(docs), np.concatenate(often), np.concatenate(grams), np.concatenate(sizes)


def scaled(value: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make logits of the values: logistic regression on slightly softened labels, which keeps it finite."""
    n1 = int(y.sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    mean, spread = value.mean(), value.std() + 1e-9
    x = np.stack([(value - mean) / spread, np.ones(len(value))], 1)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - target * z).sum() + 0.001 * w @ w)

    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.002 * np.eye(2), x.T @ (p - target) + 0.002 * w)
        while loss(w - step) > loss(w) and abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if abs(step).max() < 1e-6:
            break
    w[0] = max(w[0], 0.05)
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def fitted(known: DataFrame) -> Model:
    """The model of the chosen rows, trained in one task; only the model, whose size is fixed, reaches the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if rows:
            table = pa.Table.from_batches(rows)
            table = table.set_column(1, "text", table["text"].cast(pa.large_string())).sort_by("id").combine_chunks()
            texts, labels = table["text"].chunk(0), table["label"].to_numpy()
            rows.clear()
            del table
            model = train(texts, labels)
            yield pa.RecordBatch.from_arrays([pa.array([model.ngrams.tobytes()], pa.binary()), pa.array([model.bias])], ["ngrams", "bias"])

    found = known.repartition(1).mapInArrow(c.releasing(work), "ngrams binary, bias double").collect()
    return Model(np.frombuffer(found[0].ngrams, np.float32), found[0].bias) if found else train([], np.zeros(0))


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, text, held_out, score, predicted: every row of docs with its score from 0 to 1; predicted is 1 from the threshold on.

    row is a struct of the columns other than the text, so no names clash.
    The model learns from at most LEARN labelled documents of up to LONGEST bytes that are not held out; its size is fixed. Scores
    depend on the text alone. Null and empty texts get the score of no words; rows with null ids are
    scored and not held out; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(chosen(docs, labels, "toxic", ~held_out(c.quoted(id_col), parts, part), LEARN, id_col, text_col, LONGEST)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score_texts(model.value, b.column(1)))], ["row", "text", "score"])

    kept = c.in_row(docs, text_col)
    scored = kept.mapInArrow(c.releasing(work), T.StructType([*kept.schema, T.StructField("score", T.DoubleType())]))
    return scored.select("row", "text", held_out(f"row.{c.quoted(id_col)}", parts, part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
