"""Exact top-k search: a KD-tree for each shard, walked best box first."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidegrid.llm.common import checkpointed, quoted

LEAF = 128
#: Vectors of a shard and queries of a block at most, and queries that are walked together.
SHARD, BLOCK, TOGETHER = 262_144, 8_192, 1_024
#: Scaled components have to be smaller, so that sums of products of 128 components stay within 64 bits.
LARGEST = 1 << 28
#: Shards that a small table is dealt to, for the sake of more tasks, and vectors by which the axes of the cells are chosen.
LEAST, SAMPLE = 24, 20_000
#: Products of integers below this are exact in floating point for up to 2**13 components.
EXACT = 1 << 20
NONE = np.iinfo(np.int64).min


@dataclass
class Tree:
    """Vectors in the order of the leaves; nodes have a range of them, a box and two children (or -1)."""

    ids: np.ndarray
    vectors: np.ndarray
    first: np.ndarray
    last: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray


def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
    """Split at the median of the widest side of the tight box until a leaf is small."""
    order = np.arange(len(ids))
    first, last, low, high, left, right = [], [], [], [], [], []

    def node(a: int, b: int) -> int:
        mine = vectors[order[a:b]]
        k = len(first)
        first.append(a)
        last.append(b)
        low.append(mine.min(0))
        high.append(mine.max(0))
        left.append(-1)
        right.append(-1)
        return k

    todo = [node(0, len(ids))]
    while todo:
        k = todo.pop()
        a, b = first[k], last[k]
        side = high[k] - low[k]
        if b - a <= leaf or not side.any():
            order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
            continue
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(vectors[order[a:b], int(side.argmax())], half)]
        left[k], right[k] = node(a, a + half), node(a + half, b)
        todo += [left[k], right[k]]
    return Tree(ids[order], vectors[order], *(np.array(x) for x in (first, last, low, high, left, right)))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    if max(abs(a).max(initial=0), abs(b).max(initial=0)) < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product that a vector in each box can have with each query."""
    return product(np.maximum(queries, 0), high) + product(np.minimum(queries, 0), low)


def search(tree: Tree, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, id and score of the best k of this shard for each query, as far as they reach the query's floor.

    Each query takes its open box of the largest bound, as long as the bound reaches the kth score that it has
    so far (from `floor` on); queries at the same box go together. Ties go to smaller ids, so
    a box whose bound equals the kth score is still opened.
    """
    n = len(queries)
    none = NONE
    open_ = np.full((n, len(tree.first)), none)
    open_[:, 0] = bounds(queries, tree.low[:1], tree.high[:1])[:, 0]
    best = np.full((n, k), none)
    kth = floor.copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = np.arange(n)
    while len(rows):
        node = open_[rows].argmax(1)
        bound = open_[rows, node]
        go = (bound > none) & (bound >= kth[rows])
        rows, node = rows[go], node[go]
        order = np.argsort(node, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(node[order])) + 1) if len(order) else []:
            at, m = rows[group], int(node[group[0]])
            open_[at, m] = none
            if tree.left[m] >= 0:
                both = [tree.left[m], tree.right[m]]
                open_[np.ix_(at, both)] = bounds(queries[at], tree.low[both], tree.high[both])
                continue
            a, b = tree.first[m], tree.last[m]
            score = product(queries[at], tree.vectors[a:b])
            score[tree.ids[a:b][None] == query_ids[at][:, None]] = none
            i, j = np.nonzero((score >= kth[at][:, None]) & (score > none))
            if not len(i):
                continue
            found.append((at[i], tree.ids[a + j], score[i, j]))
            some = np.unique(i)
            top = np.concatenate([best[at[some]], score[some]], 1)
            best[at[some]] = np.partition(top, top.shape[1] - k, axis=1)[:, -k:]
            kth[at[some]] = np.maximum(kth[at[some]], best[at[some]].min(1))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    q, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
    stay = score >= kth[q]
    q, ids, score = q[stay], ids[stay], score[stay]
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], ids[rank < k], score[rank < k]


def whole_numbers(vector: Column, scale: int = 64) -> Column:
    """Each component as floor(scale * x); null if the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


def checked(vector: Column) -> Column:
    """The vector; an error if a component is too large for exact sums."""
    large = F.exists(vector, lambda x: F.abs(x) >= LARGEST)
    return F.when(F.coalesce(large, F.lit(False)), F.raise_error(F.lit(f"a component is {LARGEST} or more after scaling"))).otherwise(vector)


def levels(n: int, most: int, least: int = 1) -> int:
    """How often n is halved until at most `most` are left, and until there are `least` parts."""
    return max(0, math.ceil(math.log2(max(least, n / most))))


def cell_of(rows: DataFrame, n: int, deep: int) -> Column:
    """A number of the vector's cell: a bit for each of the `deep` widest axes, whether the component is above the median.

    Axes and medians come from a sample of about SAMPLE vectors; they only decide which vectors go together.
    """
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // SAMPLE))) == 0)
    spread = some.select("size", F.posexplode("v").alias("axis", "x")).groupBy("size", "axis").agg(F.stddev("x").alias("s"), F.median("x").cast("bigint").alias("middle"))
    cell = F.lit(0)
    for size, axes in spread.orderBy("size", F.desc("s"), "axis").toPandas().groupby("size"):
        bits = [F.when(F.col("v")[int(r.axis)] > int(r.middle), 1 << i).otherwise(0) for i, r in enumerate(axes.head(deep).itertuples())]
        cell = F.when(F.col("size") == int(size), sum(bits, F.lit(0))).otherwise(cell)
    return cell.cast("int")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK, least: int = LEAST) -> DataFrame:
    """query_id, rank, id, score: for every query the k rows with the largest inner product, its own id apart.

    Exact; ties go to smaller ids. Null, NaN or infinite components and null ids take no part, and vectors
    of different lengths never meet. Repeated ids are candidates each. An empty table gives no rows. A component of LARGEST or
    more after scaling is an error.

    Vectors that lie in one cell of space go to one shard, and where a cell holds more than `shard`, to several by their ids' hash.
    Queries first meet a shard of their own cell, which gives each of them a kth score. With these scores they go on, in
    blocks of neighbouring cells, to the shards whose box can hold a better one for the block's box, and
    there boxes below a query's score are never opened. A tree moves once a round; the blocks that ask it follow it into its
    partition and are walked one after the other, so a task holds one tree and one batch of blocks, and what is sent grows with the
    queries that a shard cannot be left out for.
    """
    rows = checkpointed(
        vectors.select(
            F.col(quoted(id_col)).cast("bigint").alias("id"), checked(whole_numbers(F.col(quoted(vector_col)))).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
        ).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").withColumn("size", F.size("v"))
    )
    n, n_queries = rows.agg(F.count("*"), F.count_if("q")).first()
    deep, coarse = levels(n, shard, least), levels(n_queries, block)
    placed = rows.withColumn("cell", cell_of(rows, n, deep)).withColumn("around", F.col("cell").bitwiseAND((1 << coarse) - 1))

    def dealt(df: DataFrame, name: str, cell: str, most: int) -> DataFrame:
        """df with the part of its cell that a row goes to; the counts have a row for each cell, about 2 * n / most."""
        parts = df.groupBy("size", cell).agg(F.ceil(F.count("*") / most).cast("int").alias("_n"))
        number = F.concat_ws(":", "size", cell, F.pmod(F.xxhash64("id"), F.col("_n")))
        return df.join(F.broadcast(parts), ["size", cell]).withColumn(name, number).drop("_n")

    def matrix(v: pd.Series) -> np.ndarray:
        return np.stack(v.to_list()).astype(np.int64)

    def small(values: np.ndarray) -> np.ndarray:
        return values.astype(np.int16) if abs(values).max(initial=0) < 1 << 15 else values

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = build(pdf["id"].to_numpy(), small(matrix(pdf["v"])))
        low, high = tree.low[0].astype(np.int64), tree.high[0].astype(np.int64)
        return pdf.iloc[:1][["size", "cell", "shard"]].assign(tree=[pickle.dumps(tree)], low=[low], high=[high])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        values, floor = matrix(pdf["v"]), pdf["kth"].to_numpy(np.int64)
        queries = pickle.dumps((pdf["id"].to_numpy(), small(values), floor))
        return pdf.iloc[:1][["size", "block"]].assign(shard=pdf["home"].iloc[:1], queries=[queries], low=[values.min(0)], high=[values.max(0)], least=[int(floor.min())])

    box = "low array<bigint>, high array<bigint>"
    block_type = f"size int, block string, shard string, queries binary, {box}, least bigint"
    trees = checkpointed(dealt(placed, "shard", "cell", shard).groupBy("shard").applyInPandas(grow, f"size int, cell int, shard string, tree binary, {box}"))
    result = "query_id bigint, id bigint, score bigint"

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for kind, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not kind:
                    tree = pickle.loads(blob.as_py())
                    continue
                ids, values, floor = pickle.loads(blob.as_py())
                for a in range(0, len(ids), TOGETHER):
                    cut = slice(a, a + TOGETHER)
                    q, found, score = search(tree, values[cut].astype(np.int64), ids[cut], floor[cut], k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[cut][q]), pa.array(found), pa.array(score)], ["query_id", "id", "score"])

    def meet(blocks: DataFrame, asked: DataFrame) -> DataFrame:
        """What the blocks (shard, queries) find in their shards: each shard's tree comes first in its partition, then its blocks."""
        both = asked.select("shard", F.lit(0).alias("kind"), F.col("tree").alias("blob")).unionByName(blocks.select("shard", F.lit(1).alias("kind"), F.col("queries").alias("blob")))
        return both.repartition(n_shards, "shard").sortWithinPartitions("shard", "kind").select("kind", "blob").mapInArrow(met, result)

    n_shards = max(1, trees.count())
    homes = trees.groupBy("size", "cell").agg(F.min("shard").alias("home"))
    asking = dealt(placed.where("q"), "block", "cell", block).join(homes, ["size", "cell"]).withColumn("kth", F.lit(NONE + 1))
    begun = checkpointed(meet(checkpointed(asking.groupBy("block").applyInPandas(pack, block_type)), trees))
    kth = begun.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), "kth")
    asking = dealt(placed.where("q"), "block", "around", block).join(homes, ["size", "cell"]).join(kth, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(NONE + 1)))
    asked = checkpointed(asking.groupBy("block").applyInPandas(pack, block_type)).drop("shard")
    # the largest product of two boxes, axis by axis: a row for each shard and block, without vectors, in parts of 64 blocks
    times = max(1, asked.count() // 64)
    corners = trees.select("size", "shard", F.col("low").alias("s_low"), F.col("high").alias("s_high"), F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("part"))
    ends = F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("s_low", "s_high"), lambda x, y: F.greatest(x["low"] * y["s_low"], x["low"] * y["s_high"], x["high"] * y["s_low"], x["high"] * y["s_high"]))
    boxes = asked.select("size", "block", "low", "high", "least", F.pmod(F.xxhash64("block"), F.lit(times)).cast("int").alias("part"))
    pairs = boxes.join(corners, ["size", "part"]).where(F.aggregate(ends, F.lit(0).cast("bigint"), lambda a, x: a + x) >= F.col("least")).select("shard", "block")
    pairs = checkpointed(pairs)
    rest = meet(pairs.join(asked.select("block", "queries"), "block"), trees.join(pairs.select("shard").distinct(), "shard"))
    # a query's home shard answers again, so that what both rounds found is kept once
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
