"""Shared by the operators: Arrow texts as byte arrays, word hashes, checkpoints."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles at a time; a longer text makes a step of its own.
STEP = 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The inverse of _ODD modulo 2**64.
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def quoted(name: str) -> str:
    """A column's name as it is written in expressions, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame, but: str = "") -> list[Column]:
    """All columns by their quoted names."""
    return [F.col(quoted(x)) for x in df.columns if x != but]


def in_row(docs: DataFrame, text_col: str) -> DataFrame:
    """row, text: a struct of the columns other than the text, so that no names clash, and the text."""
    return docs.select(F.struct(F.lit(0).alias("_"), *columns(docs, text_col)).alias("row"), F.col(quoted(text_col)).cast("string").alias("text"))


def out_of_row(names: list[str], new: dict[str, Column]) -> list[Column]:
    """The columns of these names, from `new` or else from the struct row."""
    return [new[x].alias(x) if x in new else F.col(f"row.{quoted(x)}").alias(x) for x in names]


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that all executors share.

    A session without such a folder gets a temporary one if it runs on this machine alone.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


#: Rows of one key from which a join deals with the key apart, and how many such keys there can be at most.
HOT_ROWS, HOT_KEYS = 2_048, 1_000
#: Bits of the table with which rows are sieved before a join: at most 2**18 rows of 64 bits, whatever the input.
SIEVE = 24


def join_hot(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with a table that has each key once, and in `count` how many of the `total` rows have the key.

    Keys of more than HOT_ROWS rows and of more than total / HOT_KEYS go by a broadcast: as counts add up to the total,
    these are at most HOT_KEYS. All other keys are shuffled. The column `count` is dropped.
    """
    hot = F.col(count) > max(HOT_ROWS, total // HOT_KEYS)
    if total <= HOT_ROWS or table.where(hot).isEmpty():
        return rows.join(table.drop(count), key)
    few = table.where(hot).drop(count)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(rest.join(table.where(~hot).drop(count), key))


def sieved(rows: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """rows in two parts: those whose id can be among `ids` (one column), and those whose id surely is not.

    The ids' hashes set bits of a table of fixed size, which is broadcast; so the second part needs no shuffle. The more ids
    there are, the more rows of other ids are in the first part, so that the parts still have to be joined with the ids.
    """
    name = ids.columns[0]
    bit = lambda c: F.shiftrightunsigned(F.xxhash64(F.col(c).cast("bigint")), 64 - SIEVE)
    place = ids.select(bit(quoted(name)).alias("_bit")).select(F.shiftright("_bit", 6).alias("_word"), F.expr("shiftleft(1L, CAST(_bit & 63 AS INT))").alias("_mask"))
    table = F.broadcast(place.groupBy("_word").agg(F.bit_or("_mask").alias("_mask")))
    held = rows.select(F.struct(*columns(rows)).alias("_row"), bit(quoted(id_col)).alias("_bit"))
    held = held.withColumn("_word", F.shiftright("_bit", 6)).join(table, "_word", "left")
    maybe = F.expr("coalesce(shiftrightunsigned(_mask, CAST(_bit & 63 AS INT)) & 1, 0) = 1")
    return tuple(held.where(part).select(*[F.col(f"_row.{quoted(x)}").alias(x) for x in rows.columns]) for part in (maybe, ~maybe))


def released() -> None:
    """Give memory that this worker has freed back to the system.

    Workers are used for task after task, and without this keep the most that any task has had, beside the others of their executor.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(work: Callable) -> Callable:
    """A function of a task's batches that gives freed memory back when the task ends."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            released()

    return whole


def buckets(key: Column, n: int) -> Column:
    """A number below n that spreads keys evenly; null keys have one too."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts end to end, and the places where they start (one more than there are texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n, at = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[at : at + n + 1]
    whole = column.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None and whole.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of texts, each of about `most` bytes or of one longer text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes that part words: the blank and 0x09 to 0x0D.
BLANKS = byte_set((0x20, 0x20), (0x09, 0x0D))


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in the bytes, and each text's first word (one more than there are texts)."""
    inside = ~apart[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= apart[data[:-1]] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= apart[data[1:]] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _letters(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    """Powers of an odd number, as many as were ever asked for."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.known = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            x = np.full(max(n, STEP + 1024), self.base, np.uint64)
            x[0] = 1
            self.known = np.cumprod(x, dtype=np.uint64)
        return self.known[:n]


_UP, _DOWN = _Powers(_ODD), _Powers(_ODD_INVERSE)


#: Words of at most so many bytes are hashed together, eight bytes at a time; longer ones go by XXH3 one by one.
TOGETHER = 64
_BYTES = np.array([*((1 << 8 * n) - 1 for n in range(9))], np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of slices of the bytes: the 128 bits by which equal words are told from others.

    Each eight bytes go through a one-to-one mixing of either hash, so slices that differ in one such part never have
    the same hash.
    """
    size = end - start
    ahead = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    one, two = mix(size.astype(np.uint64) + _ODD), mix(size.astype(np.uint64) ^ np.uint64(0xA0761D6478BD642F))
    live = np.flatnonzero((size > 0) & (size <= TOGETHER))
    done = 0
    while len(live):
        part = ahead[start[live] + done] & _BYTES[np.minimum(size[live] - done, 8)]
        one[live] = mix(one[live] ^ part * np.uint64(0xE7037ED1A0B428DB))
        two[live] = mix((two[live] + part) * np.uint64(0x8EBC6AF09C88C6E3))
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size > TOGETHER).tolist():
        whole = xxhash.xxh3_128_intdigest(data[start[i] : end[i]].tobytes())
        one[i], two[i] = whole >> 64, whole & ((1 << 64) - 1)
    return one, two


def sums_before(data: np.ndarray, seed: int) -> np.ndarray:
    """Sums of the bytes' codes times powers: slices of equal bytes differ by a power alone.

    For features only: some words of a very regular form have equal hashes under every seed.
    """
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_letters(seed)[data] * _UP.upto(len(data)), dtype=np.uint64, out=out[1:])
    return out


def slice_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices of the bytes, the same wherever the slice stands."""
    return mix((sums[end] - sums[start]) * _DOWN.upto(len(sums))[start] + (end - start).astype(np.uint64))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs, in order."""
    return mix(a * np.uint64(0xA24BAED4963EE407) + (b ^ np.uint64(0x9FB21C651E98DF25)))


def window_hashes(word_hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of `length` words, made by doubling: a run of 2k is two runs of k."""
    out, have, power, size = None, 0, word_hashes, 1
    while True:
        if length & size:
            n = len(power) - have
            out = power if out is None else joined(out[: max(n, 0)], power[have:]) if n > 0 else out[:0]
            have += size
        if size * 2 > length:
            return out[: max(len(word_hashes) - length + 1, 0)]
        power = joined(power[:-size], power[size:]) if len(power) > size else power[:0]
        size *= 2


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where a new value starts in sorted values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values stand in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values
