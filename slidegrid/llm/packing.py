"""Best-fit packing of documents in sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidegrid.llm.common import checkpointed, quoted

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Documents that are packed together, about.
SHARD = 4_096
#: What a sequence costs besides its tokens, and how attention adds to a token's cost with the length.
EACH, LONGEST_EXTRA = 32.0, 0.15


def cost(capacity: np.ndarray | int, largest: int) -> np.ndarray | float:
    """Cost of one sequence of this length."""
    return EACH + capacity * (1 + LONGEST_EXTRA * capacity / largest)


def pack(lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place of each item, and the capacity of each bin; items are at most the largest capacity.

    Longest items first; an item goes to the open bin with the least room that holds it. If none does, a bin is
    opened whose size costs least for each token that can still come to fill it, among the sizes that
    hold the item. In the end each bin shrinks to the smallest size that holds its contents.
    """
    sizes = sorted(capacities)
    largest = sizes[-1]
    order = np.argsort(-lengths, kind="stable")
    left = int(lengths.sum())
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    filled: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(largest + 1)]
    rooms, whole = 0, []  # rooms: bit r is set if a bin has room r
    price = [float(cost(s, largest)) for s in sizes]
    for i in order.tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room = min((p / min(s, left), -s, s) for s, p in zip(sizes, price, strict=True) if s >= n)[2]
            k = len(filled)
            filled.append(0)
            whole.append(room)
        bins[i], places[i] = k, filled[k]
        filled[k] += n
        left -= n
        if room > n:
            by_room[room - n].append(k)
            rooms |= 1 << (room - n)
    table = np.array(sizes)
    return bins, places, table[np.searchsorted(table, np.array(filled, np.int64))]


def n_words(text: Column) -> Column:
    """How many words a text has (parted by blanks and 0x09 to 0x0D); null has none."""
    return F.size(F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != ""))


def packed(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None) -> DataFrame:
    """id, piece, start, n_tokens, bin, place, capacity: where each piece of each document goes.

    length is how many tokens a row has, by default the number of its words; each document has one more token that ends it. Longer
    documents than the largest capacity are cut in pieces of that size and one of the rest. Rows are
    dealt at random to shards of about SHARD, each packed by itself; a bin's name is its
    shard and its number there. Null and empty texts take the one token that ends a document (as does a null length); null
    ids are kept, repeated rows each have a place; an empty table gives no rows.
    """
    largest = max(capacities)
    length = n_words(F.col(quoted(text_col))) if length is None else length
    rows = checkpointed(docs.select(F.col(quoted(id_col)).cast("bigint").alias("id"), (F.coalesce(length, F.lit(0)) + 1).cast("bigint").alias("n")))
    shards = max(1, -(-rows.count() // SHARD))
    # by the row's number, which the checkpoint keeps, so that equal rows go to different shards
    items = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "id"], ascending=[False, True], kind="stable")
        total = pdf["n"].to_numpy(np.int64)
        count = -(-total // largest)
        owner = np.repeat(np.arange(len(pdf)), count)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        size = np.minimum(largest, total[owner] - piece * largest)
        bins, places, capacity = pack(size, capacities)
        shard = int(pdf["shard"].iloc[0])
        return pd.DataFrame({
            "id": pdf["id"].to_numpy()[owner] if pdf["id"].notna().all() else pdf["id"].astype("Int64").array[owner],
            "piece": piece.astype(np.int32), "start": piece * largest, "n_tokens": size,
            "bin": shard * (1 << 32) + bins, "place": places, "capacity": capacity[bins].astype(np.int32),
        })

    return items.groupBy("shard").applyInPandas(work, "id bigint, piece int, start bigint, n_tokens bigint, bin bigint, place bigint, capacity int")
