"""Near-duplicates by SimHash and a binary trie that is joined with itself, and by the exact similarity of sets of word runs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidegrid.llm import common as c
from slidegrid.llm.common import checkpointed
from slidegrid.llm.components import components

BITS = 64
#: Fingerprints of one block's value above which its group is split by the bits that remain.
HOT = 100_000
#: Fingerprints that a task joins, about.
GROUP = 32_768
#: Trie node pairs that are walked at a time.
FRONTIER = 1 << 20
#: Documents, about, of which the runs are counted to order them, and runs counted there that are kept.
SAMPLE, COMMON = 20_000, 100_000
#: Runs that a task gathers in lists, about.
LISTED = 1 << 18


def fingerprint(text: str | None, words: int) -> int:
    """SimHash of the runs of `words` words: a bit is 1 if it is in over half of the runs' XXH64."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    ends = np.cumsum([len(x) + 1 for x in parts]) - 1
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(whole, 42)]
    else:
        starts = np.r_[0, ends[:-1] + 1][: len(parts) - words + 1]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:b], 42) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0) > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp: the fingerprint of every whole text as a signed 64-bit number.

    Letters A to Z are lower-cased; words are parted by blanks and 0x09 to 0x0D; repeats count. A text of
    fewer words is one run; null, empty and blank texts have fingerprint 0.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), words) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["id", "fp"])

    kept = docs.select(F.col(c.quoted(id_col)).cast("bigint").alias("id"), F.col(c.quoted(text_col)).cast("string").alias("text"))
    return kept.mapInArrow(c.releasing(work), "id bigint, fp bigint")


def blocks(budget: int, bits: int = BITS) -> list[tuple[int, int]]:
    """First bit and width of budget + 1 blocks: fingerprints within the budget agree on one of them at least."""
    cuts = [round(i * bits / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def turned(values: np.ndarray, by: int) -> np.ndarray:
    """64-bit numbers with bit `by`, counted from the top, moved to the top."""
    return values if not by else (values << np.uint64(by)) | (values >> np.uint64(BITS - by))


def trie_pairs(values: np.ndarray, first: np.ndarray, last: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of values that differ in at most `budget` bits, by joining tries with themselves.

    Each range first to last holds distinct sorted values that agree above `depth`; it is the root of a
    trie whose nodes are ranges of values with a common beginning. Pairs of nodes go down together: the
    pair of children on different sides has one differing bit more, and a pair over the budget is dropped.
    """
    todo = [(depth, first, last, first, last, np.zeros(len(first), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while todo:
        t, a, b, c, d, cost = todo.pop()
        single = (b - a == 1) & (d - c == 1)
        if t == BITS or single.any():
            done = single if t < BITS else np.ones(len(a), bool)
            x, y = a[done], c[done]
            near = (np.bitwise_count(values[x] ^ values[y]) <= budget) & (x != y)
            if near.any():
                yield x[near], y[near]
            a, b, c, d, cost = (v[~done] for v in (a, b, c, d, cost))
        if not len(a):
            continue
        if len(a) > FRONTIER:
            half = len(a) // 2
            todo += [(t, *(v[:half] for v in (a, b, c, d, cost))), (t, *(v[half:] for v in (a, b, c, d, cost)))]
            continue
        if t not in ones:
            ones[t] = np.r_[0, np.cumsum((values >> np.uint64(BITS - 1 - t)) & np.uint64(1), dtype=np.int64)]
        n = ones[t]
        m, k = b - (n[b] - n[a]), d - (n[d] - n[c])  # where the ones start
        same = a == c
        pairs = [(a, m, c, k, cost), (m, b, k, d, cost), (a, m, k, d, cost + np.int8(1)), *([] if same.all() else [tuple(v[~same] for v in (m, b, c, k, cost + np.int8(1)))])]
        a, b, c, d, cost = (np.concatenate(v) for v in zip(*pairs, strict=True))
        keep = (b > a) & (d > c) & (cost <= budget) & ~((a == c) & (b - a == 1))
        todo.append((t + 1, *(v[keep] for v in (a, b, c, d, cost))))


def merged(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n places the least place that the pairs connect it with."""
    root = np.arange(n)
    for x, y in pairs:
        while True:
            p, q = root[x], root[y]
            apart = p != q
            if not apart.any():
                break
            x, y, p, q = x[apart], y[apart], p[apart], q[apart]
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
            while (root[root] != root).any():
                root = root[root]
    return root


def links(distinct: DataFrame, budget: int = 4, hot: int = HOT, group: int = GROUP) -> DataFrame:
    """a, b: links whose components are those of all pairs of fingerprints within `budget` bits.

    distinct has fp, each once, and rep, the number that stands for it in a link. A trie gives one link for each
    member, to the least one that it reaches there, so a large group of copies makes no pairs.
    """

    def least(fp: np.ndarray, first: np.ndarray, last: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        root = merged(len(fp), trie_pairs(fp, first, last, depth, budget))
        apart = np.flatnonzero(root != np.arange(len(fp)))
        return apart, root[apart]

    return in_tries(distinct.withColumn("part", F.lit(0)), least, budget, hot, group)


def in_tries(distinct: DataFrame, found: Callable, budget: int, hot: int = HOT, group: int = GROUP) -> DataFrame:
    """a, b: the pairs that `found` gives in the tries of (part, fp, rep), with rep in place of fp.

    Fingerprints within the budget agree on one of budget + 1 blocks of bits, so each goes to the tries of its
    blocks' values, and a trie with more than `hot` of them is split once more by the bits outside its
    block. The table of hot values has at most (budget + 1) * 2**13 rows for a part, whatever the input.
    """
    parts = blocks(budget)
    spread = distinct.select(
        "part", "fp", "rep",
        F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.expr(sub_value(0, a, w)).alias("value")) for i, (a, w) in enumerate(parts)])).alias("k"),
    ).select("part", "fp", "rep", "k.block", "k.value")
    n = distinct.count()
    many = spread.groupBy("part", "block", "value").count().where(F.col("count") > hot).select("part", "block", "value", F.lit(True).alias("many"))
    if n > hot and (hot_rows := many.collect()):
        many = distinct.sparkSession.createDataFrame(hot_rows, many.schema)
        sub = F.array(*[F.array(*[F.expr(sub_value(a, w + i, n)) for i, n in blocks(budget, BITS - w)]) for a, w in parts])
        spread = (
            spread.join(F.broadcast(many), ["part", "block", "value"], "left")
            .withColumn("s", F.when(F.col("many"), F.element_at(sub, F.col("block") + 1)).otherwise(F.array(F.lit(-1))))
            .select("part", "fp", "rep", "block", "value", F.posexplode("s").alias("sub", "sub_value"))
        )
    else:
        spread = spread.select("*", F.lit(0).alias("sub"), F.lit(-1).alias("sub_value"))
    groups = max(8, -(-n // group))
    key = F.pmod(F.xxhash64("value", "sub", "sub_value"), F.lit(groups)).cast("int")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        turn, width = parts[int(pdf["block"].iloc[0])]
        fp = turned(pdf["fp"].to_numpy(np.int64).view(np.uint64), turn)
        sub = (pdf["sub"].to_numpy(np.int64) + 1) * (1 << 32) + pdf["sub_value"].to_numpy(np.int64)
        value = pdf["value"].to_numpy()
        order = np.lexsort((fp, sub, value))
        fp, sub, value, rep = fp[order], sub[order], value[order], pdf["rep"].to_numpy()[order]
        first = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (sub[1:] != sub[:-1])])
        last = np.r_[first[1:], len(fp)]
        some = last - first > 1
        a, b = found(fp, first[some], last[some], width)
        c.released()
        return pd.DataFrame({"a": rep[a], "b": rep[b]})

    return spread.withColumn("g", key).groupBy("part", "block", "g").applyInPandas(work, "a bigint, b bigint")


def sub_value(turn: int, first: int, width: int) -> str:
    """SQL for `width` bits of a fingerprint from bit `first` on, after turning it by `turn`."""
    moved = f"(shiftleft(fp, {turn}) | shiftrightunsigned(fp, {BITS - turn}))" if turn else "fp"
    return f"CAST(shiftrightunsigned({moved}, {BITS - first - width}) & {(1 << width) - 1} AS INT)"


def near_duplicates(docs: DataFrame, words: int = 4, budget: int = 4, id_col: str = "doc_id", text_col: str = "text", as_one: bool = False) -> DataFrame:
    """id, fp, component: every row of docs with its fingerprint and the smallest id that links reach from it.

    Rows link when their fingerprints differ in at most `budget` bits. Equal fingerprints are gathered before
    the join, so copies make no pairs. Rows with a null id stay, and stand for no component unless all
    rows of theirs have none (then it is null); repeated rows each stay; an empty table gives no rows.
    as_one: rows with one id are one document, which links all that its texts link.
    """
    fps = checkpointed(fingerprints(docs, words, id_col, text_col))
    same = checkpointed(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    linked = same.where("rep IS NOT NULL").select("fp", "rep")
    near = links(linked, budget)
    if as_one:
        several = fps.where("id IS NOT NULL").groupBy("id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("id")
        near = near.union(fps.join(several, "id").join(linked, "fp").select(F.col("rep").alias("a"), F.col("id").alias("b")))
    found = components(near)
    total = same.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    named = same.join(found, same["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"), "copies")
    return c.join_hot(fps, checkpointed(named), "fp", "copies", total).select("id", "fp", "component")


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Texts:
    """Some texts: 64-bit names and further 64 bits that tell texts apart, words, and sorted distinct hashes of runs of words."""

    name: np.ndarray
    check: np.ndarray
    n: np.ndarray
    runs: list[np.ndarray]


def named_texts(column: pa.Array, words: int, seed: int) -> Iterator[Texts]:
    """Names and runs of texts, A to Z lower-cased; texts with the same words in the same order have one name.

    A text of fewer words than a run is one run; null and blank texts have no words.
    """
    data, offsets = c.text_bytes(column)
    data = _LOWER[data]
    for a, b in c.steps(offsets):
        piece = data[offsets[a] : offsets[b]]
        starts, ends, first = c.words(piece, offsets[a : b + 1] - offsets[a])
        h, other = c.word_hashes(piece, starts, ends)
        place = (np.arange(len(h)) - first[np.repeat(np.arange(b - a), np.diff(first))]).astype(np.uint64)
        n = np.diff(first)

        def whole(word: np.ndarray) -> np.ndarray:
            total = np.r_[np.uint64(0), np.cumsum(c.joined(word, place), dtype=np.uint64)]
            return c.mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64)).view(np.int64)

        name = whole(c.mix(h ^ np.uint64(seed)))
        check = whole(other)
        runs = []
        for k in range(b - a):
            own = h[first[k] : first[k + 1]]
            runs.append(np.unique(c.window_hashes(own, max(1, min(words, len(own))))))
        yield Texts(name, check, n, runs)


def describe(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """id, name, check, n, mark: names of texts with words, their number of distinct runs, and a bitmap of whether an odd number of them has a bit's hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for t in named_texts(batch.column(1), words, seed):
                marks = [np.packbits((np.bincount((own >> np.uint64(54)).astype(np.int64), minlength=1024) & 1).astype(bool)).tobytes() for own in t.runs]
                out += zip(t.name.tolist(), t.check.tolist(), (len(x) if k else 0 for k, x in zip(t.n.tolist(), t.runs, strict=True)), marks, strict=True)
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "name", "check", "n", "mark"])

    return docs.select("id", "text").mapInArrow(c.releasing(work), "id bigint, name bigint, check bigint, n int, mark binary").where("n > 0")


def shingle_sets(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """name, shingles: each text's distinct 64-bit hashes of its runs; each text once for each task, in batches of a few texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for t in named_texts(batch.column(0), words, seed):
                fresh = [k for k, name in enumerate(t.name.tolist()) if not (name in seen or seen.add(name))]
                sets = [t.runs[k].view(np.int64) for k in fresh]
                offsets = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
                values = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
                yield pa.RecordBatch.from_arrays([pa.array(t.name[fresh], pa.int64()), pa.ListArray.from_arrays(offsets, values)], ["name", "shingles"])

    return docs.select("text").mapInArrow(c.releasing(work), "name bigint, shingles array<bigint>")


def common_runs(docs: DataFrame, words: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of runs that many documents have, at most COMMON, and how many of about SAMPLE of the n documents have them.

    They only order the runs: any order gives the same links, and a good one gives short lists.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            flat = [np.zeros(0, np.uint64)]
            for t in named_texts(batch.column(0), words, 0):
                flat += [own for name, own in zip(t.name.tolist(), t.runs, strict=True) if not (name in seen or seen.add(name))]
            key, count = np.unique(np.concatenate(flat), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count.astype(np.int64))], ["key", "n"])

    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // SAMPLE))) == 0).select("text")
    counted = checkpointed(some.mapInArrow(c.releasing(work), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"))
    # the least count from which on there are at most COMMON runs; the driver gets those, and a number for each count that some run has, at most SAMPLE
    least, held = 2, 0
    for row in sorted(counted.groupBy("n").count().collect(), reverse=True):
        held += row["count"]
        if held > COMMON:
            least = row["n"] + 1
            break
    found = counted.where(F.col("n") >= least).toPandas()
    key = found["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], found["n"].to_numpy(np.int64)[order]


def prefixes(docs: DataFrame, words: int, similarity: float, common: tuple[np.ndarray, np.ndarray], seed: int) -> DataFrame:
    """id, key, place, n: of each text's n runs, the rarest, so many that texts of the similarity have one of them in common.

    id is the text's name; a task gives the runs of a text once, however many copies it reads.
    """
    known = docs.sparkSession.sparkContext.broadcast(common)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = known.value
        seen: set[int] = set()
        for batch in batches:
            kept, names, n = [np.zeros(0, np.uint64)], [], []
            for t in named_texts(batch.column(0), words, seed):
                for name, n_words, own in zip(t.name.tolist(), t.n.tolist(), t.runs, strict=True):
                    if not n_words or name in seen:
                        continue
                    seen.add(name)
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                        own = own[np.argsort(np.where(keys[at] == own, counts[at], 0), kind="stable")]
                    kept.append(own[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1])
                    names.append(name)
                    n.append(len(own))
            size = np.array([len(x) for x in kept[1:]], np.int64)
            key = np.concatenate(kept).view(np.int64)
            place = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
            columns = (np.repeat(np.array(names, np.int64), size), key, place.astype(np.int32), np.repeat(np.array(n, np.int32), size))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["id", "key", "place", "n"])

    return docs.select("text").mapInArrow(c.releasing(work), "id bigint, key bigint, place int, n int")


def reachable(n: np.ndarray, place: np.ndarray, m: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m runs can be similar, if their first common run is at `place` of the one and `other` of the other."""
    return np.minimum(n - place, m - other) >= similarity / (1 + similarity) * (n + m) - 1e-6


def with_partners(key: np.ndarray, n: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    """Places, by key and n, of what can be a first common run: the shorter of two sets has it early."""
    early = n - place >= 2 * similarity / (1 + similarity) * n - 1e-6
    order = np.lexsort((~early, n, key))
    key, n, early = key[order], n[order], early[order]
    last = np.maximum.accumulate(np.where(early, np.arange(len(key)), 0))
    return order[early | (early[last] & (key[last] == key) & (n[last] >= similarity * n - 1e-6))]


def hubs(ids: np.ndarray, a: int, b: int) -> list[int]:
    """Two places of a list a to b, by n and id: that of the least id, and the middle."""
    return [a + int(np.argmin(ids[a:b])), (a + b) // 2]


def listed(found: DataFrame, similarity: float, groups: int, few: int) -> DataFrame:
    """Pairs (a, b; n is 0) to compare of lists of at most `few` documents and with the hubs of larger ones, and (a, key, place, n) the larger lists."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["key", "id"])  # of one text, from several tasks
        key, ids, place, n = (pdf[x].to_numpy(np.int64) for x in ("key", "id", "place", "n"))
        for _ in range(2):  # what has no other of its key goes, before and after what has no partner
            order = np.argsort(key, kind="stable")
            first = c.runs(key[order])
            size = np.diff(np.r_[first, len(key)])
            order = order[np.repeat(size, size) > 1]
            key, ids, place, n = (x[order] for x in (key, ids, place, n))
            if _ == 0:
                order = with_partners(key, n, place, similarity)
                key, ids, place, n = (x[order] for x in (key, ids, place, n))
        order = np.lexsort((ids, n, key))
        key, ids, place, n = (x[order] for x in (key, ids, place, n))
        first = c.runs(key)
        last = np.r_[first[1:], len(key)][: len(first)]
        size = np.repeat(last - first, last - first)
        out = [np.zeros((0, 2), np.int64)]

        def add(i: np.ndarray, j: np.ndarray) -> None:
            near = reachable(n[i], place[i], n[j], place[j], similarity) & (ids[i] != ids[j])
            out.append(np.c_[np.maximum(ids[i], ids[j])[near], np.minimum(ids[i], ids[j])[near]])

        for k in range(1, few):
            i = np.flatnonzero((key[k:] == key[:-k]) & (size[k:] <= few))
            add(i, i + k)
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a > few:
                for h in hubs(ids, a, b):
                    add(np.full(b - a, h), np.arange(a, b))
        pairs, large = np.unique(np.concatenate(out), axis=0), size > few
        none = np.zeros(len(pairs), np.int64)
        del out
        c.released()
        return pd.DataFrame({
            "a": np.r_[pairs[:, 0], ids[large]], "b": np.r_[pairs[:, 1], ids[large]], "key": np.r_[none, key[large]],
            "place": np.r_[none, place[large]], "n": np.r_[none, n[large]],
        })

    grouped = found.withColumn("g", c.buckets(F.col("key"), groups)).groupBy("g")
    return grouped.applyInPandas(work, "a bigint, b bigint, key bigint, place int, n int")


def rest_of_lists(lists: DataFrame, similarity: float, groups: int) -> DataFrame:
    """a, b: documents of one list (id, key, place, n, component, mark) whose sets can be similar, each pair once.

    Only those of different components, and without the hubs: so documents that have been linked make no more
    pairs. The bitmaps of parities (mark) differ in no more bits than the sets in runs.
    """
    apart = (1 - similarity) / (1 + similarity)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "n", "id"], kind="stable")
        ids, place, n, component = (pdf[x].to_numpy(np.int64) for x in ("id", "place", "n", "component"))
        mark = np.frombuffer(b"".join(pdf["mark"]), np.uint64).reshape(len(pdf), -1)
        first = c.runs(pdf["key"].to_numpy())
        out, kept, waiting = [], np.zeros((0, 2), np.int64), 0
        for a, b in zip(first.tolist(), np.r_[first[1:], len(pdf)].tolist(), strict=True):
            known = hubs(ids, a, b)
            for i in range(a, b):
                if i in known:
                    continue
                j = np.arange(i + 1, a + np.searchsorted(n[a:b], n[i] / similarity + 1e-6, "right"))
                j = j[(component[j] != component[i]) & (ids[j] != ids[i])]
                j = j[reachable(n[i], place[i], n[j], place[j], similarity) & ~np.isin(j, known)]
                j = j[np.bitwise_count(mark[i] ^ mark[j]).sum(axis=1, dtype=np.int64) <= apart * (n[i] + n[j]) + 1e-6]
                out.append(np.c_[np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j])])
                waiting += len(j)
                if waiting > 1 << 20:
                    kept, out, waiting = np.unique(np.concatenate([kept, *out]), axis=0), [], 0
        kept = np.unique(np.concatenate([kept, *out]), axis=0)
        del pdf, mark, out
        c.released()
        return pd.DataFrame({"a": kept[:, 0], "b": kept[:, 1]})

    return lists.withColumn("g", c.buckets(F.col("key"), groups)).groupBy("g").applyInPandas(work, "a bigint, b bigint").distinct()


def similar_pairs(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, words: int, similarity: float, seed: int) -> DataFrame:
    """Those of the pairs (a, b) of names whose texts' sets of runs have the Jaccard similarity.

    docs: id, text. firsts: name, rep, n, mark. Bitmaps drop most of the others before the sets are made.
    """
    apart = (1 - similarity) / (1 + similarity)

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (4, 5))
            n = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            near = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= apart * n + 1e-6
            yield batch.select([0, 1]).filter(pa.array(near))

    marks = firsts.select("name", "n", "mark")
    first, second = (marks.select(F.col("name").alias(x), F.col("n").alias(f"n{x}"), F.col("mark").alias(f"m{x}")) for x in "ab")
    kept = pairs.join(first, "a").join(second, "b").select("a", "b", "na", "nb", "ma", "mb").mapInArrow(possible, "a bigint, b bigint")
    kept = checkpointed(kept)
    wanted = checkpointed(kept.select(F.explode(F.array("a", "b")).alias("name")).distinct().join(firsts.select("name", "rep"), "name").select(F.col("rep").alias("id")).distinct())
    some, _ = c.sieved(docs, wanted, "id")
    sets = checkpointed(shingle_sets(some.join(wanted, "id"), words, seed))

    first, second = (sets.select(F.col("name").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = kept.join(first, "a").join(second, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("common") >= similarity * (F.size("sa") + F.size("sb") - F.col("common")) - 1e-9).select("a", "b").distinct()


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, few: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, component: for every id that has near-duplicates, the smallest id that links reach.

    Documents link when the Jaccard similarity of their sets of `words`-word runs is at least `similarity`, or when
    their words are equal (by 128 bits). The components are exact: runs are ordered by frequency, and similar sets have one of
    their rarest in common (prefix filter), so each such run has a list of texts to compare, bounded by
    length and place. In a list of more than `few`, texts are compared with two hubs first, and then
    all those of different components with each other, as far as bitmaps of their sets let them be similar. Texts without words and rows with null ids link with
    nothing; an empty table gives no rows. Rows with one id are one document here, which all its texts link.

    Links are between texts, so copies make none; texts are named by 64 bits, and should two
    texts ever have one name, all texts are named anew with another seed.
    """
    texts = docs.select(F.col(c.quoted(id_col)).cast("bigint").alias("id"), F.col(c.quoted(text_col)).cast("string").alias("text")).where("id IS NOT NULL")
    for seed in range(1, 100):
        rows = checkpointed(describe(texts, words, seed))
        firsts = checkpointed(rows.groupBy("name", "check").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("mark").alias("mark")))
        if firsts.groupBy("name").count().where("count > 1").isEmpty():
            break
    n, total, n_rows = firsts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    groups = max(8, int(total * (1 - similarity)) // LISTED)
    found = checkpointed(listed(prefixes(texts, words, similarity, common_runs(texts, words, n), seed), similarity, groups, few))
    pairs = checkpointed(found.where("n = 0").select("a", "b").distinct())
    lists = found.where("n > 0").select(F.col("a").alias("id"), "key", "place", "n")
    several = rows.groupBy("id").agg(F.min("name").alias("b"), F.max("name").alias("most")).where("b < most").select("id", "b")
    own = rows.select("id", F.col("name").alias("a")).join(several, "id").select("a", "b").where("a <> b").distinct()
    near = checkpointed(similar_pairs(pairs, texts, firsts, words, similarity, seed).union(own))
    linked = components(near)
    named = lists.join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_lists = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    named = named.join(open_lists, "key").join(firsts.select(F.col("name").alias("id"), "mark"), "id")
    more = checkpointed(rest_of_lists(named, similarity, groups).join(pairs, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        linked = components(near.union(similar_pairs(more, texts, firsts, words, similarity, seed)))
    member = firsts.select("name", "rep", "copies").join(linked, F.col("name") == F.col("node"), "left").withColumn("component", F.coalesce("component", "name"))
    least = member.groupBy("component").agg(F.min("rep").alias("least"))
    labels = member.join(least, "component").where("rep <> least OR copies > 1 OR node IS NOT NULL").select("name", F.col("least").alias("component"), "copies")
    return c.join_hot(rows.select("id", "name"), checkpointed(labels), "name", "copies", n_rows).groupBy("id").agg(F.min("component").alias("component"))
