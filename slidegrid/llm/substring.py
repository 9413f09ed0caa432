"""Removal of word passages that other documents have already, by windows of growing length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slidegrid.llm import common as c

#: A null id counts as this one, the largest.
LAST = (1 << 63) - 1
ASK = "part int, bucket int, hashes binary, checks binary, base bigint, width int, ids binary"
REPLY = "bucket int, hashes binary, checks binary"
#: Documents and bytes of text of a bucket, about.
MOST, BYTES = 4096, 1 << 24


def levels(window: int) -> list[int]:
    """Window lengths, each at most twice the one before; the last is `window`."""
    out = [window]
    while out[0] > 8:
        out.insert(0, -(-out[0] // 2))
    return out


class Bucket:
    """The words of a bucket of documents: hashes, places and the windows that still count."""

    def __init__(self, table: pa.Table, window: int, checked: bool = True) -> None:
        self.data, self.offsets = c.text_bytes(table["text"])
        ids = table["id"].combine_chunks() if table.num_rows else pa.array([], pa.int64())
        self.ids = np.asarray(ids.fill_null(LAST), np.int64)
        self.window = window
        starts, ends, firsts, hashes, others = [], [], [np.zeros(1, np.int64)], [], []
        for a, b in c.steps(self.offsets):
            lo = self.offsets[a]
            piece = self.data[lo : self.offsets[b]]
            s, e, f = c.words(piece, self.offsets[a : b + 1] - lo)
            one, two = c.word_hashes(piece, s, e)
            hashes.append(one)
            others.append(two if checked else one)
            firsts.append(f[1:] + firsts[-1][-1])
            starts.append(s + lo)
            ends.append(e + lo)
        empty = np.zeros(0, np.int64)
        self.starts, self.ends = np.concatenate([empty, *starts]), np.concatenate([empty, *ends])
        self.hashes, self.first = np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate(firsts)
        #: Further hashes of the words, independent of the first ones, for the last level.
        self.others = np.concatenate([np.zeros(0, np.uint64), *others])
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))

    def all_windows(self, length: int) -> np.ndarray:
        """Word places where a window of this length starts."""
        n = len(self.hashes) - length + 1
        return np.flatnonzero(np.arange(max(n, 0)) + length <= self.first[self.doc[: max(n, 0)] + 1])

    def chosen(self, short: int, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every long window, the short window within it that has the least hash, and all short hashes.

        Equal long windows choose at the same place, so they stay only if what they chose is repeated.
        """
        h = c.window_hashes(self.hashes, short)
        at = self.all_windows(long)
        best = at.copy()
        for k in range(1, long - short + 1):
            best = np.where(h[at + k] < h[best], at + k, best)
        return at, best, h

    def local(self, hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, each one's first place in the order given back last, its least id and its largest."""
        order = np.argsort(hashes, kind="stable")
        first = c.runs(hashes[order])
        ids = self.ids[docs[order]]
        if not len(first):
            return hashes[:0], first, ids[:0], ids[:0]
        return hashes[order][first], order[first], np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)

    def least_ids(self, h: np.ndarray, other: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of windows by both of their hashes, where a new window starts in it, and each one's least id."""
        order = np.lexsort((other, h))
        if not len(order):
            return order, order, self.ids[:0]
        hs, os = h[order], other[order]
        first = np.flatnonzero(np.r_[True, (hs[1:] != hs[:-1]) | (os[1:] != os[:-1])])
        return order, first, np.minimum.reduceat(self.ids[self.doc[at[order]]], first)

    def survivors(self, replies: list[np.ndarray]) -> tuple[np.ndarray, int]:
        """Starts of the windows that count after the levels replied to so far, and the length they have."""
        steps = levels(self.window)
        if len(steps) == 1 or not replies:
            return self.all_windows(steps[0]), steps[0]
        at, best, h = self.chosen(steps[0], steps[1])
        asked = np.unique(best)
        keep = at[self._repeated(h, asked, best, replies[0])]
        for k in range(1, len(replies)):
            h = c.window_hashes(self.hashes, steps[k])
            ok = np.zeros(len(self.hashes) + 1, bool)
            ok[keep[self._repeated(h, keep, keep, replies[k])]] = True
            at = self.all_windows(steps[k + 1])
            keep = at[ok[at] & ok[at + steps[k + 1] - steps[k]]]
        return keep, steps[min(len(replies), len(steps) - 1)]

    def _repeated(self, h: np.ndarray, asked: np.ndarray, at: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
        distinct, _, low, high = self.local(h[asked], self.doc[asked])
        return c.among(h[at], np.union1d(distinct[low != high], elsewhere))


def packed(part: np.ndarray, n_parts: int, bucket: int, hashes: np.ndarray, checks: np.ndarray | None, ids: np.ndarray | None) -> pa.Table:
    """What a bucket asks, one row for each part of the hashes."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(n_parts + 1))
    base = int(ids.min()) if ids is not None and len(ids) else 0
    width = 0
    if ids is not None:
        span = int(ids.max()) - base if len(ids) else 0
        width = next(w for w in (1, 2, 4, 8) if span < 1 << 8 * w)
    rows = []
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        o = order[cuts[p] : cuts[p + 1]]
        rows.append({
            "part": p, "bucket": bucket, "hashes": hashes[o].tobytes(), "base": base, "width": width,
            "checks": checks[o].tobytes() if checks is not None else b"",
            "ids": (ids[o] - base).astype(np.uint64).astype(f"<u{width}").tobytes() if ids is not None else b"",
        })
    return pa.Table.from_pylist(rows, _schema(ASK))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def ask(bucket: Bucket, number: int, replies: list[np.ndarray], n_parts: int) -> pa.Table:
    """The distinct hashes at the next level; at the last level with a second hash and the least id."""
    steps = levels(bucket.window)
    if len(steps) > 1 and not replies:
        _, best, h = bucket.chosen(steps[0], steps[1])
        hashes = np.unique(h[np.unique(best)])
        return packed((hashes % np.uint64(n_parts)).astype(np.int64), n_parts, number, hashes, None, None)
    at, length = bucket.survivors(replies)
    h = c.window_hashes(bucket.hashes, length)[at]
    if length < bucket.window:
        hashes, _, _, _ = bucket.local(h, bucket.doc[at])
        return packed((hashes % np.uint64(n_parts)).astype(np.int64), n_parts, number, hashes, None, None)
    order, first, low = bucket.least_ids(h, c.window_hashes(bucket.others, length)[at], at)
    hashes, other = h[order][first], c.window_hashes(bucket.others, length)[at[order[first]]]
    return packed((hashes % np.uint64(n_parts)).astype(np.int64), n_parts, number, hashes, other, low)


def answer(table: pa.Table) -> pa.Table:
    """For each bucket, those of its hashes that another bucket has too; at the last level, has with a smaller id."""
    hashes = [np.frombuffer(x, "<u8") for x in table["hashes"].to_pylist()]
    sizes = np.array([len(x) for x in hashes])
    h = np.concatenate(hashes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    widths = table["width"].to_pylist()
    if widths[0]:
        checks = np.concatenate([np.frombuffer(x, "<u8") for x in table["checks"].to_pylist()])
        ids = np.concatenate([
            np.frombuffer(x, f"<u{w}").astype(np.int64) + b
            for x, w, b in zip(table["ids"].to_pylist(), widths, table["base"].to_pylist(), strict=True)
        ])
        order = np.lexsort((ids, checks, h))
        hs, cs = h[order], checks[order]
        first = np.flatnonzero(np.r_[True, (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])])
        least = np.repeat(ids[order][first], np.diff(np.r_[first, len(h)]))
        yes = order[least < ids[order]]
    else:
        order = np.argsort(h, kind="stable")
        first = c.runs(h[order])
        count = np.diff(np.r_[first, len(h)])
        yes = order[np.repeat(count > 1, count)]
    yes = yes[np.argsort(owner[yes], kind="stable")]
    cuts = np.searchsorted(owner[yes], np.arange(len(sizes) + 1))
    numbers = table["bucket"].to_pylist()
    own = [yes[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    rows = [{"bucket": numbers[i], "hashes": h[x].tobytes(), "checks": checks[x].tobytes() if widths[0] else b""} for i, x in enumerate(own) if len(x)]
    return pa.Table.from_pylist(rows, _schema(REPLY))


def covered(bucket: Bucket, replies: list[np.ndarray], checks: np.ndarray) -> np.ndarray:
    """Which words stand in a window that a document with a smaller id has too. checks: in step with the last replies.

    Windows are compared by two independent hashes of 64 bits of their words.
    """
    at, length = bucket.survivors(replies[:-1])
    h, other = (c.window_hashes(x, length)[at] for x in (bucket.hashes, bucket.others))
    order, first, low = bucket.least_ids(h, other, at)
    here = np.zeros(len(h), bool)
    here[order] = np.repeat(low, np.diff(np.r_[first, len(h)])) < bucket.ids[bucket.doc[at[order]]] if len(h) else False
    both = np.empty(len(h) + len(checks), [("h", np.uint64), ("c", np.uint64)])
    both["h"], both["c"] = np.r_[h, replies[-1]], np.r_[other, checks]
    _, number = np.unique(both, return_inverse=True)
    hit = at[here | np.isin(number[: len(h)], number[len(h) :])]
    edge = np.zeros(len(bucket.hashes) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + length, -1)
    return np.cumsum(edge)[:-1] > 0


def kept_texts(bucket: Bucket, gone: np.ndarray, tidy: bool) -> Iterator[bytes]:
    """Each document's words that stay, joined by one blank; if not tidy, white space between kept neighbours stays too."""
    for i in range(len(bucket.ids)):
        a, b = bucket.first[i], bucket.first[i + 1]
        stay = np.flatnonzero(~gone[a:b]) + a
        if not tidy and len(stay) == b - a:
            yield bucket.data[bucket.offsets[i] : bucket.offsets[i + 1]].tobytes()
            continue
        if not len(stay):
            yield b""
            continue
        first = np.flatnonzero(np.r_[True, np.diff(stay) > 1])
        ends = bucket.ends[stay[np.r_[first[1:], len(stay)] - 1]]
        runs = [bucket.data[x:y].tobytes() for x, y in zip(bucket.starts[stay[first]].tolist(), ends.tolist(), strict=True)]
        yield b" ".join([b" ".join(x.split()) for x in runs] if tidy else runs)


def without_repeats(docs: DataFrame, window: int = 13, tidy: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, n_words, n_removed, kept: every row of docs without the words of its repeated windows.

    kept has one blank between words, or, if not tidy, the text as it is but for what goes.
    A word goes if a window of `window` words that covers it also starts in a document with a smaller id.
    row is a struct of the columns other than the text, so no names clash. Words are parted by blanks and 0x09 to
    0x0D; null and empty texts have none; a null id counts as the largest; rows with one id are one
    document, whose repeats of its own stay; an empty table gives no rows. A text is handled whole, in one task, however long it is.

    Documents are dealt to buckets by id and text, so neither null ids nor the rows of one id meet in one bucket. Each bucket asks, level by level, which of its windows other buckets have;
    only windows that are repeated at one length are asked for at the next, up to twice as long. At the first
    length a window asks for the part with the least hash alone. A bucket asks for a hash once, however many copies
    it holds, so a common passage makes no large group.
    """
    size = F.octet_length(F.col(c.quoted(text_col)).cast("string"))
    n, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    n_buckets = max(16, -(-n // min(max(int(2 * n**0.5), 256), MOST)), n_bytes // BYTES)
    n_parts = max(64, -(-n // 4096))
    id_ = F.col(f"row.{c.quoted(id_col)}").cast("bigint")
    placed = c.in_row(docs, text_col).withColumns({"id": id_, "bucket": c.buckets(F.xxhash64(id_, "text"), n_buckets)})
    n_levels = len(levels(window))

    def told(replies: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
        """The replies of each level, and the checks of the last one."""
        level = np.asarray(replies["level"], np.int64)
        parts = {x: [np.frombuffer(v, "<u8") for v in replies[x].to_pylist()] for x in ("hashes", "checks")}
        of = lambda x, i: np.concatenate([np.zeros(0, np.uint64), *(v for v, k in zip(parts[x], level, strict=True) if k == i)])
        return [np.unique(of("hashes", i)) if i < n_levels - 1 else of("hashes", i) for i in range(n_levels)], of("checks", n_levels - 1)

    def asking(level: int):
        def work(table: pa.Table, replies: pa.Table) -> pa.Table:
            if not table.num_rows:
                return pa.Table.from_pylist([], _schema(ASK))
            out = ask(Bucket(table, window, level == n_levels - 1), table["bucket"][0].as_py(), told(replies)[0][:level], n_parts)
            c.released()
            return out

        return work

    def answered(table: pa.Table) -> pa.Table:
        out = answer(table)
        c.released()
        return out

    spark = docs.sparkSession
    replies = spark.createDataFrame([], "bucket int, hashes binary, checks binary, level int")
    for level in range(n_levels):
        questions = placed.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(asking(level), ASK)
        new = questions.groupBy("part").applyInArrow(answered, REPLY).withColumn("level", F.lit(level))
        replies = replies.union(new) if level else new

    out = T.StructType([*placed.select("row").schema, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def work(table: pa.Table, replies: pa.Table) -> pa.Table:
        bucket = Bucket(table, window)
        gone = covered(bucket, *told(replies))
        removed = np.r_[0, np.cumsum(gone)]
        done = pa.table({
            "row": table["row"],
            "n_words": np.diff(bucket.first),
            "n_removed": np.diff(removed[bucket.first]),
            "kept": pa.array(kept_texts(bucket, gone, tidy), pa.binary()).cast(pa.string()),
        })
        del bucket, gone, removed
        c.released()
        return done

    return placed.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(work, out)
