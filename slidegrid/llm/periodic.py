"""Periodic runs of words: a suffix automaton whose link tree is accessed for each word, so that last places give squares."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slidegrid.llm.common import in_row, mix, quoted

#: A run has at least so many words, and at least two periods.
LEAST = 12
#: Words of a stretch that must stand again nearby: a run of LEAST words or of two periods repeats at least six in a row.
GRAM = LEAST // 2
#: Stretches with more words than this keep the automaton in packed arrays.
PACKED = 1 << 18


class Automaton:
    """Suffix automaton of a sequence of numbers; a state's first transition is apart, as most have no other."""

    def __init__(self, word: list[int]) -> None:
        row = list if len(word) < PACKED else lambda x: array("q", x)
        self.length, self.link, self.sym, self.to = row([0]), row([-1]), row([-1]), row([0])
        self.more: dict[int, dict[int, int]] = {}
        #: The state of each prefix.
        self.ends = row([])
        last = 0
        for c in word:
            last = self._append(last, c)
            self.ends.append(last)

    def _state(self, length: int, link: int, sym: int, to: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.sym.append(sym)
        self.to.append(to)
        return len(self.length) - 1

    def _append(self, p: int, c: int) -> int:
        length, link, sym, to, more = self.length, self.link, self.sym, self.to, self.more
        new = self._state(length[p] + 1, 0, -1, 0)
        q = -1
        while p >= 0:
            if sym[p] == c:
                q = to[p]
                break
            if sym[p] < 0:
                sym[p], to[p] = c, new
            else:
                others = more.get(p)
                if others is None:
                    more[p] = {c: new}
                else:
                    q = others.setdefault(c, new)
                    if q != new:
                        break
                    q = -1
            p = link[p]
        if q < 0:
            return new
        if length[q] == length[p] + 1:
            link[new] = q
            return new
        copy = self._state(length[p] + 1, link[q], sym[q], to[q])
        if q in more:
            more[copy] = dict(more[q])
        while p >= 0:
            if sym[p] == c:
                if to[p] != q:
                    break
                to[p] = copy
            else:
                others = more.get(p)
                if others is None or others.get(c) != q:
                    break
                others[c] = copy
            p = link[p]
        link[q] = link[new] = copy
        return new


class LinkCut:
    """Preferred paths of a rooted tree as splay trees by depth; all nodes of a path have one colour."""

    def __init__(self, parents) -> None:
        n = len(parents)
        row = (lambda v: [v] * n) if n < 2 * PACKED else (lambda v: array("q", [v]) * n)
        self.left, self.right, self.colour = row(-1), row(-1), row(-1)
        #: The parent in the splay tree, or, at its top, in the tree itself.
        self.parent = parents[:]
        self.inner = bytearray(n)

    def _splay(self, x: int) -> None:
        left, right, parent, inner, colour = self.left, self.right, self.parent, self.inner, self.colour
        if not inner[x]:
            return
        while inner[x]:
            p = parent[x]
            g = parent[p]
            steps = (x,)
            if inner[p]:
                steps = (p, x) if (left[g] == p) == (left[p] == x) else (x, x)
            for y in steps:
                # y goes above its parent
                z = parent[y]
                over = parent[z]
                if left[z] == y:
                    kid = left[z] = right[y]
                    right[y] = z
                else:
                    kid = right[z] = left[y]
                    left[y] = z
                if kid >= 0:
                    parent[kid] = z
                if inner[z]:
                    if left[over] == z:
                        left[over] = y
                    else:
                        right[over] = y
                    inner[y] = 1
                else:
                    inner[y] = 0
                    colour[y] = colour[z]
                parent[y], parent[z], inner[z] = over, y, 1

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Makes the path from the node to the root one colour; the segments it had: deepest node on the path, colour."""
        left, right, parent, inner, colours = self.left, self.right, self.parent, self.inner, self.colour
        segments, x, below = [], node, -1
        while x >= 0:
            self._splay(x)
            segments.append((x, colours[x]))
            deeper = right[x]
            if deeper >= 0:
                inner[deeper] = 0
                colours[deeper] = colours[x]
            right[x] = below
            if below >= 0:
                inner[below] = 1
            below = x
            x = parent[x]
        colours[below] = colour
        return segments


def squares(word: list[int]) -> dict[tuple[int, int], int]:
    """(start, period) of each run of at least two periods, and its last place.

    Words are appended one by one. The states of the suffixes that end at a place are a path of the link tree, parted into
    segments by where they ended last. A suffix as long as the distance to its last place makes a square, and
    the longest suffix of the segment gives where that period starts; the last place that does so ends the run.
    """
    states = Automaton(word)
    length = states.length
    tree = LinkCut(states.link)
    found: dict[tuple[int, int], int] = {}
    access = tree.access
    for i, state in enumerate(states.ends):
        for node, before in access(state, i):
            if before >= 0 and i - before <= length[node]:
                found[before - length[node] + 1, i - before] = i
    return found


def stretches(hashes: np.ndarray) -> list[tuple[int, int]]:
    """Parts of the words, as start and end, outside of which no run has a word.

    Each word of a run stands in a GRAM that is repeated at a distance of the period, which is at most half of the run; so
    what lies between words without such a repetition within half of their stretch is left. Equal hashes of different words only leave more.
    """
    n = len(hashes) - GRAM + 1
    if n < 2:
        return []
    grams = np.zeros(n, np.uint64)
    for k in range(GRAM):
        grams = mix(grams + hashes[k : k + n])
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    same = np.flatnonzero(ordered[1:] == ordered[:-1])
    if not len(same):
        return []
    near = np.full(n, n + 1)
    gap = order[same + 1] - order[same]
    near[order[same + 1]] = gap
    near[order[same]] = np.minimum(near[order[same]], gap)
    at = np.flatnonzero(near <= n)
    while len(at):
        first = np.flatnonzero(np.r_[True, np.diff(at) > GRAM])
        start, end = at[first], at[np.r_[first[1:], len(at)] - 1] + GRAM
        size = np.repeat(end - start, np.diff(np.r_[first, len(at)]))
        keep = (near[at] * 2 <= size) & (size >= LEAST)
        if keep.all():
            return list(zip(start.tolist(), end.tolist(), strict=True))
        at = at[keep]
    return []


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """start, length, period of all runs of the words, by start, then period."""
    if len(words) < LEAST:
        return []
    out = []
    for a, b in stretches(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)):
        numbers: dict[bytes, int] = {}
        part = [numbers.setdefault(w, len(numbers)) for w in words[a:b]]
        out += [(a + s, last - s + 1, q) for (s, q), last in squares(part).items() if last - s + 1 >= max(LEAST, 2 * q)]
    return sorted(out)


def periodic(words: list[bytes], key: int) -> list[bytes]:
    """The words as the number deals them: in one of ten cases, from some place on, the words of a period over and over."""
    n = len(words)
    if key % 10 or not n:
        return words
    g = key // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that stand in a run after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, length, q in found:
        edge[s + q] += 1
        edge[s + length] -= 1
    stay = np.cumsum(edge)[:-1] == 0
    return [w for w, x in zip(words, stay.tolist(), strict=True) if x]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """row, runs, kept: every row's runs as (start, length, period), by start, then period, and the text without their repeats.

    Words are parted by blanks and 0x09 to 0x0D; kept has one blank between them. A run is a stretch of words with a smallest period q,
    at least LEAST words and two periods long, that no neighbouring word extends. planted: rewrite the words first as `periodic` deals them by the CRC-32 of the id.

    Null and empty texts have no words and no runs; rows with a null id are left as they are; repeated rows have equal results; an empty table gives none. row is a
    struct of the other columns, so no names clash. A text is read whole, in the task that scans it, without any shuffle; only
    the stretches that hold repetitions go through the automaton, in n log n steps and some 200 to 500 bytes a word, whatever the length of the text.
    """
    held = in_row(docs, text_col).withColumn("id", F.col(f"row.{quoted(id_col)}").cast("bigint"))
    kind = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))
    out = T.StructType([*held.select("row").schema, T.StructField("runs", kind), T.StructField("kept", T.BinaryType())])
    run_type = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            each, kept = [], []
            for k, id_ in enumerate(batch.column("id").to_pylist()):
                words = (texts[k].as_py() or b"").split()
                if planted and id_ is not None:
                    words = periodic(words, zlib.crc32(str(id_).encode()))
                found = runs(words)
                each.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                kept.append(b" ".join(collapsed(words, found)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(each, run_type), pa.array(kept, pa.binary())], ["row", "runs", "kept"])

    return held.mapInArrow(work, out)


def digests(rows: DataFrame, id_: str) -> DataFrame:
    """doc_id, n_runs, the longest run and digests of all runs and of the kept words."""
    best = F.try_element_at(F.array_sort(F.transform("runs", lambda x: F.struct((-x["length"]).alias("n"), x["start"].alias("start"), x["period"].alias("period")))), F.lit(1))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    return rows.withColumn("best", best).select(
        F.col(id_).cast("bigint").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.n")).alias("length"),
        F.col("best.period").alias("period"), F.expr("CAST(1000 * -best.n DIV best.period AS BIGINT)").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )

