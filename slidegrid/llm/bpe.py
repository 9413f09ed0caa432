"""Byte-pair encoding: greedy longest matches, checked pair by pair, merged exactly only where a check fails."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slidegrid.llm.common import out_of_row, quoted, releasing

#: The suffix that marks the last symbol of a word in the vocabulary.
END = "</w>"
#: White space of Unicode, which the tokenizer's \s stands for.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and numbers below U+0100, as \p{L} and \p{N} have them.
LATIN, LATIN_NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Fixed ranges: marks and one vowel sign of later versions of Unicode, which the tokenizer's NFC does not move or join.
UNMOVED = (
    "\u07fd \u0898-\u089f \u08ca-\u08d3 \u09fe \u0c3c \u0d3b-\u0d3c \u0eba \u1715 \u1abf-\u1ace \u1df6-\u1dfa \ua82c \U00010d24-\U00010d27 \U00010eab-\U00010eac \U00010efd-\U00010eff "
    "\U00010f46-\U00010f50 \U00010f82-\U00010f85 \U00011070 \U0001133b \U0001145e \U00011839-\U0001183a \U00011930 \U00011938 \U0001193d-\U0001193e \U00011943 \U000119e0 \U00011a34 \U00011a47 "
    "\U00011a99 \U00011d42 \U00011d44-\U00011d45 \U00011d97 \U00011f41-\U00011f42 \U00016ff0-\U00016ff1 \U0001e08f \U0001e130-\U0001e136 \U0001e2ae \U0001e2ec-\U0001e2ef \U0001e4ec-\U0001e4ef"
).replace(" ", "")
#: Capitals that the tokenizer lower-cases and Unicode 15.1 does not know yet (first, last, how far).
CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1),
    (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
#: Fixed ranges: letters and numbers of a later version of Unicode than the tokenizer's, which are neither to it.
LATE = (
    "\u0558 \u058b-\u058c \u088f \u0c5c \u0cdc \u208f \u209d-\u209f \ua7ce-\ua7cf \ua7d2 "
    "\ua7d4 \ua7dd \ua7e2 \ua7f1 \uab6c-\uab6d \U000107bb-\U000107bf \U00010940-\U00010959 \U00010ec5-\U00010ec7 \U00010ed9-\U00010eee "
    "\U00011b0a \U00011db0-\U00011ddb \U00011de0-\U00011de9 \U00011df1 \U0001246f \U00012475-\U0001247f \U00012550-\U00012686 \U00016ea0-\U00016eb8 \U00016ebb-\U00016ed3 "
    "\U00016ff2-\U00016ff6 \U000187f8-\U000187ff \U00018cd6-\U00018cda \U00018d09-\U00018d20 \U00018d80-\U00018df2 \U00018e00-\U00019191 \U000191a0-\U000191d2 \U0001b123-\U0001b128 \U0001b168 "
    "\U0001d6a6 \U0001df1f-\U0001df24 \U0001df2b-\U0001df81 \U0001df90-\U0001df96 \U0001dfcd-\U0001dfff \U0001e6c0-\U0001e6de \U0001e6e0-\U0001e6e2 \U0001e6e4-\U0001e6e5 \U0001e6e7-\U0001e6ed "
    "\U0001e6f0-\U0001e6f4 \U0001e6fe-\U0001e6ff \U0002b73a-\U0002b73f \U0002b81e \U0002cea2-\U0002cead \U000323b0-\U00033479 \U0003d000-\U0003fc3f "
).replace(" ", "")
#: Longer words are merged with a heap.
HEAPED = 64
#: Words that a worker remembers at most; then it starts anew.
REMEMBERED = 1 << 18
NEVER = np.int64(1) << 40


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it can be seen, else one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in set(seen) else chr(next(hidden)) for b in range(256)]


class Codec:
    """A vocabulary of words' pieces, and the words that this worker has met."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # white space stands in no word, so it need not be replaced by blanks first
        self.pattern = regex.compile(pattern.replace(r"\s", SPACE))
        known = pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.unmoved = regex.compile(f"([{UNMOVED}])")
        self.lower = {c: c + by for a, b, by in CAPITALS for c in range(a, b + 1) if chr(c).lower() == chr(c)}
        self.late = regex.compile(f"[{LATE}{''.join(map(chr, self.lower))}]")
        self.pinned = regex.compile("(?V1)" + regex.sub(r"\\p\{([LN])\}", lambda m: rf"[\p{{{m[1]}}}--[{LATE}]]", self.pattern.pattern))
        self.latin = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[{LATIN_NUMBERS}]|[^{SPACE}{LATIN}{LATIN_NUMBERS}]+") if known else self.pattern
        letters = _byte_letters()
        back = {x: b for b, x in enumerate(letters)}
        self.size = max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]) + 1
        self.names = [""] * self.size
        self.inner: dict[bytes, int] = {}
        self.last: dict[bytes, int] = {}
        for name, i in vocab.items():
            self.names[i] = name
            end = name.endswith(END)
            raw = bytes(back[x] for x in (name[: -len(END)] if end else name))
            (self.last if end else self.inner)[raw] = i
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for name, i in self.added.items():
            self.names[i] = name
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.longest = max(map(len, self.last))
        #: The longest token by its first three bytes.
        self.reach: dict[bytes, int] = {}
        for raw in self.inner:
            self.reach[raw[:3]] = max(len(raw), self.reach.get(raw[:3], 0))
        self.left, self.right = np.full(self.size, -1), np.full(self.size, -1)
        self.rank = np.full(self.size, -1)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            i, pair = vocab[a + b], (vocab[a], vocab[b])
            self.merges.setdefault(pair, (r, i))
            if self.rank[i] < 0:
                self.left[i], self.right[i], self.rank[i] = *pair, r
        pairs = sorted((a * self.size + b, r) for (a, b), (r, _) in self.merges.items())
        self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        made = np.flatnonzero(self.rank >= 0)
        whole = np.ones(self.size, bool)
        whole[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for i in made[np.argsort(self.rank[made])]:
            whole[i] &= whole[self.left[i]] and whole[self.right[i]]
        #: Tokens that merging their own symbols gives back.
        self.whole = whole
        self.words: dict[str, bytes] = {}

    def compatible(self, a: np.ndarray, b: np.ndarray, made_by: np.ndarray | None = None) -> np.ndarray:
        """Whether merging a's and b's symbols together keeps the border between them.

        Symbols x and y meet at the border while both exist: from the later of their own merges to the earlier of the
        merges that use them up. Their merge crosses the border if its rank comes before those: before
        the left one's, and not after the right one's, as of equal merges the leftmost goes first. The pairs that
        meet are walked backwards by undoing the later merge. made_by: ranks of merges of the pair itself, which don't count.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit_x, limit_y = np.full(len(x), NEVER), np.full(len(x), NEVER)
        fine, todo = np.ones(len(x), bool), np.arange(len(x))
        if made_by is not None:
            limit_x = made_by.astype(np.int64)
            limit_y = limit_x - 1
        while len(todo):
            u, v = x[todo], y[todo]
            keys = u * self.size + v
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            r = np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)
            crossed = (r < limit_x[todo]) & (r <= limit_y[todo])
            fine[todo[crossed]] = False
            go = ~crossed & ((self.rank[u] >= 0) | (self.rank[v] >= 0))
            todo, u, v = todo[go], u[go], v[go]
            undo_left = self.rank[u] > self.rank[v]
            i, j = todo[undo_left], todo[~undo_left]
            limit_x[i], x[i] = self.rank[u[undo_left]], self.right[u[undo_left]]
            limit_y[j], y[j] = self.rank[v[~undo_left]], self.left[v[~undo_left]]
        return fine

    def greedy(self, word: bytes) -> list[int]:
        """The longest token at each place; the last one has to end the word."""
        at, n, out = 0, len(word), []
        inner, last, longest, reach = self.inner, self.last, self.longest, self.reach.get
        while at < n:
            if n - at <= longest and (i := last.get(word[at:])) is not None:
                out.append(i)
                break
            for to in range(min(at + reach(word[at : at + 3], 2), n - 1), at, -1):
                if (i := inner.get(word[at:to])) is not None:
                    out.append(i)
                    at = to
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: again and again the pair of least rank, from the left."""
        if len(word) > HEAPED:
            return self.merged_by_heap(word)
        inner, merges = self.inner, self.merges
        ids = [inner[word[i : i + 1]] for i in range(len(word) - 1)] + [self.last[word[-1:]]]
        none = (1 << 40, -1)
        pairs = [merges.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while pairs and (least := min(pairs)) is not none:
            i = pairs.index(least)
            ids[i : i + 2] = [least[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = merges.get((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = merges.get((ids[i], ids[i + 1]), none)
        return ids

    def merged_by_heap(self, word: bytes) -> list[int]:
        """As merged(), in n log n: neighbours are linked, and pairs that no longer stand are skipped."""
        merges = self.merges
        ids = [self.inner[word[i : i + 1]] for i in range(len(word) - 1)] + [self.last[word[-1:]]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*merges[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, made, i, (left, right) = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := (made, ids[k])) in merges:
                    heapq.heappush(heap, (*merges[p], i, p))
            h = before[i]
            if h >= 0 and (p := (ids[h], made)) in merges:
                heapq.heappush(heap, (*merges[p], h, p))
        return [i for i in ids if i >= 0]

    def learn(self, words: list[str]) -> None:
        """Encode words that were not met before."""
        raw = [w.encode() for w in words]
        found = [self.greedy(w) for w in raw]
        sizes = np.array([len(x) for x in found])
        flat = np.fromiter((i for x in found for i in x), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(found)), sizes)
        inside = owner[1:] == owner[:-1]
        keys, back = np.unique((flat[:-1] * self.size + flat[1:])[inside], return_inverse=True)
        fine = self.compatible(keys // self.size, keys % self.size)[back] if len(keys) else np.ones(0, bool)
        bad = np.zeros(len(found), bool)
        bad[owner[1:][inside][~fine]] = True
        bad[owner[~self.whole[flat]]] = True
        for i in np.flatnonzero(bad).tolist():
            found[i] = self.merged(raw[i])
        for w, ids in zip(words, found, strict=True):
            self.words[w] = np.array(ids, "<u4").tobytes()

    def pieces(self, text: str) -> list[str]:
        """The normalized text's words."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = "".join(unicodedata.normalize("NFC", x) for x in self.unmoved.split(text))
        low = text.lower() if "\u03a3" not in text else "".join(map(str.lower, text))
        try:
            low.encode("latin-1")
        except UnicodeEncodeError:
            if self.late.search(low):
                return self.pinned.findall(low.translate(self.lower))
            return self.pattern.findall(low)
        return self.latin.findall(low)

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        parts = [[self.pieces(t)] if not self.split_added or "<|" not in t else self._around(t) for t in texts]
        if len(self.words) > REMEMBERED:
            self.words.clear()
        new = {w for text in parts for p in text if not isinstance(p, int) for w in p} - self.words.keys()
        if new:
            self.learn(sorted(new))
        get = self.words.__getitem__
        return [b"".join(p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(get, p)) for p in text) for text in parts]

    def _around(self, text: str) -> list:
        return [self.added[x] if x in self.added else self.pieces(x) for x in self.split_added.split(text) if x]

    def decode_ids(self, ids: bytes) -> str:
        """Tokens' names joined by blanks, as the tokenizer has no decoder of its own."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    """Read once by each worker."""
    return Codec(path)


def _groups(column: pa.Array, most: int = 1 << 20) -> Iterator[list]:
    """The column's values in lists of about `most` bytes."""
    group, size = [], 0
    for x in column:
        x = x.as_py()
        group.append(x)
        size += len(x) if x else 0
        if size > most:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with a column of token ids, array<int>; null texts count as empty. A column of that name is replaced."""
    rest = [x for x in docs.columns if x != ids_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in _groups(b.column(1)):
                ids = codec(path).encode_texts([t or "" for t in texts])
                offsets = np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), b.column(1).slice(at, len(texts)), pa.ListArray.from_arrays(offsets, values)], ["row", "text", "ids"])
                at += len(texts)

    kept = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(quoted(x)) for x in rest if x != text_col]).alias("row"), F.col(quoted(text_col)).cast("string").alias("text"))
    out = T.StructType([*kept.schema, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    done = kept.mapInArrow(work, out)
    return done.select(*out_of_row(rest, {text_col: F.col("text")}), F.col("ids").alias(ids_col))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with the text of a column of token ids; null ids count as none. A column of that name is replaced."""
    rest = [x for x in docs.columns if x != text_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [codec(path).decode_ids(np.array(x.as_py() or [], "<u4").tobytes()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["row", "ids", "text"])

    kept = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(quoted(x)) for x in rest if x != ids_col]).alias("row"), F.col(quoted(ids_col)).alias("ids"))
    done = kept.mapInArrow(work, T.StructType([*kept.schema, T.StructField("text", T.StringType())]))
    return done.select(*out_of_row(rest, {ids_col: F.col("ids")}), F.col("text").alias(text_col))


def counted(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n: how many tokens every row's text has; null and empty texts have none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            n = [len(ids) // 4 for texts in _groups(b.column(1)) for ids in own.encode_texts([t or "" for t in texts])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["id", "n"])

    kept = docs.select(F.col(quoted(id_col)).cast("bigint").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return kept.mapInArrow(releasing(work), "id bigint, n bigint")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: digests of every text's ids and of the text decoded from them.

    Encodes and decodes as encode() and decode() do, in one pass, so that ids stay in the task.
    Null and empty texts have no tokens; repeated rows each stay; an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            n, ids_digest, text_digest = [], [], []
            for texts in _groups(b.column(1)):
                for ids in own.encode_texts([t or "" for t in texts]):
                    n.append(len(ids) // 4)
                    ids_digest.append(hashlib.sha256(ids).hexdigest())
                    text_digest.append(hashlib.sha256(own.decode_ids(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return kept.mapInArrow(work, f"id {kept.schema['id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
