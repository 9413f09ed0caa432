"""Licence scans: phrases, and an exact set-similarity join of text blocks with templates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidegrid.llm import common as c

#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Fixed templates: what licence notices say and the texts of short licences, as words, and their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
        "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
        "particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract "
        "tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
        "notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use "
        "data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc",
    ),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache "
        "org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or "
        "conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-2.0",
    ),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either "
        "version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied "
        "warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gpl-3.0",
    ),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must "
        "retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of "
        "conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and "
        "contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are "
        "disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not "
        "limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract "
        "strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
        "bsd",
    ),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at "
        "http mozilla org mpl 2 0",
        "mpl",
    ),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("dedicated to the public domain under cc0 1 0 universal", "cc0-1.0"),
)
THRESHOLD = 0.8
#: Least words of a stride; strides double up to the longest template.
SHORTEST = 8
APART = c.byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def stride(n_words: int) -> int:
    """From one block to the next for a template of n words: the next power of two; a block is twice as long, so each stretch of n words stands in one."""
    return max(SHORTEST, 1 << (n_words - 1).bit_length())


def word_hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer("\n".join(words).encode(), np.uint8)
    starts, ends, _ = c.words(data, np.array([0, len(data)]), APART)
    return c.word_hashes(data, starts, ends)[0]


class Templates:
    """Token sets of the templates, rarest first, and what leads from a rare token to them."""

    def __init__(self, frequency: dict[str, int], templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> None:
        self.names = vocabulary(templates)
        order = sorted(range(len(self.names)), key=lambda i: (frequency.get(self.names[i], 0), self.names[i]))
        self.place = {self.names[i]: k for k, i in enumerate(order)}
        hashes = word_hashes(self.names)
        by_hash = np.argsort(hashes)
        self.hashes, self.places = hashes[by_hash], np.array([self.place[self.names[i]] for i in by_hash])
        self.sets = [sorted({self.place[w] for w in text.split()}) for text, _ in templates]
        self.labels = [label for _, label in templates]
        self.need = [math.ceil(threshold * len(s) - 1e-9) for s in self.sets]
        #: By stride, token to the templates whose prefix it is in; a block that has no token of the prefix misses too many.
        self.prefix: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, tokens in enumerate(self.sets):
            mine = self.prefix.setdefault(stride(len(templates[t][0].split())), {})
            for p, token in enumerate(tokens[: len(tokens) - self.need[t] + 1]):
                mine.setdefault(token, []).append((t, p))
        self.rare = {k: np.isin(np.arange(len(self.names) + 1), list(prefix)) for k, prefix in self.prefix.items()}

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words in the order of frequency, -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.places[at], -1)

    def matches(self, block: np.ndarray, n_words: int, step: int) -> dict[int, float]:
        """Templates of the stride whose share of tokens in the block reaches the threshold. block: its tokens in order, each once."""
        out: dict[int, float] = {}
        seen = set(block.tolist())
        tried = set()
        for q, token in enumerate(block.tolist()):
            for t, p in self.prefix[step].get(token, ()):
                if t in tried:
                    continue
                tried.add(t)
                tokens, need = self.sets[t], self.need[t]
                # the first common token stands at p and q, so both sides' rest bounds what is common
                if n_words < need or 1 + min(len(tokens) - p - 1, len(block) - q - 1) < need:
                    continue
                common = sum(x in seen for x in tokens)
                if common >= need:
                    out[t] = common / len(tokens)
        return out


def vocabulary(templates: tuple = TEMPLATES) -> list[str]:
    return sorted({w for text, _ in templates for w in text.split()})


def _pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    data, offsets = c.text_bytes(column)
    data = _LOWER[data]
    for a, b in c.steps(offsets):
        piece, places = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = c.words(piece, places, APART)
        yield first, c.word_hashes(piece, starts, ends)[0], a, b


def frequencies(docs: DataFrame, text_col: str, templates: tuple = TEMPLATES) -> dict[str, int]:
    """How often each word of the templates stands in all of docs; as many rows as the templates have words come back."""
    names = vocabulary(templates)
    hashes = word_hashes(names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(hashes)
        total = np.zeros(len(names), np.int64)
        for b in batches:
            for _, h, _, _ in _pieces(b.column(0)):
                at = np.minimum(np.searchsorted(hashes[order], h), len(names) - 1)
                total += np.bincount(order[at[hashes[order][at] == h]], minlength=len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], ["word", "n"])

    counted = docs.select(F.col(c.quoted(text_col)).cast("string").alias("text")).mapInArrow(work, "word string, n bigint")
    return {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def _phrases(h: np.ndarray, first: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """Places of each phrase: consecutive words of one text."""
    n = len(h)
    last = np.repeat(first[1:], np.diff(first))
    out = []
    for phrase, label in PHRASES.items():
        own = word_hashes(phrase.split())
        hit = np.flatnonzero(h == own[0])
        hit = hit[hit + len(own) <= last[hit]] if n else hit
        for k in range(1, len(own)):
            hit = hit[h[hit + k] == own[k]]
        out.append((label, hit))
    return out


def _join(known: Templates, first: np.ndarray, h: np.ndarray) -> dict[int, dict[int, float]]:
    """Templates that each text's blocks match, with the largest share.

    A block is twice a stride's words of a text, whatever the lines, from each multiple of the stride on; only blocks
    with a token of a template's prefix are looked at.
    """
    tokens = known.tokens(h)
    found: dict[int, dict[int, float]] = {}
    for step, of_prefix in known.rare.items():
        rare = np.flatnonzero(of_prefix[tokens])
        if not len(rare):
            continue
        doc = np.searchsorted(first, rare, "right") - 1
        own = first[doc]
        near = (rare - own) // step * step
        starts, where = np.unique(np.concatenate([own + near, own + np.maximum(near - step, 0)]), return_index=True)
        for s, d in zip(starts.tolist(), np.concatenate([doc, doc])[where].tolist(), strict=True):
            e = min(s + 2 * step, int(first[d + 1]))
            block = np.unique(tokens[s:e])
            for t, share in known.matches(block[block >= 0], e - s, step).items():
                best = found.setdefault(d, {})
                best[t] = max(share, best.get(t, 0.0))
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score: what every text says of licences.

    Phrases are found word by word. Then each block of a text (stride() gives its length, newlines count for nothing) is joined with every template of which it has
    `threshold` of the tokens or more: tokens are ordered by how often they stand in docs, blocks are looked at only if
    they have one of a template's rarest tokens, and length and place of the first common token bound what
    is left. The score is the largest share of a template, 1 for a phrase. Null and empty texts have no words and score
    0; null ids are kept; repeated rows each stay; an empty table gives no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(Templates(frequencies(docs, text_col, templates), templates, threshold))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for first, h, a, b in _pieces(batch.column(1)):
                n = np.diff(first)
                count, low, high = np.zeros(b - a, np.int64), np.full(b - a, len(h)), np.full(b - a, -1)
                base: dict[int, set[str]] = {}
                doc = np.repeat(np.arange(b - a), n)
                for label, hit in _phrases(h, first):
                    own, place = doc[hit], hit - first[doc[hit]]
                    count += np.bincount(own, minlength=b - a)
                    np.minimum.at(low, own, place)
                    np.maximum.at(high, own, place)
                    for i in np.unique(own).tolist():
                        base.setdefault(i, set()).add(label)
                joined = _join(known.value, first, h)
                for i in range(b - a):
                    own, more = base.get(i, set()), joined.get(i, {})
                    some = bool(count[i])
                    rows.append((
                        int(n[i]), int(count[i]), int(low[i]) if some else None, int(high[i]) if some else None, ",".join(sorted(own)),
                        ",".join(sorted(own | {known.value.labels[t] for t in more})), 1.0 if some else max(more.values(), default=0.0),
                    ))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kept = docs.select(F.col(c.quoted(id_col)).cast("bigint").alias("id"), F.col(c.quoted(text_col)).cast("string").alias("text"))
    return kept.mapInArrow(work, "id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
