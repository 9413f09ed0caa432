"""Manifests, periodic runs and language-model scores against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidegrid.llm import lm, manifest, periodic, queries
from slidegrid.llm.labelled import held_out

COLUMNS = "doc_id bigint, source string, lang string, n_chars bigint, text string, g string, i int, row string, `a.b` int"
LONG = "Very Long " * 120_000


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in each column, empty and long texts, repeated rows and ids, ids of any sign and size, names that clash."""
    rng = random.Random(3)
    texts = ["", None, "One two", "a b " * 40, LONG, "x y z " * 9, "Σας ÄÖ\x0b q" * 3, "w " * 11, "w " * 12]
    rows = [(i, f"s{i % 3}", ("en", "de", None, "é")[i % 4], i, texts[i % len(texts)]) for i in range(80)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (None, "s", "en", 1, "Null Id"), (5, "s2", "de", 5, "other Text"), (5, None, "de", 5, "B")]
    rows += [(x, "s", "en", 1, "far") for x in (-1, -(1 << 63), (1 << 63) - 1, 1 << 40, -(1 << 40), 1 << 53, 63, 64, 1023, 1024)]
    rows += [(77, "hot", "hot", 0, f"Text {i}") for i in range(150)] + [(77, "hot", "hot", 0, "same")] * 120
    rows += [(i, "s", f"l{i}", 0, None) for i in range(70)] + rows[:3]
    rng.shuffle(rows)
    return spark.createDataFrame([(*r, "g", 1, "row", 2) for r in rows], COLUMNS)


def want_manifest(rows):
    """Sorted lists and recursion; one result for each row."""

    def leaf(r, text):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    def level(nodes):
        return [sha("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append(level(out[-1]))
        return out

    def path(all_levels, i):
        for nodes in all_levels[:-1]:
            a = i // 8 * 8
            yield nodes[a:i], nodes[i + 1 : a + 8]
            i //= 8

    groups = defaultdict(list)
    for r in rows:
        low = None if r.text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
        other = leaf(r, low) if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 else None
        groups[r.lang].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), other, r.doc_id))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([n[2] for n in sorted(groups[x], key=lambda n: n[:3])]) for x in names}
    over = levels([trees[x][-1][0] for x in names])
    out = []
    for k, x in enumerate(names):
        for i, (_, _, own, other, doc_id) in enumerate(sorted(groups[x], key=lambda n: n[:3])):
            steps = [*path(trees[x], i), *path(over, k)]
            node = other or own
            for left, right in steps:
                node = sha("".join([*left, node, *right]))
            siblings = "".join(y for left, right in steps for y in [*left, *right])
            out.append((doc_id, own, trees[x][-1][0], over[-1][0], sha(siblings), node, node == over[-1][0]))
    return out


def as_query(spark, docs, tmp_path, query):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return query(spark, str(tmp_path))


def test_manifest(spark, odd, tmp_path):
    got = as_query(spark, odd, tmp_path, queries.op11_merkle_manifest).collect()
    want = want_manifest(odd.collect())
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert 0 < sum(r.verified for r in got) < len(got)


def test_manifest_of_random_ids(spark):
    """Ids spread over 64 bits, more leaves than two rounds of chunks hold, and one group alone."""
    rng = random.Random(5)
    ids = sorted({rng.randrange(-(1 << 63), 1 << 63) for _ in range(3000)}) + list(range(5000, 6500))
    docs = spark.createDataFrame([(i, "s", "en", 1, str(i)) for i in ids], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    got = manifest.manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    got = got.select("id", "leaf", "subroot", "root", F.sha2(manifest.proof(F.col("path")), 256), "folded_root", F.col("folded_root") == F.col("root"))
    assert sorted(map(tuple, got.collect())) == sorted(want_manifest(docs.collect()))


def test_empty_tables(spark, odd, tmp_path):
    empty = odd.where("false")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    for query in (queries.op11_merkle_manifest, queries.op12_periodic_runs, queries.op13_lm_scores):
        assert query(spark, str(tmp_path)).collect() == []


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(r for r in out if not any(s <= r[0] and s + m >= r[0] + r[1] and q < r[2] for s, m, q in out))


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(1500):
        n, k = rng.randrange(0, 70), rng.choice([1, 2, 3, 5, 20])
        w = [str(rng.randrange(k)).encode() for _ in range(n)]
        if rng.random() < 0.6 and n > 14:
            a, q = rng.randrange(n), rng.randrange(1, 12)
            w = w[:a] + ((w[a : a + q] or w[:1]) * n)[: n - a]
        assert periodic.runs(w) == brute_runs(w)


def test_runs_of_known_words():
    """Thue-Morse words have squares but no longer powers, Fibonacci words many runs; both over words, not letters."""
    thue, other, fib, last = [b"a"], [b"b"], [b"a", b"b"], [b"a"]
    while len(thue) < 512:
        thue, other = thue + other, other + thue
        fib, last = fib + last, fib
    fib = fib[:600]
    assert periodic.runs(thue) == brute_runs(thue)
    assert all(length <= 2 * q for _, length, q in periodic.runs(thue))
    assert periodic.runs(fib) == brute_runs(fib)


def test_runs_of_very_long_texts(monkeypatch):
    """A million words in one run, and the packed form of the automaton."""
    rng = random.Random(2)
    base = [str(rng.randrange(300)).encode() for _ in range(2000)]
    assert periodic.runs(base * 200) == [(0, 400_000, 2000)]
    monkeypatch.setattr(periodic, "PACKED", 10)
    for _ in range(200):
        w = [str(rng.randrange(2)).encode() for _ in range(60)]
        assert periodic.runs(w) == brute_runs(w)


def test_words_that_hash_alike(monkeypatch):
    """Hashes only choose where to look."""
    w = [str(i % 40).encode() for i in range(100)]
    want = periodic.stretches(np.zeros(100, np.uint64))
    assert want == [(0, 100)]
    monkeypatch.setattr(periodic, "stretches", lambda hashes: [(0, len(hashes))])
    assert periodic.runs(w) == brute_runs(w)


def test_periodic_runs_query(spark, odd, tmp_path):
    got = as_query(spark, odd, tmp_path, queries.op12_periodic_runs).collect()
    want = []
    for r in odd.collect():
        w = (r.text or "").encode().split()
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        found = brute_runs(w) if len(w) < 1000 else periodic.runs(w)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((r.doc_id, len(found), *figures, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert any(r.n_runs for r in got)


def brute_base(rows):
    held = {r.doc_id for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1}
    low = lambda t: [*(t or "").encode().lower().split(), None]
    count = Counter(w for r in rows if r.doc_id not in held for w in low(r.text))
    n, v = sum(count.values()), len(count)
    for r in rows:
        words = low(r.text)
        yield r.doc_id, r.doc_id in held, len(words), sum(count[w] > 0 for w in words), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)


@pytest.mark.parametrize("hot", [1 << 16, 12])
def test_base_scores(spark, odd, tmp_path, monkeypatch, hot):
    """With words that every task knows, and with most of them looked up by the join."""
    monkeypatch.setattr(lm, "HOT", hot)
    docs = odd.where("octet_length(text) < 100000 OR text IS NULL OR doc_id = 4").union(odd.sparkSession.createDataFrame([(1, "s", "en", 1, "rare " + "r" * 500 + " unknown1", "g", 1, "r", 1), (2, "s", "en", 1, "r" * 500, "g", 1, "r", 1)], COLUMNS))
    got = as_query(spark, docs, tmp_path, queries.op13_lm_scores).collect()
    want = list(brute_base(docs.collect()))
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, (x[:5] for x in want)))
    assert sorted(r.base_score for r in got) == pytest.approx(sorted(x[5] for x in want), rel=1e-9)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_scores_add_up(spark, monkeypatch):
    """After any words, the probabilities of all words, and of an unknown one in each class, are one."""
    monkeypatch.setattr(lm, "HOT", 300)
    train = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(12)
    learn = train.select(F.col("doc_id"), "text").checkpoint() if spark.sparkContext.getCheckpointDir() else train.select("doc_id", "text")
    counted = {bytes(r.name): (r.kind, r.n) for r in lm.counts(learn).collect()}
    unknown, k = {}, 0
    while len(unknown) < lm.CLASSES:
        unknown.setdefault(lm.kind(b"?%d" % k), b"?%d" % k)
        k += 1
    words = [w for w in counted if w] + [*unknown.values()]
    rows = [(i, "the " + w.decode(), True) for i, w in enumerate(words)] + [(-1, "the", True)]
    docs = learn.selectExpr("doc_id", "text", "false AS probe").union(spark.createDataFrame(rows, "doc_id bigint, text string, probe boolean"))
    found, vocab = lm.scored(docs, ~F.col("probe"))
    score = {r.doc_id: r.score for r in found.where("row.probe").select("row.doc_id", "score").collect()}
    # of `the w` and the end only w is wanted: the end after it differs by word, so take it off by a model of one's own
    model = lm.trained(docs.where("NOT probe"), vocab)
    codes = vocab.codes()
    total = 0.0
    for i, w in enumerate(words):
        code = np.array([codes[b"the"], codes[w], codes[b""]])
        own = model.log10(lm.contexts(code, np.array([0, 3]), vocab), vocab.unit[code]) + vocab.within[code]
        if code[1] >= codes.known:
            c = counted.get(w, (0, 0))[1]
            own[1] += math.log10((c + 0.5) / vocab.class_denominators()[lm.kind(w)])
        first = own[0] if codes[b"the"] < codes.known else own[0] + math.log10((counted[b"the"][1] + 0.5) / vocab.class_denominators()[lm.kind(b"the")])
        assert score[i] == pytest.approx(first + own[1] + own[2] + (0 if codes[b""] < codes.known else math.log10((counted[b""][1] + 0.5) / vocab.class_denominators()[lm.kind(b"")])), rel=1e-3)
        total += 10 ** own[1]
    code = np.array([codes[b"the"], codes[b""]])
    own = model.log10(lm.contexts(code, np.array([0, 2]), vocab), vocab.unit[code])[1] + vocab.within[code[1]]
    total += 10 ** (own if code[1] < codes.known else own + math.log10((counted[b""][1] + 0.5) / vocab.class_denominators()[lm.kind(b"")]))
    assert total == pytest.approx(1, abs=1e-4)


def test_gradients():
    """Against differences of the noise-contrastive loss."""
    rng = np.random.default_rng(1)
    noise = rng.dirichlet(np.ones(lm.UNITS))
    model = lm.Model(lm.Model.start(noise).flat + rng.normal(0, 0.05, lm.Model.size).astype(np.float32))
    context, target = rng.integers(0, 50, (40, lm.CONTEXT)), rng.integers(0, lm.UNITS, 40)
    drawn = np.bincount(rng.choice(lm.UNITS, lm.NOISE, p=noise), minlength=lm.UNITS)

    def loss(m):
        q = sum(m.rows[context[:, k]].astype(float) @ m.places[k].astype(float) for k in range(lm.CONTEXT))
        d = q @ m.units.T.astype(float) + m.bias - np.log(lm.NOISE * noise)
        return (np.log1p(np.exp(-d[np.arange(40), target])).sum() + (drawn * np.log1p(np.exp(d))).sum()) / 40

    g = model.gradients(context, target, noise, drawn)
    for _ in range(5):
        way = rng.normal(0, 1, lm.Model.size)
        way[np.abs(g) == 0] = 0
        up, down = lm.Model(model.flat + 1e-3 * way), lm.Model(model.flat - 1e-3 * way)
        assert (loss(up) - loss(down)) / 2e-3 == pytest.approx(float(g @ way), rel=0.02, abs=0.02)


def test_model_beats_counts(spark):
    """On texts that it did not learn from; and it is not told which those are but by the split."""
    found = queries.op13_lm_scores(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert found[0] > found[1] + 0.1


def test_what_is_learnt_does_not_depend_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("text", F.when(held_out("doc_id", 5, 1), F.lit("something else")).otherwise(F.col("text")))
    scores = [{r.doc_id: r.score for r in lm.scored(x, ~held_out("doc_id", 5, 1))[0].where("learnt").select("row.doc_id", "score").collect()} for x in (docs, other)]
    assert scores[0].keys() == scores[1].keys()
    assert all(abs(scores[0][k] - scores[1][k]) < 1e-6 * abs(scores[0][k]) for k in scores[0])


def test_every_position_is_trained_on(spark):
    """Texts of six tokens whose first word tells the others: a training on every sixth token would see first words alone."""
    rows = [(i, " ".join(f"w{(i * i // 7 + k) % 8}" for k in range(5))) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    score, base = lm.scored(docs, F.lit(True))[0].agg(F.avg("score"), F.avg("base_score")).first()
    assert base < -4.5 and score > base / 2


def test_codes_are_those_of_all_tokens(spark):
    """Also of texts that lie across blocks, and of those with the end alone."""
    docs = spark.createDataFrame([(" ".join(f"w{i * k % 7}" for k in range(n)),) for i, n in enumerate((0, 1, 2, 5, 700, 70_000, 1300))], "text string").coalesce(1)
    vocab = lm.vocabulary(lm.counts(docs))
    (batch,) = lm.encoded(docs, vocab).select("code").toArrow().combine_chunks().to_batches()
    codes = vocab.codes()
    want = [np.array([codes[w] for w in lm.tokens(r.text.encode())]) for r in docs.collect()]
    got = [code[a:b] for code, first in lm._blocks(batch.column("code")) for a, b in zip(first, first[1:])]
    assert len(got) == len(want) and all((x == y).all() for x, y in zip(got, want))
    sliced = [code[a:b] for code, first in lm._blocks(batch.slice(2, 3).column("code")) for a, b in zip(first, first[1:])]
    assert len(sliced) == 3 and all((x == y).all() for x, y in zip(sliced, want[2:5]))
