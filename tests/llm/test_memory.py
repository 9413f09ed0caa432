"""what training holds, and what workers keep between tasks."""

import subprocess
import sys
import tracemalloc

import numpy as np

from slidegrid.llm import toxicity


def _mb_of_trained() -> tuple[float, float]:
    """MB that numpy holds at most while a model is trained, and millions of its n-grams."""
    rng = np.random.default_rng(2)
    texts = [" ".join("".join(map(chr, w)) for w in rng.integers(97, 123, (60, 12))) for _ in range(2400)]
    labels = np.arange(2400) % 5 == 0
    tracemalloc.start()
    toxicity.train(texts, labels.astype(np.int32), steps=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6, len(toxicity.vocabulary(texts)[3]) / 1e6


def test_training_holds_few_bytes_an_ngram():
    """beside what every model has, training holds two numbers of 32 bits an n-gram, and pieces of fixed size."""
    mb, millions = _mb_of_trained()
    assert millions > 1
    assert mb < 60 + 40 * millions, (mb, millions)


def test_bags_in_pieces(monkeypatch):
    """Sums piece by piece are those of the whole, with groups larger than a piece, owners without rows, and items that nobody has."""
    rng = np.random.default_rng(3)
    sizes = np.r_[0, 40, rng.integers(0, 5, 200), 0]
    items = np.r_[np.full(30, 7), rng.integers(8, 50, sizes.sum() - 30)]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    each, own = rng.random(len(items)), rng.random(len(sizes))
    values, slopes = rng.random((2, 60)).astype(np.float32), rng.random((2, len(sizes))).astype(np.float32)
    for piece in (1, 16, 1 << 20):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        for bags, weight in ((toxicity.Bags(items, sizes, 60, each), each), (toxicity.Bags(items, sizes, 60, own, by_owner=True), own[owner])):
            for k in (0, 1):
                np.testing.assert_allclose(bags.forward(values)[k], np.bincount(owner, values[k][items] * weight, len(sizes)), rtol=1e-5)
                np.testing.assert_allclose(bags.backward(slopes)[k], np.bincount(items, slopes[k][owner] * weight, 60), rtol=1e-5)


def test_workers_give_memory_back():
    """what a task has freed does not stay with its worker, even below something that is still held."""
    code = """
import re
from slidegrid.llm import common as c

def mb():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

def work(batches):
    held = []
    for b in batches:
        parts = [bytearray(60_000) for _ in range(2_000)]
        held.append(parts.pop())
        stay.append(held[-1])
        yield b

stay = []
before = mb()
assert list(c.releasing(work)(iter([1, 2]))) == [1, 2]
assert mb() - before < 40, mb() - before
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert not done.returncode, done.stderr[-600:]
