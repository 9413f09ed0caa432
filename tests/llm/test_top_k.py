"""Exact search over many shards and blocks, and what boxes leave out."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slidegrid.llm import topk


def table(spark, v):
    return spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": v.tolist()}), "vec_id bigint, embedding array<double>")


def compare(got, v, k=20):
    whole = np.floor(v * 64).astype(np.int64)
    by_query = {q: own.sort_values("rank") for q, own in got.groupby("query_id")}
    for q in range(0, len(v), 20):
        score = whole @ whole[q]
        order = np.lexsort((np.arange(len(v)), -score))
        order = order[order != q][:k]
        assert by_query[q].id.tolist() == order.tolist() and by_query[q].score.tolist() == score[order].tolist()


def pairs_left(monkeypatch):
    """Records how many pairs of shard and block stay."""
    seen, real = [], topk.checkpointed

    def kept(df):
        out = real(df)
        if out.columns == ["shard", "block"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(topk, "checkpointed", kept)
    return seen


def test_clouds_in_many_shards(spark, monkeypatch):
    """Where vectors lie in clouds, boxes leave pairs out; small blocks and shards give the same rows."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 6)) * 8
    v = np.concatenate([c + rng.normal(size=(120, 6)) * 0.2 for c in centres])
    v = v[rng.permutation(len(v))]
    seen = pairs_left(monkeypatch)
    got = topk.top_k(table(spark, v), F.col("vec_id") % 20 == 0, 20, shard=64, block=8).toPandas()
    compare(got, v)
    shards, blocks = len(v) // 64, len(v) // 20 // 8
    assert seen[0] < 0.75 * shards * blocks


def test_spheres_in_many_shards(spark, monkeypatch):
    """Vectors without any order stay with nearly all shards, and are found all the same."""
    v = np.random.default_rng(6).normal(size=(900, 16))
    seen = pairs_left(monkeypatch)
    got = topk.top_k(table(spark, v), F.col("vec_id") % 20 == 0, 20, shard=100, block=10).toPandas()
    compare(got, v)
    assert seen[0] > 0


def test_components_out_of_range(spark):
    v = np.zeros((40, 2))
    v[3, 1] = topk.LARGEST / 64 - 1
    compare(topk.top_k(table(spark, v), F.col("vec_id") % 20 == 0, 5).toPandas(), v, 5)
    v[3, 1] = -topk.LARGEST / 64
    with pytest.raises(Exception, match="after scaling"):
        topk.top_k(table(spark, v), F.col("vec_id") % 20 == 0, 5).collect()
