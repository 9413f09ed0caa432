"""Datasets along the curve: keys, ranges, and what a viewport reads."""

import random

import pytest
from pyspark.sql import functions as F

from slidegrid import fixtures as fx
from slidegrid.sources import layout

SF = "/root/testdata/sf0.001"


def key_of(x, y):
    """Bit by bit."""
    cx, cy = (min(max(int(v // layout.CELL), 0), (1 << layout.BITS) - 1) for v in (x, y))
    return sum(((cx >> i & 1) << 2 * i) | ((cy >> i & 1) << 2 * i + 1) for i in range(layout.BITS))


def test_keys(spark):
    rng = random.Random(1)
    points = [(rng.uniform(-100, 80_000_000), rng.uniform(-100, 80_000_000)) for _ in range(300)] + [(0.0, 0.0), (63.9, 64.0), (-5.0, 1e12)]
    rows = spark.createDataFrame(points, "x double, y double").select("x", "y", layout.curve_key(F.col("x"), F.col("y")).alias("k")).collect()
    assert all(r.k == key_of(r.x, r.y) for r in rows)
    assert spark.range(1).select(layout.curve_key(F.lit(None).cast("double"), F.lit(1.0))).first()[0] is None


@pytest.mark.parametrize("most", [1, 4, 64])
def test_ranges_hold_the_box(most):
    rng = random.Random(2)
    for _ in range(200):
        size = 10 ** rng.uniform(0, 6)
        l, t = rng.uniform(-10, 2_000_000), rng.uniform(-10, 2_000_000)
        r, b = l + rng.uniform(0, size), t + rng.uniform(0, size)
        ranges = layout.key_ranges(l, r, t, b, most)
        assert 1 <= len(ranges) <= most and all(a <= z for a, z in ranges) and all(x[1] + 1 < y[0] for x, y in zip(ranges, ranges[1:], strict=False))
        for _ in range(50):
            k = key_of(rng.uniform(l, r), rng.uniform(t, b))
            assert any(a <= k <= z for a, z in ranges)
        if most == 64 and 0.5 < (r - l + 64) / (b - t + 64) < 2:
            cells = (int(r // 64) - int(max(l, 0) // 64) + 1) * (int(b // 64) - int(max(t, 0) // 64) + 1)
            assert sum(z - a + 1 for a, z in ranges) <= 3 * cells + 64
    assert layout.key_ranges(5, 4, 0, 1) == []


def read_by_scan(df):
    """Rows that the scan gave after it left out row groups."""
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_viewport_reads_few_row_groups(spark, tmp_path):
    """Of a slide of 200,000 objects a small viewport reads a few row groups; bounds alone, on a dataset by x, read a whole strip."""
    objects = spark.range(200_000).selectExpr(
        "id AS object_id", "concat('S', id % 2) AS slide", "CAST(id * 7919 % 40000 AS DOUBLE) AS x_centroid", "CAST(id * 104729 % 39989 AS DOUBLE) AS y_centroid", "array(CAST(id % 10 AS FLOAT), 1F) AS features"
    )
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    old = spark._jsc.hadoopConfiguration().get("parquet.block.size")
    spark._jsc.hadoopConfiguration().setInt("parquet.block.size", 32 * 1024)
    spark._jsc.hadoopConfiguration().setInt("parquet.page.size.row.check.min", 100)
    try:
        layout.write_dataset(objects, f"{tmp_path}/d")
        objects.repartition(2, "slide").sortWithinPartitions("slide", "x_centroid").write.partitionBy("slide").parquet(f"{tmp_path}/by_x")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        for name in ("parquet.block.size", "parquet.page.size.row.check.min"):
            spark._jsc.hadoopConfiguration().unset(name)
        if old:
            spark._jsc.hadoopConfiguration().set("parquet.block.size", old)
    box = ("S1", 10_000.0, 11_500.0, 20_000.0, 21_500.0)
    found = layout.viewport(spark, f"{tmp_path}/d", *box)
    inside = "slide = 'S1' AND x_centroid BETWEEN 10000 AND 11500 AND y_centroid BETWEEN 20000 AND 21500"
    assert sorted(map(tuple, found.select("object_id", "x_centroid").collect())) == sorted(map(tuple, objects.where(inside).select("object_id", "x_centroid").collect()))
    by_x = spark.read.parquet(f"{tmp_path}/by_x").where(inside)
    n = by_x.select("object_id").collect()
    found = found.select("object_id", "x_centroid")
    found.collect()
    by_x = by_x.select("object_id", "x_centroid")
    by_x.collect()
    read, strip = read_by_scan(found), read_by_scan(by_x)
    assert 0 < len(n) <= read < 4_000 and read < strip / 2, (read, strip)


def test_header(spark, tmp_path):
    objects = fx.objects(spark, SF).select("object_id", "slide", "x_centroid", "y_centroid", F.array("score", "score_tied").alias("features"))
    layout.write_dataset(objects, f"{tmp_path}/d")
    slides = layout.read_slides(spark, f"{tmp_path}/d").orderBy("slide").collect()
    assert [r.slide_index for r in slides] == list(range(len(slides))) and slides[0].first_index == 0
    assert all(a.first_index + a.n_objects == b.first_index for a, b in zip(slides, slides[1:], strict=False))
    assert sum(r.n_objects for r in slides) == objects.count() == layout.read_objects(spark, f"{tmp_path}/d").count()
    want = objects.agg(F.avg(F.col("features")[0]), F.stddev(F.col("features")[0])).first()
    got = layout.read_features(spark, f"{tmp_path}/d").where("dim = 0").first()
    assert (got.mean, got.std_dev) == (pytest.approx(want[0]), pytest.approx(want[1]))
