"""Golden cases of boundary cleaning, and properties of other operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidegrid import fixtures as fx
from slidegrid.functions import boundaries as b
from slidegrid.operators import heatmap, models, pixels, survival

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("f", "points", "want"),
    [
        (b.merged, "0,1 1,1 1,1 1,1 2,1", "0.0,1.0 2.0,1.0"),
        (b.merged, "0,1 1,1 1,1 1,0", "0.0,1.0 1.0,1.0 1.0,0.0"),
        (b.without_spurs, "0,0 2,0 1,0", "0.0,0.0 1.0,0.0"),
        (b.without_spurs, "0,0 1,0 1,1 1,0 2,0", "0.0,0.0 1.0,0.0 1.0,0.0 2.0,0.0"),
        (b.without_spurs, "0,0 1,0 1,1 1,1 1,0 2,0", "0.0,0.0 1.0,0.0 1.0,0.0 2.0,0.0"),
        (b.without_spurs, "0,0 0,0 1,0 1,0", "0.0,0.0 1.0,0.0"),
        (b.without_spurs, "1,1 0,1 1,1 1,0 1,1 2,1 1,1 1,2 1,1", " ".join(["1.0,1.0"] * 5)),
        (lambda p: b.merged(b.without_spurs(p)), "0,0 1,0 1,1 1,0 2,0", "0.0,0.0 2.0,0.0"),
        (b.distinct, "0,0 1,0 1,0 1,1 0,0", "0.0,0.0 1.0,0.0 1.0,1.0 0.0,0.0"),
    ],
)
def test_golden_cases(spark, f, points, want):
    assert spark.range(1).select(b.written(f(b.parsed(F.lit(points))))).first()[0] == want


def test_density_is_all_objects(spark):
    objects = fx.objects(spark, SF)
    assert heatmap.cells(objects).agg(F.sum("density")).first()[0] == objects.count()


def test_blur_keeps_a_constant_map(spark):
    slides = fx.slides(spark, SF).where("name = 'S01'")
    grid = slides.select(F.col("name").alias("slide"), F.explode(F.sequence(F.lit(0), F.lit(50))).alias("cx")).select("*", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("cy"))
    flat = heatmap.blurred(grid.withColumns({"uncertainty": F.lit(1.0), "positive": F.lit(0.5)}), slides)
    low, high = flat.agg(F.min("uncertainty"), F.max("uncertainty")).first()
    assert low == pytest.approx(1) and high == pytest.approx(1)


def test_survival_never_grows(spark):
    for _, g in survival.kaplan_meier(fx.survival(spark, SF)).toPandas().groupby("group"):
        s = g.sort_values("time").survival.to_numpy()
        assert (np.diff(s) <= 1e-12).all() and s.min() >= 0 and s.max() <= 1


def test_cox_finds_a_known_effect(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, 3000)
    time = np.ceil(rng.exponential(1 / (0.1 * np.exp(0.7 * x))) * 2) / 2
    fit = survival.cox(spark.createDataFrame([(float(t), 1, float(v)) for t, v in zip(time, x, strict=True)], "time double, event int, x double"), ["x"])
    assert fit["converged"] and fit["beta"][0] == pytest.approx(0.7, abs=0.12)


def test_renormalizing_to_own_figures_is_identity(spark):
    v = spark.createDataFrame([(i, [float(i), float(i * i)]) for i in range(9)], "object_id bigint, features array<double>")
    own = models.moments(v)
    z = models.normalized(v, own)
    a, c = z.toPandas(), models.renormalized(z, own, own).toPandas()
    assert np.allclose(np.stack(a.sort_values("object_id").features), np.stack(c.sort_values("object_id").features))


def test_solidity_of_a_square_is_one(spark):
    square = spark.range(16).selectExpr("0L AS tile_id", "CAST(id % 4 AS INT) AS x", "CAST(id / 4 AS INT) AS y", "1 AS label")
    assert pixels.solidity(square).first().solidity == 1
