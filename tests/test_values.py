"""Values of operators that have no SQL, against brute force and known shapes."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from slidegrid import fixtures as fx
from slidegrid.operators import heatmap, models, pixels, sampling, spatial, survival, svm
from slidegrid.plans import registry
from slidegrid.sources import files, published

SF = "/root/testdata/sf0.001"


def energies_by_brute_force(points, n=128, bands=6):
    """Resampling, turning angles and a Fourier sum in plain loops."""
    way = [0.0]
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        way.append(way[-1] + math.hypot(x1 - x0, y1 - y0))
    line = []
    for k in range(n + 1):
        at = k * way[-1] / n
        j = next((i for i in range(len(way) - 1) if way[i] <= at < way[i + 1]), None)
        (x0, y0), (x1, y1) = (points[j], points[j + 1]) if j is not None else (points[-1], points[-1])
        t = (at - way[j]) / (way[j + 1] - way[j]) if j is not None else 0
        line.append((x0 + (x1 - x0) * t, y0 + (y1 - y0) * t))
    angle = [math.atan2(b[1] - a[1], b[0] - a[0]) for a, b in zip(line, line[1:], strict=False)]
    power = [abs(sum((v - angle[0]) * complex(math.cos(2 * math.pi * f * i / n), -math.sin(2 * math.pi * f * i / n)) for i, v in enumerate(angle))) ** 2 for f in range(n)]
    ends = sorted({round(2 ** (i * math.log2(n / 2) / bands)) for i in range(bands + 1)})
    return [sum(power[a - 1 : b]) / sum(power) for a, b in zip(ends, ends[1:], strict=False)]


def test_fourier_shapes(spark):
    rows = fx.boundaries(spark, SF).orderBy("object_id").limit(5)
    got = {r.object_id: r.energies for r in pixels.fourier_shapes(rows).collect()}
    for r in rows.collect():
        p = [tuple(map(float, v.split(","))) for v in r.boundary.split()]
        assert got[r.object_id] == pytest.approx(energies_by_brute_force([*p, p[0]]), abs=1e-6)


def square(spark, side, at=(10, 10), size=32):
    x0, y0 = at
    inside = f"x >= {x0} AND x < {x0 + side} AND y >= {y0} AND y < {y0 + side}"
    grid = spark.range(size * size).selectExpr("0L AS tile_id", f"CAST(id % {size} AS INT) AS x", f"CAST(id / {size} AS INT) AS y")
    return grid.selectExpr("*", f"CASE WHEN {inside} THEN 1 ELSE 0 END AS label", "CAST((x * 37 + y * 11) % 256 AS INT) AS r", "CAST((x * 5 + y * 3) % 256 AS INT) AS g", "CAST((x + y * 7) % 256 AS INT) AS b")


def test_outline_of_a_square(spark):
    line = pixels.outlines(square(spark, 6)).first().points
    assert len(line) == 21 and line[0] == line[-1] and {(p.x, p.y) for p in line} == {(float(x), float(y)) for x in range(10, 16) for y in range(10, 16) if x in (10, 15) or y in (10, 15)}
    one = pixels.outlines(square(spark, 1)).first().points
    assert [(p.x, p.y) for p in one] == [(10.0, 10.0)]


def test_object_vectors_have_all_names(spark):
    row = pixels.vectors(square(spark, 6)).first()
    values = dict(zip(pixels.NAMES, row.features, strict=True))
    assert len(pixels.NAMES) == len(row.features) == 48
    assert (values["Area"], values["Perimeter"], values["Extent"], values["Solidity"]) == (36, 20, 1, 1)
    assert values["Eccentricity"] == pytest.approx(0, abs=1e-6) and values["Circularity"] == pytest.approx(4 * math.pi * 36 / 400)
    assert all(v is not None for v in row.features)


def test_ring_is_the_dilation(spark):
    got = {(r.x, r.y) for r in pixels.rings(square(spark, 4)).collect()}
    inside = {(x, y) for x in range(10, 14) for y in range(10, 14)}
    want = {(x, y) for x in range(32) for y in range(32) if (x, y) not in inside and any((x - a) ** 2 + (y - b) ** 2 <= 64 for a, b in inside)}
    assert got == want


def test_fourier_shapes_leave_no_points_to_expressions(spark):
    """Energies of long, flat, empty and missing boundaries; what goes to numpy are the boundary's own points."""
    circle = " ".join(f"{20 * math.cos(k / 9):.3f},{20 * math.sin(k / 9):.3f}" for k in range(50))
    rows = spark.createDataFrame([(1, circle), (2, "3,3 3,3"), (3, ""), (4, None), (5, "0,0 10,0 x 10,5")], "object_id bigint, boundary string")
    found = pixels.fourier_shapes(rows)
    got = {r.object_id: r.energies for r in found.collect()}
    p = [tuple(map(float, v.split(","))) for v in circle.split()]
    assert got[1] == pytest.approx(energies_by_brute_force([*p, p[0]]), abs=1e-6)
    assert got[5] == pytest.approx(energies_by_brute_force([(0, 0), (10, 0), (10, 5), (0, 0)]), abs=1e-6)
    assert got[2] == got[3] == [0.0] * 6 and got[4] is None
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "sequence(" not in plan and "MapInArrow" in plan


PIXEL_QUERIES = ("f27_cytoplasm_values", "f27_object_vectors", "a16_texture_group", "a17_gradient_group", "a17_edge_group", "f15_rings", "f27_nuclear_values", "f13_colour_transfer")


@pytest.mark.parametrize("name", PIXEL_QUERIES)
def test_pixels_are_not_broadcast(spark, name):
    """The source of the pixels is small, but what they grow to is not: no side of a join is broadcast, and tiles are dealt before they grow."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "REPARTITION_BY_NUM" in plan
    if name in ("f27_cytoplasm_values", "f27_nuclear_values", "a17_edge_group", "f15_rings", "f13_colour_transfer"):
        assert "ENSURE_REQUIREMENTS" not in plan


def test_transfer_keeps_pixels_that_it_cannot_move(spark):
    """Pixels without a place, a colour or a tile, and tiles whose tissue has no deviation, stay as they are; no row is lost."""
    rows = [(1, 0, 0, 200, 40, 200), (1, 1, 0, 180, 60, 190), (1, 2, 0, 0, 0, 0), (1, None, 0, 190, 50, 210), (1, 3, 0, None, 5, 5), (2, 0, 0, 200, 40, 200), (None, 0, 0, 200, 40, 200), (None, 1, 0, 180, 60, 190)]
    image = spark.createDataFrame(rows, "tile_id bigint, x int, y int, r int, g int, b int")
    target = {"l": (3.2, 0.3), "a": (0.02, 0.05), "b": (0.03, 0.04)}
    found = pixels.transferred(image, target)
    got = {tuple(r[:3]): tuple(r[3:]) for r in found.collect()}
    assert len(got) == len(rows) and all(got[r[:3]] == r[3:] for r in rows[2:3] + rows[4:]) and all(got[r[:3]] != r[3:] for r in (*rows[:2], rows[3]))
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_values_of_tiles_against_columns(spark):
    """Arrays of a tile give what windows and aggregates give, for pixels that are missing, doubled or without a value too."""
    image = square(spark, 5, size=16, at=(4, 6)).selectExpr("tile_id", "x", "y", "CASE WHEN x > 12 THEN 3 WHEN x = 11 AND y = 3 THEN NULL ELSE label END AS label", "CASE WHEN (x + y) % 7 <> 0 THEN CAST(r AS DOUBLE) / 3 END AS v").where("x <> 8 OR y > 4")
    image = image.unionAll(image.where("x = 2 AND y = 2"))
    slope = pixels.gradient(image, "v")
    for ring in (None, 3):
        part = [image, slope]
        if ring:
            part = [pixels.rings(image, ring).join(df.drop("label"), ["tile_id", "x", "y"]) for df in part]
        i, t = pixels.intensities(part[0], "v").toPandas(), pixels.textures(part[0], "v").toPandas()
        j, u = pixels.intensities(part[1], "magnitude").toPandas(), pixels.textures(part[1], "magnitude").toPandas()
        got = {r.label: r["values"] for r in pixels.tile_values(image, "v", ring).collect()}
        texture = ["entropy", "energy", "skewness", "kurtosis"]
        want = i.merge(t, on="label").merge(j, on="label", suffixes=("", "_g")).merge(u, on="label", suffixes=("", "_g"))
        assert sorted(got) == sorted(want.label) == [1, 3]
        for r in want.to_dict("records"):
            assert got[r["label"]] == pytest.approx([r[c] for c in ("mean", "mean_median", "max", "min", "std", *texture, "mean_g", "std_g", *(f"{c}_g" for c in texture))], abs=1e-9)


def test_nearest_ties_are_of_rounded_distances(spark):
    """Two objects of one distance, whose squares differ in the last place: the smaller id wins, with and without a first box."""
    clicks = spark.createDataFrame([(1, "S", 0.0, 0.0), (2, "S", 100.0, 100.0), (3, "S", 300.0, 300.0)], "click_id bigint, slide string, x double, y double")
    rows = [(5, "S", 0.7, 0.1), (9, "S", 0.5, 0.5), (6, "S", 100.0, 120.0), (7, "S", 109.0, 109.0), (8, "S", 118.0, 118.0)]
    assert 0.7 * 0.7 + 0.1 * 0.1 != 0.5 * 0.5 + 0.5 * 0.5 == 0.5
    for near, far in (((5, 0.7, 0.1), (9, 0.5, 0.5)), ((5, 0.5, 0.5), (9, 0.7, 0.1))):
        objects = spark.createDataFrame([(i, "S", x, y) for i, x, y in (near, far)] + rows[2:], "object_id bigint, slide string, x_centroid double, y_centroid double")
        for first in (None, 10.0, 0.5):
            got = {r.click_id: (r.object_id, r.distance2) for r in spatial.nearest(clicks, objects, 64.0, first).collect()}
            assert got == {1: (5, 0.5), 2: (7, 162.0)}


def test_mask_has_polygons_from_outside_the_view(spark):
    rows = [(1, 0.0, 0.0, 9.0, 9.0, 5, 0.5, "-6,2 4,2 4,7 -6,7"), (1, 0.0, 0.0, 9.0, 9.0, 6, -0.25, "2,4 30,4 30,20 2,20")]
    polygons = spark.createDataFrame(rows, "view_id int, l double, t double, r double, b double, object_id bigint, score double, boundary string")
    got = {(r.x, r.y): r.score for r in pixels.score_mask(polygons).collect()}
    want = {(x, y): -0.25 if 2 <= x and 4 <= y else 0.5 if x < 4 and 2 <= y < 7 else 7.0 for x in range(10) for y in range(10)}
    assert got == want


@pytest.fixture(scope="module")
def apart(spark):
    """Two clouds in four dimensions, labelled by a hidden circle that no line parts."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 4))
    label = np.where((v[:, :2] ** 2).sum(1) < 1.4, 1, -1)
    return spark.createDataFrame(pd.DataFrame({"object_id": np.arange(600), "features": v.tolist(), "label": label}))


def test_forest_scores(spark, apart):
    model = models.forest(apart.where("object_id % 2 = 0"), 4)
    got = models.scored(model, apart.where("object_id % 2 = 1"), ["object_id", "label"]).toPandas()
    assert model.getNumTrees == 100 and max(t.depth for t in model.trees) <= 10
    assert (got.predicted == got.label).mean() > 0.85 and got.score.between(-1, 1).all()
    assert ((got.score < 0) == (got.predicted == -1)).all()


def test_waves_are_nearly_the_radial_kernel(spark, apart):
    few = apart.limit(60)
    z = np.stack([np.array(r.z) for r in few.select(models.waves(F.col("features"), 4, 512).alias("z")).collect()])
    v = np.stack([np.array(r.features) for r in few.select("features").collect()])
    exact = np.exp(-((v[:, None] - v[None]) ** 2).sum(2) / 4)
    assert abs(z @ z.T - exact).mean() < 0.05


def test_svm_margins(spark, apart):
    model, n = models.svm(apart.where("object_id % 2 = 0"), 4)
    got = models.margins(model, n, apart.where("object_id % 2 = 1"), 4, ["object_id", "label"]).toPandas()
    assert (got.predicted == got.label).mean() > 0.8 and ((got.score < 0) == (got.predicted == -1)).all()


def test_active_round_takes_the_most_uncertain_of_the_rest(spark, apart):
    samples = apart.where("object_id < 100")
    got = models.active_round(apart, samples, 4, n=8).toPandas()
    model = models.forest(samples, 4, 1)
    rest = models.scored(model, apart.where("object_id >= 100"), ["object_id"]).toPandas()
    want = rest.assign(u=rest.score.abs()).sort_values(["u", "object_id"]).head(8)
    assert sorted(got.object_id) == sorted(want.object_id)


def test_samplers_by_name(spark):
    scored = spark.range(1000).selectExpr("id AS object_id", "(id * 37 % 1000 - 500) / 500D AS score")
    for f in models.SAMPLERS.values():
        rows = f(scored, 8, 3).collect()
        assert len({r.object_id for r in rows}) == len(rows) == 8
    assert {r.score_bin for r in sampling.one_of_each_bin(scored, 3).collect()} == set(range(8))


def test_folds_are_even(spark):
    """Sizes differ by one at most, with ranges of few and of many objects."""
    ids = spark.range(5003).selectExpr("id * 7 AS object_id")
    n = models.folds(ids).groupBy("fold").count().toPandas()
    assert len(n) == 5 and n["count"].max() - n["count"].min() <= 1
    ranks = [sampling.ranked_at_random(ids, 4, deal).orderBy("object_id").toPandas()["rank"].tolist() for deal in (10_000, 3)]
    assert ranks[0] == ranks[1] and sorted(ranks[0]) == list(range(5003))


def test_random_orders_of_other_seeds_are_independent(spark):
    """Ids that are chosen together by one seed are not by another, neighbours and ids a fixed step apart neither."""
    ids = spark.range(4000).selectExpr("id * 1000003 AS object_id").union(spark.range(4000).selectExpr("id AS object_id"))
    chosen = [{r.object_id for r in sampling.random_objects(ids, 800, seed).collect()} for seed in range(4)]
    assert all(len(c) >= 799 for c in chosen)
    shared = [len(a & b) for i, a in enumerate(chosen) for b in chosen[:i]]
    assert all(40 < n < 125 for n in shared)
    ranks = [dict(sampling.ranked_at_random(ids.distinct(), s).collect()) for s in (1, 2)]
    pairs = [(i, i + 1) for i in range(0, 3999)]
    gaps = [[abs(r[a] - r[b]) for a, b in pairs] for r in ranks]
    assert abs(np.corrcoef(gaps[0], gaps[1])[0, 1]) < 0.1
    near = [sum(g < 80 for g in gap) for gap in gaps]
    assert all(n < 200 for n in near)
    share = ids.where(sampling.shuffled(9) < sampling.share_end(10)).count()
    assert 650 < share < 950 and ids.where(sampling.shuffled(9) < sampling.share_end(100)).count() == 8000


def test_vote_shares(spark, apart, tmp_path):
    """Against each tree's own prediction, and against SQL over the exported leaf table."""
    place = models.stored(spark, str(tmp_path), "circle", 1, lambda: models.forest(apart.where("object_id % 2 = 0"), 4, trees=15, depth=5))
    objects = apart.where("object_id % 2 = 1")
    got = {r.object_id: (r.score, r.predicted) for r in models.voted(spark, place, objects, ["object_id"]).collect()}
    model = RandomForestClassificationModel.load(place)
    for r in objects.collect():
        votes = [t.predict(Vectors.dense(r.features)) for t in model.trees]
        score = 2 * sum(votes) / 15 - 1
        assert got[r.object_id] == (pytest.approx(score), -1 if score < 0 else 1)
    table = models.leaf_votes(spark, place).toPandas()  # noqa: F841
    assert table.groupby("tree").size().tolist() == [t.numNodes // 2 + 1 for t in model.trees]
    rows = model.setLeafCol("leaves").transform(models.prepared(objects)).select("object_id", vector_to_array("leaves").alias("leaves")).toPandas()
    each = rows.explode("leaves").assign(tree=lambda x: x.groupby("object_id").cumcount())  # noqa: F841
    want = duckdb.sql("SELECT object_id, 2 * sum(vote) / count(*) - 1 AS score FROM each JOIN \"table\" t ON each.tree = t.tree AND each.leaves = t.leaf GROUP BY 1").fetchall()
    assert {i: pytest.approx(s) for i, s in want} == {i: s for i, (s, _) in got.items()}


def test_classifiers_are_trained_once(spark, apart, tmp_path):
    """Each training set and iteration has its own; what a lost writer left is not read."""
    made = []

    def make(k):
        made.append(k)
        return models.forest(apart, 4, trees=3 + k, depth=3)

    root = str(tmp_path)
    first = models.stored(spark, root, "a", 1, lambda: make(1))
    assert models.stored(spark, root, "a", 1, lambda: make(1)) == first and made == [1]
    assert models.stored(spark, root, "a", 2, lambda: make(2)) != first
    assert models.stored(spark, root, "b", 1, lambda: make(3)) != first and made == [1, 2, 3]
    with pytest.raises(ZeroDivisionError):
        models.stored(spark, root, "c", 1, lambda: 1 / 0)
    place = models.stored(spark, root, "c", 1, lambda: make(4))
    assert RandomForestClassificationModel.load(place).getNumTrees == 7


def test_writers_that_race(spark, tmp_path):
    """The result that was published first is everyone's."""
    root = str(tmp_path)

    def slow(place):
        published.kept(spark, root, "k", lambda other: spark.range(1).write.parquet(other))
        spark.range(2).write.parquet(place)

    place = published.kept(spark, root, "k", slow)
    assert spark.read.parquet(place).count() == 1 and published.place_of(spark, root, "k") == place and published.place_of(spark, root, "other") is None


def test_viewport_of_a_stored_classifier(spark, apart, tmp_path):
    """Bounds reach the scan, and only what is in the viewport is scored."""
    objects = apart.selectExpr("*", "concat('S', object_id % 3) AS slide", "CAST(object_id AS DOUBLE) AS x_centroid", "CAST(object_id % 50 AS DOUBLE) AS y_centroid")
    objects.write.partitionBy("slide").parquet(f"{tmp_path}/objects")
    stored_objects = spark.read.parquet(f"{tmp_path}/objects")
    place = models.stored(spark, f"{tmp_path}/m", "circle", 1, lambda: models.forest(apart, 4, trees=5, depth=4))
    found = models.applied(place, stored_objects, "S1", 100, 300, 10, 30, ["object_id"])
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(x_centroid,100.0)" in plan and "LessThanOrEqual(y_centroid,30.0)" in plan and "PartitionFilters: [isnotnull(slide" in plan
    want = {r.object_id: r.score for r in models.scored(RandomForestClassificationModel.load(place), apart, ["object_id"]).collect() if r.object_id % 3 == 1 and 100 <= r.object_id <= 300 and 10 <= r.object_id % 50 <= 30}
    assert {r.object_id: r.score for r in found.collect()} == want


def test_active_rounds(spark, apart):
    """Five rounds choose forty different objects, learn from the answers, and plans do not grow."""
    hidden = apart.select("object_id", "label")
    samples = apart.where("object_id < 40")
    plans = []

    def answers(batch, k):
        plans.append(len(batch._jdf.queryExecution().toString()))
        given = hidden.join(batch.select("object_id"), "object_id")
        wrong = given.limit(1).selectExpr("-5L AS object_id", "1 AS label").union(given.limit(1).selectExpr("object_id", "7 AS label"))
        return given.where("object_id % 10 <> 3").union(wrong).union(hidden.where("object_id = 0"))

    chosen, known = models.active_rounds(apart, samples, answers, 4, trees=10)
    chosen, known = chosen.toPandas(), known.toPandas()
    assert chosen.groupby("iteration").size().tolist() == [8] * 5
    assert chosen.object_id.is_unique and (chosen.object_id >= 40).all()
    want = {i for i in chosen.object_id if i % 10 != 3}
    assert set(known[known.iteration > 0].object_id) == want and known.object_id.is_unique and (known.iteration == 0).sum() == 40
    assert max(plans) - min(plans) < 0.2 * max(plans)


def test_radial_machine_is_optimal(spark, apart):
    """The conditions of Karush, Kuhn and Tucker on the training set, and margins near those of a dense dual solution."""
    train = apart.where("object_id < 250")
    machine = svm.fitted(train, 4)
    rows = train.toPandas()
    x, y = np.stack(rows.features.to_numpy()), rows.label.to_numpy(float)
    k = svm.kernel(x, x, 0.25)
    alpha, offset = svm.solved(x, y, 1.0, 0.25, 1e-3)
    f = k @ (alpha * y) + offset
    assert abs(alpha @ y) < 1e-9 and alpha.min() >= 0 and alpha.max() <= 1
    assert (y * f)[alpha == 0].min() > 1 - 2e-3 and (y * f)[alpha == 1].max() < 1 + 2e-3
    assert abs((y * f)[(alpha > 0) & (alpha < 1)] - 1).max() < 2e-3
    assert machine.margins(x) == pytest.approx(f, abs=5e-3)
    # projected gradient on the whole dual, with the sum of y * alpha held at zero by bisection
    q, a = k * np.outer(y, y), np.zeros(250)
    rate = 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(4000):
        raw = a - rate * (q @ a - 1)
        low, high = -50.0, 50.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if np.clip(raw - mid * y, 0, 1) @ y > 0 else (low, mid)
        a = np.clip(raw - mid * y, 0, 1)
    value = lambda v: v @ q @ v / 2 - v.sum()
    assert value(alpha) <= value(a) + 1e-3 * abs(value(a))
    free = (a > 1e-3) & (a < 1 - 1e-3)
    dense = k @ (a * y)
    assert dense + (y - dense)[free].mean() == pytest.approx(f, abs=0.05)


def test_radial_machine_of_more_samples_than_one_task_takes(spark, apart, monkeypatch):
    """Rounds over many tasks, and support vectors in parts, give the margins of the machine of one task; one class gives its sign."""
    train = apart.where("object_id < 400")
    want = svm.fitted(train, 4).margins(np.stack(apart.toPandas().features.to_numpy()))
    monkeypatch.setattr(svm, "MOST", 50)
    monkeypatch.setattr(svm, "WORKING", 40)
    machine = svm.fitted(train, 4)
    assert len(list(machine.parts())) > 1 and max(len(m.weights) for m in machine.parts()) <= 50
    got = svm.margins(machine, apart.selectExpr("object_id", "CASE WHEN object_id <> 7 THEN features END AS features"), ["object_id"]).toPandas().sort_values("object_id")
    assert np.isnan(got.score.to_numpy(float)[7]) and np.delete(got.score.to_numpy(float), 7) == pytest.approx(np.delete(want, 7), abs=5e-3)
    one = svm.margins(svm.fitted(apart.where("label = 1"), 4), apart.limit(5), ["object_id"]).toPandas()
    assert (one.score > 0).all()


def test_radial_machine_margins(spark, apart):
    got = svm.margins(svm.fitted(apart.where("object_id % 2 = 0"), 4), apart.where("object_id % 2 = 1"), ["object_id", "label"]).toPandas()
    assert (got.predicted == got.label).mean() > 0.9 and ((got.score < 0) == (got.predicted == -1)).all()
    one = svm.margins(svm.fitted(apart.where("label = 1"), 4), apart.limit(5), ["object_id"]).toPandas()
    assert (one.score > 0).all()
    odd = apart.limit(3).selectExpr("object_id", "CASE WHEN object_id = 1 THEN features END AS features", "label")
    rows = {r.object_id: r for r in svm.margins(svm.fitted(apart.where("false"), 4), odd, ["object_id"]).collect()}
    assert rows[1].score == 0 and rows[1].predicted == 1 and rows[0].score is None and rows[0].predicted is None


def test_cox_models_of_each_covariate_at_once(spark):
    """Equal to one model after another, in a number of jobs that does not grow with the covariates."""
    rows = fx.survival(spark, SF).selectExpr("time", "event", "price / 100000 AS price", "odd", "CAST(subject % 7 AS DOUBLE) AS week", "0 AS same", "subject % 3 AS third").persist()
    names = ["price", "odd", "week", "third"]
    tracker, group = spark.sparkContext.statusTracker(), spark.sparkContext.setJobGroup
    group("many", "many")
    each = survival.cox_each(rows, [*names, "same"])
    many = len(tracker.getJobIdsForGroup("many"))
    group("one", "one")
    survival.cox_each(rows, ["price"])
    one = len(tracker.getJobIdsForGroup("one"))
    group("rest", "rest")
    for c in names:
        want = survival.cox(rows, [c])
        assert each[c]["beta"] == pytest.approx(want["beta"][0], abs=1e-6) and each[c]["se"] == pytest.approx(want["se"][0], rel=1e-6) and each[c]["converged"] == want["converged"]
    assert each["same"]["beta"] == 0 and math.isnan(each["same"]["se"]) and not each["same"]["converged"]
    assert many <= 2.5 * one


def test_blur_against_plain_sums(spark):
    """Slides of several blocks, narrower than the kernel, of one cell, and without cells; cells outside of a slide don't count."""
    slides = spark.createDataFrame([("wide", 6000, 800), ("thin", 100, 3500), ("dot", 0, 0), ("none", 400, 400)], "name string, x_size int, y_size int")
    rng = np.random.default_rng(3)
    rows = [(s, int(x), int(y), float(u), float(p)) for s, nx, ny in (("wide", 151, 21), ("thin", 4, 89), ("dot", 1, 1)) for x, y, u, p in zip(rng.integers(-2, nx + 2, 300), rng.integers(-2, ny + 2, 300), rng.random(300), rng.random(300), strict=True)]
    rows = list({r[:3]: r for r in rows}.values())
    got = {(r.slide, r.cx, r.cy): (r.uncertainty, r.positive) for r in heatmap.blurred(spark.createDataFrame(rows, "slide string, cx int, cy int, uncertainty double, positive double"), slides).collect()}
    w = heatmap.kernel()

    def mirrored(i, n):
        while n > 1 and not 0 <= i < n:
            i = -i if i < 0 else 2 * (n - 1) - i
        return i if n > 1 else 0

    n_cells = 0
    for name, nx, ny in (("wide", 151, 21), ("thin", 4, 89), ("dot", 1, 1), ("none", 11, 11)):
        grid = np.zeros((2, nx, ny))
        for s, x, y, u, p in rows:
            if s == name and 0 <= x < nx and 0 <= y < ny:
                grid[:, x, y] = u, p
        for axis, n in ((1, nx), (2, ny)):
            grid = sum(w[k] * np.take(grid, [mirrored(i + k - 19, n) for i in range(n)], axis) for k in range(39))
        n_cells += nx * ny
        for x in range(nx):
            for y in range(ny):
                assert got[name, x, y] == pytest.approx(tuple(grid[:, x, y]), abs=1e-12)
    assert len(got) == n_cells


def plain_canny(image):
    """Edges pixel by pixel, and a search from each strong crest."""
    h, w = image.shape
    taps = [math.exp(-k * k / 4) for k in range(-8, 9)]
    taps = [t / sum(taps) for t in taps]
    slopes = [k * t for k, t in zip(range(-8, 9), taps, strict=True)]
    slopes = [v / sum(x for x in slopes if x > 0) for v in slopes]
    inside = lambda i, n: min(max(i, 0), n - 1)
    along = lambda im, t, y, x: sum(t[k + 8] * im[y][inside(x + k, w)] for k in range(-8, 9))
    across = lambda im, t, y, x: sum(t[k + 8] * im[inside(y + k, h)][x] for k in range(-8, 9))
    every = lambda f, im, t: [[f(im, t, y, x) for x in range(w)] for y in range(h)]
    gx, gy = every(along, every(across, image, taps), slopes), every(across, every(along, image, taps), slopes)
    size = {(y, x): math.hypot(gx[y][x], gy[y][x]) for y in range(h) for x in range(w)}
    most = max(size.values())
    size = {k: round(v / most, 9) for k, v in size.items()}
    bins = [0] * 64
    for v in size.values():
        bins[min(int(v * 63 + 0.5), 63)] += 1
    total, strong = 0, None
    for i, n in enumerate(bins):
        total += n
        if total > 0.7 * h * w:
            strong = (i + 1) / 64
            break

    def crest(y, x):
        dy, dx = gy[y][x], gx[y][x]
        a, b = abs(dy), abs(dx)
        part = min(a, b) / max(a, b) if max(a, b) > 0 else 0
        sign = lambda v: int(v > 0) - int(v < 0)
        both = []
        for s in (-1, 1):
            sy, sx = s * sign(dy), s * sign(dx)
            straight = (y + sy, x) if a > b else (y, x + sx)
            both.append(round((1 - part) * size.get(straight, 0) + part * size.get((y + sy, x + sx), 0), 9))
        return size[y, x] >= max(both) and size[y, x] > min(both)

    crests = {k for k in size if crest(*k)}
    weak = {k for k in crests if size[k] > 0.4 * strong}
    todo = [k for k in crests if size[k] > strong]
    found = set(todo)
    while todo:
        y, x = todo.pop()
        for k in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            if k in weak and k not in found:
                found.add(k)
                todo.append(k)
    return found


def test_edges_against_plain_loops(spark):
    rng = np.random.default_rng(8)
    images = [rng.integers(0, 256, (20, 26)).astype(float), np.add.outer(np.arange(24) ** 2 % 97, np.arange(18) * 3).astype(float)]
    y, x = np.indices((30, 30))
    images += [200.0 * ((y - 15) ** 2 + (x - 14) ** 2 < 70), 50.0 * (x > 12)]
    for image in images:
        got = pixels.canny(image)
        assert set(zip(*(v.tolist() for v in np.nonzero(got)), strict=True)) == plain_canny(image)
    disk = pixels.canny(images[2])
    assert 40 <= disk.sum() <= 80 and not disk[15, 14] and not disk[0].any()
    assert pixels.canny(images[3])[10:20].sum(1).tolist() in ([1] * 10, [2] * 10)
    assert not pixels.canny(np.full((9, 9), 7.0)).any()


def test_edge_values(spark):
    image = square(spark, 12, (10, 9))
    stains = pixels.stain_channels(image)
    found = pixels.edges(stains, "hematoxylin")
    marks = {(r.x, r.y) for r in found.collect()}
    row = pixels.edge_values(stains, found).first()
    inside = sum(10 <= x < 22 and 9 <= y < 21 for x, y in marks)
    assert row["values"] == [inside, inside / 144] and inside > 0


def test_provenance(spark):
    """Who saved it, with what, and when."""
    row = files.provenance(spark, "1.2").first()
    made = pd.Timestamp(row.created)
    assert (row.application, row.version) == (spark.sparkContext.applicationId, "1.2")
    assert abs((made - pd.Timestamp.now("UTC").tz_localize(None)).total_seconds()) < 120


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_survival_of_continuous_times(spark, few):
    """Tables over ranges of times against plain loops: ties, a group without a name, one that dies out, one of one subject."""
    rng = np.random.default_rng(12)
    rows = [(g, float(t), int(e)) for g, n in (("a", 900), (None, 500), ("b", 40)) for t, e in zip(rng.exponential(10, n).round(2 if g == "a" else 6), rng.integers(0, 2, n), strict=True)]
    rows += [("b", 1000.0, 1)] * 3 + [("c", 5.0, 0)]
    got = {(r.group, r.time): r for r in survival.kaplan_meier(spark.createDataFrame(rows, "group string, time double, event int"), few).collect()}
    assert len(survival.time_cuts(spark.createDataFrame(rows, "group string, time double, event int"))) > 20
    seen = 0
    for g in ("a", None, "b", "c"):
        mine = [(t, e) for h, t, e in rows if h == g]
        now, green = 1.0, 0.0
        for t in sorted({t for t, _ in mine}):
            r, seen = got[g, t], seen + 1
            risk, dead = sum(u >= t for u, _ in mine), sum(e for u, e in mine if u == t)
            assert (r.at_risk, r.events, r.censored) == (risk, dead, sum(u == t for u, _ in mine) - dead)
            assert r.before == pytest.approx(now, abs=1e-9)
            now *= 1 - dead / risk
            green += dead / (risk * (risk - dead)) if risk > dead else 0
            assert r.survival == pytest.approx(now, abs=1e-9)
            assert r.se is None if now == 0 else r.se == pytest.approx(now * green**0.5, abs=1e-9)
    assert seen == len(got)
