"""Catalog operators on rows that the tables do not have."""

from slidegrid.operators import catalog


def test_names_in_use(spark):
    sets = spark.createDataFrame([(1, "a"), (2, "b")], "set_id bigint, name string")
    new = spark.createDataFrame([(3, "b"), (4, "c"), (5, None)], "set_id bigint, name string")
    assert {tuple(r) for r in catalog.saved(sets, new).collect()} == {(1, "a"), (2, "b"), (4, "c"), (5, None)}


def test_picked_samples(spark):
    """Clicks where they are known, centroids elsewhere; samples of no object are left out, whatever often the object is there."""
    objects = spark.createDataFrame([(1,), (1,), (2,)], "object_id bigint")
    rows = [(1, 1, 5.0, 6.0, 5.5, None), (2, -1, 7.0, 8.0, None, None), (9, 1, 0.0, 0.0, 0.0, 0.0)]
    samples = spark.createDataFrame(rows, "object_id bigint, label int, x_centroid double, y_centroid double, x_click double, y_click double")
    assert {tuple(r) for r in catalog.picked(samples, objects).collect()} == {(1, 1, 5.5, 6.0), (2, -1, 7.0, 8.0)}
    assert {tuple(r) for r in catalog.picked(samples.drop("x_click", "y_click"), objects).collect()} == {(1, 1, 5.0, 6.0), (2, -1, 7.0, 8.0)}


def test_lists_with_repeats(spark):
    """What is listed twice comes once; what is linked twice comes as often."""
    boundaries = spark.createDataFrame([("s", 1, "0,0"), ("s", 2, "1,1")], "slide string, object_id bigint, boundary string")
    wanted = spark.createDataFrame([("s", 1), ("s", 1), ("t", 2)], "slide string, object_id bigint")
    assert [r.boundary for r in catalog.boundaries_of(wanted, boundaries).collect()] == ["0,0"]
    datasets = spark.createDataFrame([(1, "d"), (2, "e")], "dataset_id bigint, name string")
    links = spark.createDataFrame([(1, "s"), (1, "s"), (2, "t"), (1, "gone")], "dataset_id bigint, slide string")
    slides = spark.createDataFrame([("s", 5), ("t", 6)], "name string, x_size int")
    assert [tuple(r) for r in catalog.slides_of("d", datasets, links, slides).collect()] == [("s", 5)] * 2
    samples = spark.createDataFrame([("s", 1, -4), ("s", 1, 3), ("gone", 2, 9), ("s", 7, 9)], "slide string, object_id bigint, iteration int")
    assert [tuple(r) for r in catalog.reloaded(samples, slides, boundaries).collect()] == [("s", 2, 4)]


def test_sessions_that_were_cancelled(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "event_id bigint, uid string")
    assert {r.event_id for r in catalog.without_sessions(rows, rows.where("uid = 'a'")).collect()} == {2, 3}
