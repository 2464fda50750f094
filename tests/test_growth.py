"""Steps that must not grow faster than their input, against plain ways to the same result."""

import random
from math import acos, hypot

import numpy as np
import pandas as pd
import pytest

from thalweg.operators import directions


def _network(links, nodes, seed):
    r, rows = random.Random(seed), []
    for k in range(links):
        u, v = r.randrange(nodes), r.randrange(nodes)
        us = r.choice((u, v)) if r.random() < 0.2 else None
        rows.append((k, u, v, float(r.randrange(9)), float(r.randrange(-3, 4)), float(r.randrange(-3, 4)), us, 0.0 if us is not None else None))
    return pd.DataFrame(rows, columns=["link_id", "u", "v", "len", "dx", "dy", "us", "alg"])


@pytest.mark.parametrize("seed", range(6))
def test_turns_are_the_least_of_all(seed):
    frame = _network(120, 15, seed)
    net = directions.Net(frame)
    for k in range(60, 120):  # what is taken away again leaves no trace
        if k in net.us:
            net.unset(k)
    flow = {k: (net.us[k], net.other(k, net.us[k]), net.vector(k, net.us[k])) for k in net.us}
    for k in range(120):
        if k in net.us:
            continue
        for us in (net.u[k], net.v[k]):
            (x, y), ds = net.vector(k, us), net.other(k, us)
            near = [v for a, b, v in flow.values() if b == us or (a == ds and b != ds)]
            want = [acos(max(-1, min(1, (x * a + y * b) / (hypot(x, y) * hypot(a, b))))) for a, b in near if hypot(x, y) * hypot(a, b) > 0]
            got = net.turn(k, us)
            assert (got is None) == (not want) and (got is None or got == pytest.approx(min(want), abs=1e-7))


def test_angles_of_a_hub_take_little_work():
    """A link at a node of many links looks at its neighbours by angle, not at all of them."""
    looked = 0

    class Counted(list):
        def __getitem__(self, k):
            nonlocal looked
            looked += 1
            return list.__getitem__(self, k)

    n = 3000
    turned = np.linspace(0, 6.28, n)
    frame = pd.DataFrame({"link_id": range(n), "u": 0, "v": range(1, n + 1), "len": 1.0, "dx": np.cos(turned), "dy": np.sin(turned), "us": [None if k % 2 else k + 1 for k in range(n)], "alg": [None if k % 2 else 0.0 for k in range(n)]})
    net = directions.Net(frame)
    for side in (*net.entering.values(), *net.leaving.values()):
        side.vectors = Counted(side.vectors)
    net.set_by_angles(0.1, 0.0)
    assert len(net.us) == n and looked < 20 * n


@pytest.mark.parametrize("connectivity", [1, 2])
def test_components_over_tiles(spark, connectivity):
    """Components that wind through many tiles, against a flood fill; with one tile no round is run."""
    from thalweg.operators import regions

    r = random.Random(connectivity)
    on = {(i, y, x) for i in range(3) for y in range(23) for x in range(31) if r.random() < (0.62 if connectivity == 1 else 0.42) or (i == 2 and y % 2 == 0)}
    on |= {(2, y, 30 if y % 4 == 1 else 0) for y in range(1, 22, 2)}  # a snake
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (connectivity == 2 or not a * b)]
    want = {}
    for p in sorted(on):
        if p not in want:
            todo, want[p] = [p], p[1] * 31 + p[2]
            while todo:
                i, y, x = todo.pop()
                for a, b in near:
                    if (q := (i, y + a, x + b)) in on and q not in want:
                        want[q] = want[p]
                        todo.append(q)
    pixels = spark.createDataFrame(sorted(on), "image_id long, r int, c int")
    images = spark.createDataFrame([(i, 23, 31) for i in range(3)], "image_id long, nrows int, ncols int")
    for tile in (5, 16, 512):
        got = regions.label(pixels, images, connectivity, tile).collect()
        assert {(x.image_id, x.r, x.c): x.label for x in got} == want and len(got) == len(want)


def test_components_take_few_jobs(spark, tmp_path):
    from thalweg.operators import regions

    line = spark.range(400).selectExpr("0L AS image_id", "cast(id AS int) AS r", "0 AS c")
    images = spark.createDataFrame([(0, 400, 3)], "image_id long, nrows int, ncols int")
    spark.sparkContext.setJobGroup("label", "")
    assert regions.label(line, images).where("label <> 0").count() == 0
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("label")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 12


def test_distances_spread_by_cells(spark):
    """Tasks are as many as cells need, however few bytes the cells take."""
    from thalweg.operators import regions

    images = spark.range(8).selectExpr("id AS image_id", "1000 AS nrows", "1000 AS ncols")
    df = regions.spread(spark.range(10).withColumnRenamed("id", "image_id"), images, "image_id")
    assert df.rdd.getNumPartitions() == 8_000_000 // regions.PART + 1


def test_weights_are_made_once():
    from thalweg.operators import series

    series.savgol_weights.cache_clear()
    for _ in range(5):
        series.savgol(np.arange(30.0), 7, 3)
    assert series.savgol_weights.cache_info().misses == 1


def _small_file_of_cells(spark, path, n=200_000):
    """Cells that take hardly any room in a file, as a table by itself of which Spark knows only that."""
    spark.range(n).selectExpr("id div 40000 AS image_id", "cast(id div 200 % 200 AS int) AS r", "cast(id % 200 AS int) AS c").write.parquet(path)
    return spark.read.parquet(path), spark.createDataFrame([(i, 200, 200) for i in range(n // 40000)], "image_id long, nrows int, ncols int")


@pytest.mark.parametrize("name", ["remove_blobs", "largest_blobs", "values_of", "perimeter_pixels", "fill_holes", "surrounding"])
def test_cells_are_not_sent_to_the_driver(spark, tmp_path, name):
    """However small its file, no table of cells or of components is a broadcast."""
    from pyspark.sql import functions as F

    from thalweg.operators import regions

    every, images = _small_file_of_cells(spark, str(tmp_path / "cells"))
    on = every.where("r % 5 <> 2 OR c % 4 <> 3")
    if name in ("fill_holes", "surrounding"):
        holes = regions.holes(on, images)
        df = regions.fill_holes(on, images, 4) if name == "fill_holes" else regions.surrounding(on, regions.stored(holes), images, on.withColumn("link_id", F.col("r")))
    else:
        labels = regions.stored(regions.label(on, images, 1))
        more = {"remove_blobs": [4], "largest_blobs": [2], "values_of": [every.withColumn("v", F.lit(1.0))], "perimeter_pixels": []}[name]
        df = getattr(regions, name)(labels, *more)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert df.count() and plan.count("BroadcastHashJoin") == (name == "surrounding")  # that is of the images' sizes


def _broadcast_rows(spark, work):
    """Rows of each broadcast of all queries that work runs, those of its steps too."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    ids = lambda: {e.executionId() for every in [store.executionsList()] for e in map(every.apply, range(every.size()))}
    before = ids()
    work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    rows = []
    for i in ids() - before:
        nodes, values = store.planGraph(i).allNodes(), store.executionMetrics(i)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if node.name().startswith("BroadcastExchange") and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    rows.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return rows


@pytest.mark.parametrize("name", ["moments", "areas"])
def test_only_images_are_sent_with_components(spark, tmp_path, name):
    """From cells in a small file to their blobs no broadcast has more than a row for each image."""
    from thalweg.operators import regions

    every, images = _small_file_of_cells(spark, str(tmp_path / "cells"))
    on = every.where("r % 5 <> 2 OR c % 4 <> 3")
    rows = _broadcast_rows(spark, lambda: getattr(regions, name)(regions.label(on, images, 1)).write.format("noop").mode("overwrite").save())
    assert rows and max(rows) <= images.count()


def test_many_networks_take_few_calls(spark):
    """Networks of a few links go through Python together: each has its own rows, over the limits of batches, and no frame of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(300).selectExpr("id div 5 AS net_id", "id % 5 AS link_id", "id AS u", "id + 1 AS v").unionByName(spark.range(40).selectExpr("1000L AS net_id", "id AS link_id", "id AS u", "id AS v"))
        calls = directions._together(df, ["net_id"], lambda own: [(own["net_id"][0], len(own["u"]), sum(own["u"]))], "net_id long, n long, s long").collect()
        assert sorted(map(tuple, calls)) == [(k, 5, sum(range(5 * k, 5 * k + 5))) for k in range(60)] + [(1000, 40, 780)]
        none = directions._together(df, ["net_id"], lambda own: [], "net_id long, n long, s long")
        assert none.count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    links = df.where("net_id < 1000")
    assert "FlatMapGroupsInPandas" not in directions.cycles(links)._jdf.queryExecution().sparkPlan().toString()
