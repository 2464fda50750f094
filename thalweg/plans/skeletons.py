"""Registered queries on skeletons, centerlines and meshes (sequential within an image or line, so checked by tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from thalweg import fixtures as fx
from thalweg.operators import mesh, series, skeleton
from thalweg.operators.regions import stored

QUERIES: dict = {}


def register(name, sql=None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


def _skeleton(spark, sf):
    return stored(skeleton.skeletonize(fx.pixels(spark, sf, -0.05)))


@register("skeleton")
def skeleton_pixels(spark, sf):
    return _skeleton(spark, sf)


@register("skeleton_links")
def skeleton_links(spark, sf):
    return skeleton.skeleton_links(_skeleton(spark, sf))


@register("skeleton_nodes")
def skeleton_nodes(spark, sf):
    return skeleton.skeleton_nodes(_skeleton(spark, sf))


@register("skeleton_turns")
def skeleton_turns(spark, sf):
    return skeleton.pixel_turns(skeleton.skeleton_links(_skeleton(spark, sf))).withColumn("turn", F.round("turn", 6))


@register("centerline")
def centerline(spark, sf):
    return skeleton.longest_path(_skeleton(spark, sf))


_T = fx.with_("series") + """, d AS (SELECT series_id, seq, x, y, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM series WINDOW w AS (PARTITION BY series_id ORDER BY seq)),
t AS (SELECT series_id, seq, x - dy / sqrt(dx * dx + dy * dy) * 25 AS x1, y + dx / sqrt(dx * dx + dy * dy) * 25 AS y1, x + dy / sqrt(dx * dx + dy * dy) * 25 AS x2, y - dx / sqrt(dx * dx + dy * dy) * 25 AS y2 FROM d WHERE dx <> 0 OR dy <> 0)"""


@register("mesh_transects", _T + " SELECT series_id, seq, round(x1, 5) AS x1, round(y1, 5) AS y1, round(x2, 5) AS x2, round(y2, 5) AS y2 FROM t")
def mesh_transects(spark, sf):
    t = mesh.transects(fx.series(spark, sf), 25.0)
    return t.withColumns({c: F.round(c, 5) for c in ("x1", "y1", "x2", "y2")})


@register("mesh_cells", _T + " SELECT series_id, count(*) - 1 AS n_cells FROM t GROUP BY series_id")
def mesh_cells(spark, sf):
    return mesh.cells(mesh.transects(fx.series(spark, sf), 25.0)).groupBy("series_id").agg(F.count("*").alias("n_cells"))


@register("mesh_valley")
def mesh_valley(spark, sf):
    lines = series.resample(fx.series(spark, sf), 40)
    return mesh.valley_mesh(series.smooth(lines, window=9), 20.0, 5.0).withColumns({c: F.round(c, 4) for c in ("x1", "y1", "x2", "y2")})


@register("line_offset")
def line_offset(spark, sf):
    return mesh.offset(fx.series(spark, sf), 2.0).withColumns({c: F.round(c, 5) for c in ("x", "y")})


@register("series_aligned")
def series_aligned(spark, sf):
    s = fx.series(spark, sf)
    both = s.select("series_id", F.lit("a").alias("side"), "seq", F.col("x").alias("v")).unionByName(s.where("seq % 2 = 0").select("series_id", F.lit("b").alias("side"), "seq", F.col("x").alias("v")))
    return mesh.aligned(both)
