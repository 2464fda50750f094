"""Registered queries on components, holes, islands and distances, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from thalweg import fixtures as fx
from thalweg.operators import raster, skeleton
from thalweg.operators import regions as op

QUERIES: dict = {}


def register(name, sql=None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


_SETS = fx.with_("cells", "images", "offsets")
_ON = _SETS + ", pixels AS (SELECT image_id, r, c FROM cells WHERE v > CAST(0.1 AS FLOAT)), px AS (SELECT image_id, r, c, CAST(r AS BIGINT) * ncols + c AS n FROM pixels JOIN images USING (image_id))"
_OFF = _SETS + ", pixels AS (SELECT image_id, r, c FROM cells WHERE NOT (v > CAST(-0.05 AS FLOAT))), px AS (SELECT image_id, r, c, CAST(r AS BIGINT) * ncols + c AS n FROM pixels JOIN images USING (image_id))"


def _labels(near: str = "TRUE") -> str:
    """lab: reach of every pixel by recursion over pairs (UNION removes what was reached before)."""
    return f""", e AS (SELECT p.image_id AS g, p.n AS a, q.n AS b FROM px p CROSS JOIN offsets o JOIN px q ON q.image_id = p.image_id AND q.r = p.r + o.dr AND q.c = p.c + o.dc WHERE {near}),
reach AS (SELECT image_id AS g, n, n AS m FROM px UNION SELECT reach.g, reach.n, e.b FROM reach JOIN e ON e.g = reach.g AND e.a = reach.m),
lab AS (SELECT px.image_id, px.r, px.c, l.label FROM px JOIN (SELECT g, n, min(m) AS label FROM reach GROUP BY g, n) l ON l.g = px.image_id AND l.n = px.n)"""


_SIDES = "abs(o.dr) + abs(o.dc) = 1"
_WITH8, _WITH4 = _ON + _labels(), _ON + _labels(_SIDES)


def _pixels(spark, sf):
    return fx.pixels(spark, sf)


@register("px_components", _WITH4 + " SELECT image_id, r, c, label FROM lab")
def px_components(spark, sf):
    return op.label(_pixels(spark, sf), fx.images(spark, sf), 1)


@register("px_components8", _WITH8 + " SELECT image_id, r, c, label FROM lab")
def px_components8(spark, sf):
    return op.label(_pixels(spark, sf), fx.images(spark, sf))


@register("blob_area", _WITH4 + " SELECT image_id, label, count(*) AS area FROM lab GROUP BY ALL")
def blob_area(spark, sf):
    return op.areas(px_components(spark, sf))


@register("blob_moments", _WITH4 + """, g AS (SELECT image_id, label, count(*) AS area, avg(r) AS centroid_r, avg(c) AS centroid_c, min(r) AS min_r, max(r) AS max_r, min(c) AS min_c, max(c) AS max_c,
  avg(r * r) - avg(r) * avg(r) + 1.0 / 12 AS rr, avg(c * c) - avg(c) * avg(c) + 1.0 / 12 AS cc, avg(r * c) - avg(r) * avg(c) AS rc FROM lab GROUP BY ALL),
h AS (SELECT *, (rr + cc) / 2 + sqrt(pow((rr - cc) / 2, 2) + rc * rc) AS big, greatest((rr + cc) / 2 - sqrt(pow((rr - cc) / 2, 2) + rc * rc), 0) AS small FROM g)
SELECT image_id, label, area, round(centroid_r, 6) AS centroid_r, round(centroid_c, 6) AS centroid_c, min_r, max_r, min_c, max_c, round(4 * sqrt(big), 6) AS major_axis, round(4 * sqrt(small), 6) AS minor_axis,
  round(sqrt(4 * area / pi()), 6) AS equivalent_diameter, round(area / ((max_r - min_r + 1) * (max_c - min_c + 1)), 6) AS extent, round(pow(1 - small / big, 1), 6) AS eccentricity2 FROM h""")
def blob_moments(spark, sf):
    m = op.moments(px_components(spark, sf)).drop("eccentricity")
    return m.withColumns({c: F.round(c, 6) for c, t in m.dtypes if t == "double"})


@register("blob_values", _WITH4 + " SELECT image_id, label, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS greatest FROM lab JOIN cells USING (image_id, r, c) GROUP BY ALL")
def blob_values(spark, sf):
    return op.values_of(px_components(spark, sf), fx.cells(spark, sf)).withColumn("mean", F.round("mean", 6))


@register("blob_perimeter", _WITH4 + """, s AS (SELECT l.image_id, l.label, l.r, l.c, count(*) AS n FROM lab l CROSS JOIN offsets o LEFT JOIN lab q ON q.image_id = l.image_id AND q.r = l.r + o.dr AND q.c = l.c + o.dc
WHERE abs(o.dr) + abs(o.dc) = 1 AND (q.label IS NULL OR q.label <> l.label) GROUP BY ALL) SELECT image_id, label, count(*) AS perimeter_pixels, CAST(sum(n) AS BIGINT) AS perimeter_sides FROM s GROUP BY ALL""")
def blob_perimeter(spark, sf):
    return op.perimeter_pixels(px_components(spark, sf))


@register("blob_largest", _WITH4 + ", a AS (SELECT image_id, label, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, label) AS k FROM (SELECT image_id, label, count(*) AS n FROM lab GROUP BY ALL)) SELECT image_id, r, c FROM lab SEMI JOIN (SELECT * FROM a WHERE k <= 2) b USING (image_id, label)")
def blob_largest(spark, sf):
    return op.largest_blobs(px_components(spark, sf), 2)


@register("blob_without_largest", _WITH4 + ", a AS (SELECT image_id, label, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, label) AS k FROM (SELECT image_id, label, count(*) AS n FROM lab GROUP BY ALL)) SELECT image_id, r, c FROM lab SEMI JOIN (SELECT * FROM a WHERE k > 1) b USING (image_id, label)")
def blob_without_largest(spark, sf):
    return op.largest_blobs(px_components(spark, sf), 1, "remove")


@register("blob_remove", _WITH4 + ", a AS (SELECT image_id, label FROM lab GROUP BY ALL HAVING count(*) >= 4) SELECT image_id, r, c FROM lab SEMI JOIN a USING (image_id, label)")
def blob_remove(spark, sf):
    return op.remove_blobs(px_components(spark, sf), 4)


_HOLES = _OFF + _labels(_SIDES) + ", edge AS (SELECT DISTINCT image_id, label FROM lab JOIN images USING (image_id) WHERE r IN (0, nrows - 1) OR c IN (0, ncols - 1)), hole AS (SELECT * FROM lab ANTI JOIN edge USING (image_id, label))"


@register("fill_holes", _HOLES + " SELECT image_id, r, c FROM cells WHERE v > CAST(-0.05 AS FLOAT) UNION ALL SELECT image_id, r, c FROM hole")
def fill_holes(spark, sf):
    return op.fill_holes(fx.pixels(spark, sf, -0.05), fx.images(spark, sf))


@register("fill_small_holes", _HOLES + ", a AS (SELECT image_id, label FROM hole GROUP BY ALL HAVING count(*) <= 2) SELECT image_id, r, c FROM cells WHERE v > CAST(-0.05 AS FLOAT) UNION ALL SELECT image_id, r, c FROM hole SEMI JOIN a USING (image_id, label)")
def fill_small_holes(spark, sf):
    return op.fill_holes(fx.pixels(spark, sf, -0.05), fx.images(spark, sf), 2)


_EDT = "SELECT p.image_id, p.r, p.c, round(sqrt(min((p.r - q.r) * (p.r - q.r) + (p.c - q.c) * (p.c - q.c))), 6) AS d FROM {on} p JOIN {off} q ON q.image_id = p.image_id GROUP BY ALL"


@register("edt", _SETS + ", px AS (SELECT * FROM cells WHERE v > CAST(-0.05 AS FLOAT)), off AS (SELECT * FROM cells WHERE NOT (v > CAST(-0.05 AS FLOAT))) " + _EDT.format(on="px", off="off"))
def edt(spark, sf):
    return op.distances(fx.pixels(spark, sf, -0.05), fx.images(spark, sf)).withColumn("d", F.round("d", 6))


_LOW = _SETS + ", pixels AS (SELECT image_id, r, c FROM cells WHERE NOT (v > CAST(-0.1 AS FLOAT))), px AS (SELECT image_id, r, c, CAST(r AS BIGINT) * ncols + c AS n FROM pixels JOIN images USING (image_id))"
_ISLANDS = _LOW + _labels() + """, edge AS (SELECT DISTINCT image_id, label FROM lab JOIN images USING (image_id) WHERE r IN (0, nrows - 1) OR c IN (0, ncols - 1)), isl AS (SELECT * FROM lab ANTI JOIN edge USING (image_id, label)),
d AS (SELECT p.image_id, p.r, p.c, sqrt(min((p.r - q.r) * (p.r - q.r) + (p.c - q.c) * (p.c - q.c))) AS d FROM isl p JOIN cells q ON q.image_id = p.image_id AND abs(q.r - p.r) < 8 AND abs(q.c - p.c) < 8 LEFT JOIN isl x ON x.image_id = q.image_id AND x.r = q.r AND x.c = q.c WHERE x.label IS NULL GROUP BY ALL),
g AS (SELECT image_id, label, count(*) AS n, avg(r) AS centroid_r, avg(c) AS centroid_c, max(d) AS d, avg(r * r) - avg(r) * avg(r) + 1.0 / 12 AS rr, avg(c * c) - avg(c) * avg(c) + 1.0 / 12 AS cc, avg(r * c) - avg(r) * avg(c) AS rc FROM isl JOIN d USING (image_id, r, c) GROUP BY ALL),
isles AS (SELECT image_id, label, CAST(n * 900.0 AS DOUBLE) AS area, 4 * sqrt((rr + cc) / 2 + sqrt(pow((rr - cc) / 2, 2) + rc * rc)) * 30 AS major_axis, 4 * sqrt(greatest((rr + cc) / 2 - sqrt(pow((rr - cc) / 2, 2) + rc * rc), 0)) * 30 AS minor_axis, 2 * d * 30 AS max_width, centroid_r, centroid_c FROM g)"""


@register("islands_props", _ISLANDS + " SELECT image_id, label, area, round(major_axis, 5) AS major_axis, round(minor_axis, 5) AS minor_axis, round(max_width, 5) AS max_width, round(centroid_r, 5) AS centroid_r, round(centroid_c, 5) AS centroid_c FROM isles")
def islands_props(spark, sf):
    found = op.islands(fx.pixels(spark, sf, -0.1), fx.images(spark, sf), 30.0)
    return found.withColumns({c: F.round(c, 5) for c in ("major_axis", "minor_axis", "max_width", "centroid_r", "centroid_c")})


@register("islands_threshold", _ISLANDS + " SELECT image_id, label, (area < pow(0.1 * 160.0, 2) OR major_axis < 160.0 / 4 OR area / (area * 40 + 900) < 0.01 OR area / major_axis / 70.0 < 0.1) AND NOT major_axis > 160.0 AS remove FROM isles")
def islands_threshold(spark, sf):
    found = op.islands(fx.pixels(spark, sf, -0.1), fx.images(spark, sf), 30.0).withColumn("sur_area", F.col("area") * 40 + 900).withColumn("sur_avg_wid", F.lit(70.0))
    return found.select("image_id", "label", op.island_threshold(160.0).alias("remove"))


@register("islands_ring", _ISLANDS + ", t AS (SELECT DISTINCT i.image_id, i.label, q.r, q.c FROM isl i CROSS JOIN offsets o JOIN cells q ON q.image_id = i.image_id AND q.r = i.r + o.dr AND q.c = i.c + o.dc WHERE q.v > CAST(-0.1 AS FLOAT)) SELECT image_id, label, count(*) AS ring_area, string_agg(DISTINCT CAST(r // 10 AS VARCHAR), ',' ORDER BY CAST(r // 10 AS VARCHAR)) AS links FROM t GROUP BY ALL")
def islands_ring(spark, sf):
    pixels, images = fx.pixels(spark, sf, -0.1), fx.images(spark, sf)
    links = pixels.withColumn("link_id", F.expr("r div 10"))
    found = op.surrounding(pixels, op.stored(op.holes(pixels, images, 2)), images, links)
    return found.select("image_id", "label", "ring_area", F.array_join(F.sort_array(F.transform("link_ids", lambda x: x.cast("string"))), ",").alias("links"))


@register("max_valley_width")
def max_valley_width(spark, sf):
    return op.max_valley_width(fx.pixels(spark, sf, 0.0), fx.images(spark, sf)).withColumn("max_valley_width", F.round("max_valley_width", 6))


@register("px_simplified")
def px_simplified(spark, sf):
    """On the skeleton's mask, whose order in an image decides; no SQL says that."""
    return skeleton.simplify(fx.pixels(spark, sf, -0.05))
