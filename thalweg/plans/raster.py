"""Registered raster queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from thalweg import fixtures as fx
from thalweg.operators import raster as op

QUERIES: dict = {}

_ON = fx.with_("cells", "pixels", "images", "offsets")


def register(name, sql=None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


@register("px_neighbors8", _ON + " SELECT p.image_id, p.r, p.c, q.r AS nr, q.c AS nc FROM pixels p, offsets o, pixels q WHERE q.image_id = p.image_id AND q.r = p.r + o.dr AND q.c = p.c + o.dc")
def px_neighbors8(spark, sf):
    return op.neighbours(fx.pixels(spark, sf))


_PLACE = "((dr + 1) * 3 + dc + 1 - CASE WHEN dr > 0 OR (dr = 0 AND dc > 0) THEN 1 ELSE 0 END)"


@register("px_neighbor_values", _ON + f" SELECT p.image_id, p.r, p.c, CAST({_PLACE} AS INTEGER) AS place, q.v FROM cells p CROSS JOIN offsets o LEFT JOIN cells q ON q.image_id = p.image_id AND q.r = p.r + o.dr AND q.c = p.c + o.dc")
def px_neighbor_values(spark, sf):
    cells = fx.cells(spark, sf)
    return op.neighbour_values(cells, fx.images(spark, sf))


_CONN = """ SELECT p.image_id, p.r, p.c, count(q.r) AS conn FROM pixels p CROSS JOIN offsets o JOIN images i ON i.image_id = p.image_id
LEFT JOIN pixels q ON q.image_id = p.image_id AND q.r = {r} AND q.c = {c} GROUP BY ALL"""
_MIRROR = _CONN.format(r="CASE WHEN p.r + o.dr < 0 THEN 1 WHEN p.r + o.dr >= nrows THEN nrows - 2 ELSE p.r + o.dr END", c="CASE WHEN p.c + o.dc < 0 THEN 1 WHEN p.c + o.dc >= ncols THEN ncols - 2 ELSE p.c + o.dc END")


@register("px_conn8_reflect", _ON + _MIRROR)
def px_conn8_reflect(spark, sf):
    return op.connectivity(fx.pixels(spark, sf), fx.images(spark, sf))


@register("px_conn8", _ON + _CONN.format(r="p.r + o.dr", c="p.c + o.dc"))
def px_conn8(spark, sf):
    return op.connectivity(fx.pixels(spark, sf), border="zero")


@register("px_conn8_histogram", _ON + ", n AS (" + _CONN.format(r="p.r + o.dr", c="p.c + o.dc") + ") SELECT conn, count(*) AS n_pixels, CAST(sum(CASE WHEN conn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_endpoints FROM n GROUP BY conn")
def px_conn8_histogram(spark, sf):
    conn = op.connectivity(fx.pixels(spark, sf), border="zero")
    return conn.groupBy("conn").agg(F.count("*").alias("n_pixels"), F.sum((F.col("conn") == 1).cast("long")).alias("n_endpoints"))


_FOUR = "SELECT p.image_id, p.r, p.c, q.r AS nr, q.c AS nc FROM pixels p CROSS JOIN offsets o JOIN pixels q ON q.image_id = p.image_id AND q.r = p.r + o.dr AND q.c = p.c + o.dc WHERE abs(o.dr) + abs(o.dc) = 1"


@register("px_conn4", _ON + f", f AS ({_FOUR}) SELECT p.image_id, p.r, p.c, CASE WHEN p.r IN (0, nrows - 1) OR p.c IN (0, ncols - 1) THEN 0 ELSE count(f.nr) END AS four FROM pixels p JOIN images i ON i.image_id = p.image_id LEFT JOIN f ON f.image_id = p.image_id AND f.r = p.r AND f.c = p.c GROUP BY p.image_id, p.r, p.c, nrows, ncols")
def px_conn4(spark, sf):
    return op.four_connectivity(fx.pixels(spark, sf), fx.images(spark, sf))


@register("px_four_neighbors", _ON + f", f AS ({_FOUR}) SELECT p.image_id, p.r, p.c, coalesce(string_agg(f.nr || ':' || f.nc, ' ' ORDER BY f.nr, f.nc), '') AS near FROM pixels p LEFT JOIN f ON f.image_id = p.image_id AND f.r = p.r AND f.c = p.c GROUP BY ALL")
def px_four_neighbors(spark, sf):
    near = op.four_neighbours(fx.pixels(spark, sf))
    return near.withColumn("near", F.array_join(F.transform("near", lambda x: F.concat(x["from_r"], F.lit(":"), x["from_c"])), " "))


@register("px_axes", _ON + ", f AS (SELECT p.image_id, p.r, p.c, count(DISTINCT CASE WHEN dr = dc THEN 1 WHEN dc = 0 THEN 2 WHEN dr = -dc THEN 3 ELSE 4 END) AS axes FROM pixels p CROSS JOIN offsets o JOIN pixels q ON q.image_id = p.image_id AND q.r = p.r + o.dr AND q.c = p.c + o.dc GROUP BY ALL) SELECT image_id, r, c, coalesce(axes, 0) AS axes FROM pixels LEFT JOIN f USING (image_id, r, c)")
def px_axes(spark, sf):
    return op.axes(fx.pixels(spark, sf))


@register("px_codes", _ON + ", f AS (SELECT p.image_id, p.r, p.c, sum(CASE dr WHEN -1 THEN 32 WHEN 0 THEN 16 ELSE 8 END * CASE WHEN dc = 0 THEN 1.0 WHEN dc < 0 THEN 8.0 ELSE 0.125 END) AS s FROM pixels p CROSS JOIN offsets o JOIN pixels q ON q.image_id = p.image_id AND q.r = p.r + o.dr AND q.c = p.c + o.dc GROUP BY ALL) SELECT image_id, r, c, CAST(coalesce(s, 0) + 16 AS BIGINT) AS code FROM pixels LEFT JOIN f USING (image_id, r, c)")
def px_codes(spark, sf):
    return op.codes(fx.pixels(spark, sf))


@register("px_endpoints", _ON + ", n AS (" + _MIRROR + ") SELECT image_id, r, c FROM n WHERE conn = 1")
def px_endpoints(spark, sf):
    return op.endpoints(fx.pixels(spark, sf), fx.images(spark, sf))


@register("px_edge", _ON + " SELECT c.image_id, c.r, c.c FROM cells c JOIN images i ON i.image_id = c.image_id WHERE c.r IN (0, nrows - 1) OR c.c IN (0, ncols - 1)")
def px_edge(spark, sf):
    return op.edge_cells(fx.images(spark, sf))


_ERODE = """, s AS (SELECT CAST(a AS INTEGER) AS dr, CAST(b AS INTEGER) AS dc FROM range(-{n}, {m}) x(a), range(-{n}, {m}) y(b) WHERE {shape}),
bad AS (SELECT DISTINCT p.image_id, p.r, p.c FROM pixels p CROSS JOIN s JOIN cells q ON q.image_id = p.image_id AND q.r = p.r + s.dr AND q.c = p.c + s.dc WHERE NOT (q.v > CAST({on} AS FLOAT)))
SELECT image_id, r, c FROM pixels ANTI JOIN bad USING (image_id, r, c)"""
_DILATE = """, s AS (SELECT CAST(a AS INTEGER) AS dr, CAST(b AS INTEGER) AS dc FROM range(-{n}, {m}) x(a), range(-{n}, {m}) y(b) WHERE {shape})
SELECT DISTINCT q.image_id, q.r, q.c FROM pixels p CROSS JOIN s JOIN cells q ON q.image_id = p.image_id AND q.r = p.r + s.dr AND q.c = p.c + s.dc"""
_LOW = fx.with_("cells") + ", pixels AS (SELECT image_id, r, c FROM cells WHERE v > CAST(-0.05 AS FLOAT))"
_SHAPES = {"square": dict(n=1, m=2, shape="TRUE"), "plus": dict(n=1, m=2, shape="abs(a) + abs(b) < 2"), "disk": dict(n=3, m=4, shape="a * a + b * b <= 9")}


def _morphology(strel):
    @register(f"px_erode_{strel}", _LOW + _ERODE.format(on=-0.05, **_SHAPES[strel]))
    def erode(spark, sf):
        return op.erode(fx.pixels(spark, sf, -0.05), fx.images(spark, sf), strel=strel)

    @register(f"px_dilate_{strel}", _ON + _DILATE.format(**_SHAPES[strel]))
    def dilate(spark, sf):
        return op.dilate(fx.pixels(spark, sf), fx.images(spark, sf), strel=strel)


for _s in _SHAPES:
    _morphology(_s)


@register("px_window", _ON + " SELECT image_id, r, c, v, r - 18 AS wr, c - 28 AS wc FROM cells WHERE r BETWEEN 18 AND 22 AND c BETWEEN 28 AND 34")
def px_window(spark, sf):
    return op.window(fx.cells(spark, sf), 20, 31, 5, 7).withColumns({"wr": F.col("wr").cast("int"), "wc": F.col("wc").cast("int")})


@register("px_trim", _ON + " SELECT p.image_id, p.r + 30 AS r, p.c - 10 AS c FROM pixels p JOIN images i ON i.image_id = p.image_id WHERE p.r + 30 < nrows AND p.c >= 10")
def px_trim(spark, sf):
    moved = fx.pixels(spark, sf).select("image_id", (F.col("r") + 30).alias("r"), (F.col("c") - 10).alias("c"))
    return op.inside(moved, fx.images(spark, sf))


@register("px_overlay", _ON + ", other AS (SELECT image_id, r, c FROM cells WHERE abs(v) > CAST(0.15 AS FLOAT)) SELECT image_id, r, c, CASE WHEN o.r IS NULL THEN 2 WHEN p.r IS NULL THEN 3 ELSE 1 END AS code FROM pixels p FULL JOIN other o USING (image_id, r, c)".replace("o.r IS NULL", "b IS NULL").replace("p.r IS NULL", "a IS NULL").replace("FROM pixels p FULL JOIN other o", "FROM (SELECT *, 1 AS a FROM pixels) FULL JOIN (SELECT *, 1 AS b FROM other)"))
def px_overlay(spark, sf):
    other = fx.cells(spark, sf).where(F.abs("v") > F.lit(0.15).cast("float")).select(*op.PIXEL)
    return op.overlay(fx.pixels(spark, sf), other)


_BOX = ", p2 AS (SELECT image_id, r, c FROM cells WHERE v > CAST(0.38 AS FLOAT)), box AS (SELECT image_id, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM p2 GROUP BY 1)"


def _boxed(spark, sf):
    return op.crop(fx.pixels(spark, sf, 0.38), fx.images(spark, sf))


@register("px_crop", _ON + _BOX + " SELECT p.image_id, r - r0 AS r, c - c0 AS c FROM p2 p JOIN box b ON b.image_id = p.image_id")
def px_crop(spark, sf):
    return _boxed(spark, sf)[0]


@register("px_crop_pads", _ON + _BOX + " SELECT image_id, c0 AS pad_left, r0 AS pad_top, ncols - 1 - c1 AS pad_right, nrows - 1 - r1 AS pad_bottom, r1 - r0 + 1 AS height, c1 - c0 + 1 AS width FROM box JOIN images USING (image_id)")
def px_crop_pads(spark, sf):
    return _boxed(spark, sf)[1]


@register("px_downsample", _ON + " SELECT image_id, CAST(floor(r * (13.0::DOUBLE / nrows)) AS INTEGER) AS r, CAST(floor(c * (16.0::DOUBLE / ncols)) AS INTEGER) AS c FROM pixels JOIN images USING (image_id) GROUP BY ALL HAVING count(*) * any_value((13.0::DOUBLE / nrows) * (16.0::DOUBLE / ncols)) >= 0.3")
def px_downsample(spark, sf):
    return op.downsample(fx.pixels(spark, sf), fx.images(spark, sf), 13, 16, 0.3)


@register("px_plus_fill", _ON + """, n AS (SELECT p.image_id, p.r - o.dr AS r, p.c - o.dc AS c, sum(CASE WHEN abs(dr) + abs(dc) = 1 THEN 1 ELSE 0 END) AS sides, sum(CASE WHEN abs(dr) + abs(dc) = 2 THEN 1 ELSE 0 END) AS corners FROM pixels p, offsets o GROUP BY ALL)
SELECT image_id, r, c FROM pixels UNION ALL SELECT image_id, r, c FROM n ANTI JOIN pixels USING (image_id, r, c) WHERE sides = 4 AND corners = 0""")
def px_plus_fill(spark, sf):
    return op.plus_fill(fx.pixels(spark, sf))


@register("px_pad_sides", _ON + " SELECT * FROM pixels UNION ALL SELECT image_id, CAST(-k AS INTEGER), c FROM pixels, range(1, 6) t(k) WHERE r = 0 UNION ALL SELECT image_id, CAST(r + k AS INTEGER), c FROM pixels JOIN images USING (image_id), range(1, 6) t(k) WHERE r = nrows - 1")
def px_pad_sides(spark, sf):
    return op.pad_rows(fx.pixels(spark, sf), fx.images(spark, sf), "ns", 5)


_POLYGON = [(5.5, 4.2), (40.5, 10.1), (30.5, 60.3), (20.5, 30.7)]  # r, c of the corners
_EDGES = list(zip(_POLYGON, _POLYGON[1:] + _POLYGON[:1], strict=True))


@register("px_polygon_mask", _ON + ", g(r1, c1, r2, c2) AS (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for (a, b), (c, d) in _EDGES) + """) SELECT image_id, r, c FROM cells, g
WHERE (r1 <= r) <> (r2 <= r) AND c < c1 + (r - r1) * (c2 - c1) / (r2 - r1) GROUP BY ALL HAVING count(*) % 2 = 1""")
def px_polygon_mask(spark, sf):
    cells = fx.cells(spark, sf)
    edges = fx.images(spark, sf).select("image_id", F.explode(F.array(*[F.struct(F.lit(a).alias("r1"), F.lit(b).alias("c1"), F.lit(c).alias("r2"), F.lit(d).alias("c2")) for (a, b), (c, d) in _EDGES])).alias("e"))
    return op.points_in_polygons(cells, edges.select("image_id", "e.*"))


@register("px_flat_index", _ON + " SELECT image_id, r, c, CAST(r AS BIGINT) * ncols + c AS idx, CAST(r + 7 AS BIGINT) * 100 + c + 9 AS global_idx FROM pixels JOIN images USING (image_id)")
def px_flat_index(spark, sf):
    from thalweg.functions.geo import flat_index

    sized = fx.pixels(spark, sf).join(fx.images(spark, sf).select("image_id", "ncols"), "image_id")
    return sized.select(*op.PIXEL, flat_index("r", "c", F.col("ncols")).alias("idx"), flat_index(F.col("r") + 7, F.col("c") + 9, F.lit(100)).alias("global_idx"))


_GT = "(336885.0 + image_id * 3000)"


@register("geo_affine", _ON + f" SELECT image_id, r, c, CAST({_GT} + (c + 0.5) * 30.0 AS DOUBLE) AS x, CAST(7826415.0 - (r + 0.5) * 30.0 AS DOUBLE) AS y FROM pixels")
def geo_affine(spark, sf):
    from thalweg.functions.geo import cell_centre

    sized = fx.pixels(spark, sf).join(fx.images(spark, sf).select("image_id", "gt"), "image_id")
    x, y = cell_centre("r", "c", F.col("gt"))
    return sized.select(*op.PIXEL, x.alias("x"), y.alias("y"))


@register("geo_inverse", _ON + ", pts AS (SELECT image_id, s_suppkey AS point_id, 336885.0 + image_id * 3000 + s_acctbal / 7 AS x, 7826415.0 - s_suppkey * 3.7 AS y FROM images JOIN supplier ON image_id = s_suppkey % 4) SELECT image_id, point_id, CAST(trunc((x - (336885.0 + image_id * 3000)) / 30.0) AS INTEGER) AS c, CAST(trunc((y - 7826415.0) / -30.0) AS INTEGER) AS r FROM pts")
def geo_inverse(spark, sf):
    from thalweg.functions.geo import cell_of

    pts = _sample_points(spark, sf)
    c, r = cell_of("x", "y", F.col("gt"))
    return pts.select("image_id", "point_id", c.alias("c"), r.alias("r"))


def _sample_points(spark, sf):
    s = fx.table(spark, sf, "supplier").withColumn("image_id", F.col("s_suppkey") % 4)
    both = fx.images(spark, sf).join(s, "image_id")
    return both.select("image_id", "gt", F.col("s_suppkey").alias("point_id"), (F.lit(336885.0) + F.col("image_id") * 3000 + F.col("s_acctbal") / 7).alias("x"), (F.lit(7826415.0) - F.col("s_suppkey") * 3.7).alias("y"))


@register("geo_sample", _ON + ", pts AS (SELECT image_id, s_suppkey AS point_id, 336885.0 + image_id * 3000 + s_acctbal / 7 AS x, 7826415.0 - s_suppkey * 3.7 AS y FROM images JOIN supplier ON image_id = s_suppkey % 4), cell AS (SELECT image_id, point_id, CAST(trunc((x - (336885.0 + image_id * 3000)) / 30.0) AS INTEGER) AS c, CAST(trunc((y - 7826415.0) / -30.0) AS INTEGER) AS r FROM pts) SELECT image_id, point_id, v FROM cell LEFT JOIN cells USING (image_id, r, c)")
def geo_sample(spark, sf):
    from thalweg.functions.geo import cell_of

    pts = _sample_points(spark, sf)
    c, r = cell_of("x", "y", F.col("gt"))
    return pts.select("image_id", "point_id", c.alias("c"), r.alias("r")).join(fx.cells(spark, sf), list(op.PIXEL), "left").select("image_id", "point_id", "v")
