"""Registered queries on links and nodes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from thalweg import fixtures as fx
from thalweg.operators import links as op

QUERIES: dict = {}


def register(name, sql=None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


def _links(spark, sf):
    return fx.multigraph(spark, sf).withColumn("net_id", F.lit(0).cast("long"))


def _pixels(spark, sf):
    s = fx.series(spark, sf)
    return s.select((F.col("series_id") % 7).alias("net_id"), F.col("series_id").alias("link_id"), "seq", F.floor("y").cast("int").alias("r"), F.col("x").cast("int").alias("c"), (1 + F.col("seq") % 4 * 0.5).alias("d"))


_L = fx.with_("links") + ", ends AS (SELECT link_id, u AS node FROM links UNION ALL SELECT link_id, v FROM links)"
_P = fx.with_("series") + ", px AS (SELECT series_id % 7 AS net_id, series_id AS link_id, seq, CAST(floor(y) AS INTEGER) AS r, CAST(x AS INTEGER) AS c, CAST(1 + seq % 4 * 0.5 AS DOUBLE) AS d FROM series)"


@register("node_degree", _L + " SELECT node, count(*) AS degree, string_agg(link_id, ',' ORDER BY link_id) AS link_ids FROM ends GROUP BY node")
def node_degree(spark, sf):
    return op.degrees(_links(spark, sf)).select("node", "degree", F.array_join("link_ids", ",").alias("link_ids"))


@register("link_parallel", _L + " SELECT least(u, v) AS a, greatest(u, v) AS b, string_agg(link_id, ',' ORDER BY link_id) AS link_ids FROM links GROUP BY 1, 2 HAVING count(*) > 1")
def link_parallel(spark, sf):
    return op.parallel(_links(spark, sf)).select("a", "b", F.array_join("link_ids", ",").alias("link_ids"))


@register("link_flip", _L + " SELECT link_id, CASE WHEN link_id % 3 = 0 THEN v ELSE u END AS u, CASE WHEN link_id % 3 = 0 THEN u ELSE v END AS v FROM links")
def link_flip(spark, sf):
    links = _links(spark, sf)
    return op.flip(links, links.where("link_id % 3 = 0")).select("link_id", "u", "v")


@register("link_flip_pixels", _P + " SELECT link_id, CASE WHEN link_id % 2 = 0 THEN max(seq) OVER (PARTITION BY link_id) - seq ELSE seq END AS seq, r, c FROM px")
def link_flip_pixels(spark, sf):
    p = _pixels(spark, sf)
    return op.flip_pixels(p, p.where("link_id % 2 = 0")).select("link_id", "seq", "r", "c")


@register("link_delete", _L + " SELECT link_id, u, v FROM links WHERE wid < 40")
def link_delete(spark, sf):
    links = _links(spark, sf)
    return op.delete(links, links.where("wid >= 40").select("net_id", "link_id")).select("link_id", "u", "v")


@register("link_add", _L + " SELECT link_id, u, v FROM links UNION ALL SELECT (SELECT max(link_id) FROM links) + row_number() OVER (ORDER BY n_nationkey), CAST(n_nationkey AS BIGINT), CAST(100 + n_regionkey AS BIGINT) FROM nation")
def link_add(spark, sf):
    more = fx.table(spark, sf, "nation").select(F.lit(0).cast("long").alias("net_id"), F.col("n_nationkey").cast("long").alias("u"), (F.col("n_regionkey") + 100).cast("long").alias("v"))
    return op.add(_links(spark, sf), more).select("link_id", "u", "v")


@register("link_spurs")
def link_spurs(spark, sf):
    links = _links(spark, sf)
    return op.without_spurs(links, links.where("u < 20").select("net_id", F.col("u").alias("node")).distinct()).select("link_id", "u", "v")


@register("node_two_link")
def node_two_link(spark, sf):
    links = _links(spark, sf)
    return op.contract(links, links.where("u < 20").select("net_id", F.col("u").alias("node")).distinct()).select("link_id", "u", "v", "n_links", "len")


@register("link_end_pixels", _P + " SELECT link_id, min_by(r, seq) AS r0, min_by(c, seq) AS c0, max_by(r, seq) AS r1, max_by(c, seq) AS c1 FROM px GROUP BY link_id")
def link_end_pixels(spark, sf):
    return op.end_pixels(_pixels(spark, sf)).select("link_id", F.col("first.r").alias("r0"), F.col("first.c").alias("c0"), F.col("last.r").alias("r1"), F.col("last.c").alias("c1"))


_DAYS = fx.with_("series") + ", px AS (SELECT 0 AS net_id, series_id * 100 + CAST(x AS INTEGER) AS link_id, seq, CAST(floor(y / 50) AS INTEGER) AS r, series_id % 2 AS c FROM series)"


def _days(spark, sf):
    """A link per user and day."""
    s = fx.series(spark, sf)
    return s.select(F.lit(0).alias("net_id"), (F.col("series_id") * 100 + F.col("x").cast("int")).alias("link_id"), "seq", F.floor(F.col("y") / 50).cast("int").alias("r"), (F.col("series_id") % 2).alias("c"))


@register("link_single_pixel", _DAYS + " SELECT link_id FROM px GROUP BY link_id HAVING count(*) = 1")
def link_single_pixel(spark, sf):
    return op.single_pixel(_days(spark, sf)).select("link_id")


@register("link_dedupe", _DAYS + ", s AS (SELECT net_id, link_id, string_agg(DISTINCT r || ':' || c, ',' ORDER BY r || ':' || c) AS cells FROM px GROUP BY ALL) SELECT link_id FROM s QUALIFY link_id > min(link_id) OVER (PARTITION BY net_id, cells)")
def link_dedupe(spark, sf):
    return op.duplicates(_days(spark, sf)).select("link_id")


@register("link_lengths", _P + ", s AS (SELECT link_id, sqrt(pow(c - lag(c) OVER w, 2) + pow(r - lag(r) OVER w, 2)) AS d FROM px WINDOW w AS (PARTITION BY link_id ORDER BY seq)) SELECT link_id, round(sum(coalesce(d, 0)) * 30, 4) AS len FROM s GROUP BY link_id")
def link_lengths(spark, sf):
    p = _pixels(spark, sf).withColumns({"x": F.col("c") * 30.0, "y": F.col("r") * -30.0})
    return op.lengths(p).select("link_id", F.round("len", 4).alias("len"))


@register("link_len_wid", _P + """, s AS (SELECT *, 2 * d * 30 AS wid, coalesce(sqrt(pow(c - lag(c) OVER w, 2) + pow(r - lag(r) OVER w, 2)) * 30, 0) AS step FROM px WINDOW w AS (PARTITION BY link_id ORDER BY seq)),
t AS (SELECT *, sum(step) OVER (PARTITION BY link_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS dist FROM s),
w AS (SELECT link_id, max(dist) AS total, min_by(wid, seq) AS w0, max_by(wid, seq) AS w1, max(seq) AS last FROM t GROUP BY link_id),
o AS (SELECT t.*, total, last, round(abs(dist - 1.1 * w0 / 2), 9) AS o0, round(abs(total - dist - 1.1 * w1 / 2), 9) AS o1 FROM t JOIN w USING (link_id)),
i AS (SELECT *, first_value(seq) OVER (PARTITION BY link_id ORDER BY o0, seq) AS i0, first_value(seq) OVER (PARTITION BY link_id ORDER BY o1, seq DESC) AS i1 FROM o),
g AS (SELECT link_id, avg(wid) AS wid, avg(wid) FILTER (WHERE i0 >= i1 OR (seq >= i0 AND seq < i1)) AS wid_adj, median(wid) FILTER (WHERE i0 >= i1 OR (seq >= i0 AND seq < i1)) AS wid_med, max(total) AS len,
  max(dist) FILTER (WHERE seq = CASE WHEN i0 >= i1 THEN last ELSE i1 END) - max(dist) FILTER (WHERE seq = CASE WHEN i0 >= i1 THEN 0 ELSE i0 END) AS len_adj,
  max(r) FILTER (WHERE seq = CASE WHEN i0 >= i1 THEN last ELSE i1 END) - max(r) FILTER (WHERE seq = CASE WHEN i0 >= i1 THEN 0 ELSE i0 END) AS dr,
  max(c) FILTER (WHERE seq = CASE WHEN i0 >= i1 THEN last ELSE i1 END) - max(c) FILTER (WHERE seq = CASE WHEN i0 >= i1 THEN 0 ELSE i0 END) AS dc FROM i GROUP BY link_id)
SELECT link_id, round(greatest(wid, 30), 4) AS wid, round(greatest(wid_adj, 30), 4) AS wid_adj, round(wid_med, 4) AS wid_med, round(greatest(len, 30), 4) AS len, round(greatest(len_adj, 30), 4) AS len_adj,
  round(len_adj / nullif(sqrt(dr * dr + dc * dc) * 30, 0), 4) AS sinuosity FROM g""")
def link_len_wid(spark, sf):
    found = op.widths_and_lengths(_pixels(spark, sf), 30.0).drop("net_id")
    return found.withColumns({c: F.round(c, 4) for c, t in found.dtypes if t == "double"})


@register("link_vector", _P + ", e AS (SELECT link_id, max_by(c, seq) - min_by(c, seq) AS dx, min_by(r, seq) - max_by(r, seq) AS dy FROM px GROUP BY link_id) SELECT link_id, round(dx / nullif(sqrt(dx * dx + dy * dy), 0), 6) AS dx, round(dy / nullif(sqrt(dx * dx + dy * dy), 0), 6) AS dy FROM e")
def link_vector(spark, sf):
    return op.link_vectors(_pixels(spark, sf)).select("link_id", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


def _paired(spark, sf):
    p = _pixels(spark, sf)
    return p.select("net_id", "link_id").distinct().select("net_id", "link_id", (F.col("link_id") % 3).alias("u"), (F.col("link_id") % 2 + 20).alias("v"))


@register("link_artificial_split", _P + """, l AS (SELECT DISTINCT net_id, link_id, link_id % 3 AS u, link_id % 2 + 20 AS v FROM px), s AS (SELECT *, coalesce(sqrt(pow(c - lag(c) OVER w, 2) + pow(r - lag(r) OVER w, 2)), 0) AS step FROM px WINDOW w AS (PARTITION BY link_id ORDER BY seq)),
t AS (SELECT *, sum(step) OVER (PARTITION BY link_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS dist FROM s), n AS (SELECT link_id, max(dist) AS total FROM t GROUP BY 1),
k AS (SELECT l.link_id, total FROM l JOIN n USING (link_id) QUALIFY count(*) OVER (PARTITION BY net_id, u, v) > 1 AND row_number() OVER (PARTITION BY net_id, u, v ORDER BY total, l.link_id) > 1)
SELECT link_id, arg_min(seq, round(abs(dist - total / 2), 9) * 100000 + seq) AS seq FROM t JOIN k USING (link_id) GROUP BY link_id""")
def link_artificial_split(spark, sf):
    return op.split_at_half(_paired(spark, sf), _pixels(spark, sf)).select("link_id", "seq")


@register("linkdirs_raster", _P + ", v AS (SELECT net_id, link_id, r, c, seq / CAST(max(seq) OVER (PARTITION BY link_id) AS DOUBLE) AS v, seq FROM px) SELECT net_id, r, c, round(max_by(v, link_id * 1000 + seq), 6) AS v FROM v GROUP BY ALL")
def linkdirs_raster(spark, sf):
    return op.flow_raster(_pixels(spark, sf)).withColumn("v", F.round("v", 6))


@register("link_unpadded", _P + " SELECT net_id, link_id, seq, r - 20 AS r, c - 20 AS c FROM px")
def link_unpadded(spark, sf):
    return op.unpadded(_pixels(spark, sf), 20).select("net_id", "link_id", "seq", "r", "c")


_N = "WITH n AS (SELECT CAST(n_nationkey % 3 AS BIGINT) AS net_id, CAST(n_nationkey AS BIGINT) AS node_id, CAST(n_nationkey * 37 % 11 AS INTEGER) AS r, CAST(n_nationkey * 53 % 7 AS INTEGER) AS c FROM nation), m AS (SELECT DISTINCT CAST(s_suppkey % 3 AS BIGINT) AS net_id, CAST(s_suppkey % 13 AS INTEGER) AS r, CAST(s_nationkey % 9 AS INTEGER) AS c FROM supplier)"


def _nodes(spark, sf):
    return fx.table(spark, sf, "nation").selectExpr("cast(n_nationkey % 3 AS long) net_id", "cast(n_nationkey AS long) node_id", "cast(n_nationkey * 37 % 11 AS int) r", "cast(n_nationkey * 53 % 7 AS int) c")


@register("node_add", _N + ", x AS (SELECT * FROM m ANTI JOIN n USING (net_id, r, c)), t AS (SELECT net_id, max(node_id) AS top FROM n GROUP BY net_id) SELECT net_id, node_id, r, c FROM n UNION ALL SELECT net_id, top + row_number() OVER (PARTITION BY net_id ORDER BY r, c), r, c FROM x JOIN t USING (net_id)")
def node_add(spark, sf):
    return op.add_nodes(_nodes(spark, sf), fx.table(spark, sf, "supplier").selectExpr("cast(s_suppkey % 3 AS long) net_id", "cast(s_suppkey % 13 AS int) r", "cast(s_nationkey % 9 AS int) c"))


_LINKED = fx.with_("links") + ", k AS (SELECT * FROM links WHERE u % 4 > 0 AND v % 4 > 0) SELECT DISTINCT node FROM (SELECT u AS node FROM k UNION ALL SELECT v FROM k)"


@register("node_linked", _LINKED)
def node_linked(spark, sf):
    """The nodes that are left with a link when the links of some nodes are deleted."""
    links = _links(spark, sf)
    nodes = op.ends(links).select("net_id", F.col("node").alias("node_id")).distinct()
    return op.linked_nodes(nodes, op.delete(links, links.where("u % 4 = 0 OR v % 4 = 0").select("net_id", "link_id"))).select(F.col("node_id").alias("node"))


@register("nearest_inlet", fx.with_("inlets", "points") + " SELECT point_id, min_by(node_id, d * 1e9 + node_id / 1e9) AS node_id, round(min(d), 6) AS dist FROM (SELECT point_id, node_id, sqrt(pow(i.x - p.x, 2) + pow(i.y - p.y, 2)) AS d FROM inlets i, points p) GROUP BY point_id")
def nearest_inlet(spark, sf):
    return op.nearest_nodes(fx.inlets(spark, sf), fx.points(spark, sf)).withColumn("dist", F.round("dist", 6))


@register("widest_inlet", _L + " SELECT max_by(node, w * 1000 - node) AS node FROM (SELECT node, sum(wid) AS w FROM ends JOIN links USING (link_id) WHERE node % 4 = 1 GROUP BY node)")
def widest_inlet(spark, sf):
    links = _links(spark, sf)
    return op.widest_inlet(links, op.degrees(links).where("node % 4 = 1").select("net_id", "node")).select("node")


_NODES = "nodes AS (SELECT CAST(n_nationkey AS BIGINT) AS node_id, CAST(n_nationkey * 37 % 101 AS DOUBLE) AS x, CAST(n_nationkey * 53 % 89 AS DOUBLE) AS y FROM nation)"


@register("node_dist_apex", "WITH " + _NODES + ", a AS (SELECT avg(x) AS ax, avg(y) AS ay FROM nodes WHERE node_id < 3) SELECT node_id, round(sqrt(pow(x - ax, 2) + pow(y - ay, 2)) / max(sqrt(pow(x - ax, 2) + pow(y - ay, 2))) OVER (), 6) AS dist FROM nodes, a")
def node_dist_apex(spark, sf):
    n = fx.table(spark, sf, "nation").select(F.lit(0).alias("net_id"), F.col("n_nationkey").cast("long").alias("node_id"), (F.col("n_nationkey") * 37 % 101).cast("double").alias("x"), (F.col("n_nationkey") * 53 % 89).cast("double").alias("y"))
    return op.distance_from_apex(n, n.where("node_id < 3").select("net_id", "node_id")).select("node_id", F.round("dist", 6).alias("dist"))


_J = fx.with_("links") + """, l AS (SELECT * FROM links), io AS (SELECT u AS node, wid AS o, NULL::DOUBLE AS i, link_id FROM l UNION ALL SELECT v, NULL::DOUBLE, wid, link_id FROM l),
j AS (SELECT node, count(o) AS n_out, count(i) AS n_in, max(o) / min(o) AS ro, max(i) / min(i) AS ri FROM io GROUP BY node HAVING count(*) = 3),
k AS (SELECT node, CASE WHEN n_in = 1 AND n_out = 2 THEN 'b' WHEN n_in = 2 AND n_out = 1 THEN 'c' END AS jtype, CASE WHEN n_out = 2 AND n_in = 1 THEN ro WHEN n_in = 2 AND n_out = 1 THEN ri END AS width_ratio FROM j)"""


@register("junction_type", _J + " SELECT node, jtype, round(width_ratio, 6) AS width_ratio FROM k")
def junction_type(spark, sf):
    return op.junction_types(_links(spark, sf)).select("node", "jtype", F.round("width_ratio", 6).alias("width_ratio"))


@register("node_qr", _J + ", q AS (SELECT u AS node, count(*) AS n_out, max(wid) / min(wid) AS qr FROM l GROUP BY u HAVING count(*) = 2), d AS (SELECT node, count(*) AS n FROM io GROUP BY node) SELECT node, round(qr, 6) AS qr FROM q JOIN d USING (node) WHERE n = 3 OR (n = 2 AND node % 2 = 0)")
def node_qr(spark, sf):
    links = _links(spark, sf)
    inlets = op.degrees(links).where("node % 2 = 0").select("net_id", "node")
    return op.split_ratios(links, inlets).select("node", F.round("qr", 6).alias("qr"))


@register("link_super_apex", _L + ", t AS (SELECT node, sum(wid) AS wid FROM ends JOIN links USING (link_id) WHERE node < 4 GROUP BY node) SELECT link_id, u, v, round(wid, 6) AS wid FROM links UNION ALL SELECT (SELECT max(link_id) FROM links) + row_number() OVER (ORDER BY node), (SELECT min(node) - 1 FROM ends), node, round(wid, 6) FROM t")
def link_super_apex(spark, sf):
    links = _links(spark, sf)
    inlets = op.degrees(links).where("node < 4").select("net_id", "node")
    return op.add_super_apex(links, inlets).select("link_id", "u", "v", F.round("wid", 6).alias("wid"))


_VEC = ", vec AS (SELECT link_id, CAST(v * 37 % 101 - u * 37 % 101 AS DOUBLE) AS dx, CAST(v * 53 % 89 - u * 53 % 89 AS DOUBLE) AS dy, u, v FROM l)"


@register("junction_angles", _J + _VEC + """, two AS (SELECT k.node, link_id, dx, dy FROM k JOIN vec ON jtype = 'b' AND vec.u = k.node UNION ALL SELECT k.node, link_id, -dx, -dy FROM k JOIN vec ON jtype = 'c' AND vec.v = k.node),
a AS (SELECT node, degrees(max(atan2(dy, dx)) - min(atan2(dy, dx))) AS t FROM two GROUP BY node) SELECT node, round(least(t, 360 - t), 5) AS int_ang FROM a""")
def junction_angles(spark, sf):
    links = _links(spark, sf)
    v = links.select("net_id", "link_id", (F.col("v") * 37 % 101 - F.col("u") * 37 % 101).cast("double").alias("dx"), (F.col("v") * 53 % 89 - F.col("u") * 53 % 89).cast("double").alias("dy"))
    return op.junction_angles(links, v).select("node", F.round("int_ang", 5).alias("int_ang"))


@register("merge_lists", "WITH RECURSIVE l AS (SELECT c_custkey % 60 AS list_id, c_custkey * 7 % 211 AS item FROM customer), e AS (SELECT DISTINCT a.list_id AS a, b.list_id AS b FROM l a JOIN l b USING (item)), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT DISTINCT list_id, item, label FROM l JOIN (SELECT a AS list_id, min(b) AS label FROM r GROUP BY a) USING (list_id)")
def merge_lists(spark, sf):
    lists = fx.table(spark, sf, "customer").select((F.col("c_custkey") % 60).alias("list_id"), (F.col("c_custkey") * 7 % 211).alias("item")).distinct()
    return op.merged(lists)
