"""Registered queries on flow directions and joins by place, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from thalweg import fixtures as fx
from thalweg.operators import directions as op
from thalweg.operators import links as lk
from thalweg.operators import spatial
from thalweg.operators.regions import stored

QUERIES: dict = {}


def register(name, sql=None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


_L = fx.with_("links") + ", l AS (SELECT * FROM links), ends AS (SELECT link_id, u AS node, v AS other FROM l UNION ALL SELECT link_id, v, u FROM l)"


def _links(spark, sf):
    return fx.multigraph(spark, sf).withColumn("net_id", F.lit(0).cast("long"))


def _nodes(links, test):
    return lk.ends(links).where(test).select("net_id", "node").distinct()


@register("dir_inlet_outlet", _L + ", f AS (SELECT link_id, node AS us, 0 AS k FROM ends WHERE node < 20 UNION ALL SELECT link_id, other, 1 FROM ends WHERE node > 990) SELECT link_id, CAST(min(k * 100000 + us) % 100000 AS BIGINT) AS us FROM f GROUP BY link_id")
def dir_inlet_outlet(spark, sf):
    links = _links(spark, sf)
    return op.inlet_outlet_facts(links, _nodes(links, "node < 20"), _nodes(links, "node > 990")).select("link_id", "us")


@register("dir_check_sources", _L + ", io AS (SELECT u AS node, 1 AS o FROM l UNION ALL SELECT v, 0 FROM l) SELECT node, CASE WHEN sum(o) = 0 THEN 'sink' ELSE 'source' END AS kind FROM io WHERE node BETWEEN 20 AND 990 GROUP BY node HAVING sum(o) IN (0, count(*))")
def dir_check_sources(spark, sf):
    links = _links(spark, sf)
    return op.bad_nodes(links, _nodes(links, "node < 20 OR node > 990")).select("node", "kind")


@register("dir_width_guess", fx.with_("series") + ", px AS (SELECT series_id AS link_id, seq, 2 + seq % 4 + series_id % 3 * (seq % 2) AS wid FROM series), w AS (SELECT link_id, min_by(wid, seq) AS a, max_by(wid, seq) AS b FROM px GROUP BY 1) SELECT link_id, CASE WHEN a >= b THEN 'first' ELSE 'last' END AS up, round(abs(a - b) / ((a + b) / 2.0) * 100, 6) AS wid_pctdiff FROM w")
def dir_width_guess(spark, sf):
    p = fx.series(spark, sf).select(F.lit(0).alias("net_id"), F.col("series_id").alias("link_id"), "seq", (2 + F.col("seq") % 4 + F.col("series_id") % 3 * (F.col("seq") % 2)).alias("wid"))
    return op.width_guesses(p).select("link_id", "up", F.round("wid_pctdiff", 6).alias("wid_pctdiff"))


@register("dir_slopes", fx.with_("series") + """, px AS (SELECT series_id AS link_id, seq, CAST(floor(y) AS INTEGER) AS r, CAST(x AS INTEGER) AS c, y * 0.5 + seq AS z FROM series), s AS (SELECT *, coalesce(sqrt(pow(c - lag(c) OVER w, 2) + pow(r - lag(r) OVER w, 2)), 0) AS step FROM px WINDOW w AS (PARTITION BY link_id ORDER BY seq)),
t AS (SELECT *, sum(step) OVER (PARTITION BY link_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS dist FROM s) SELECT link_id, round(regr_slope(z, dist), 6) AS slope FROM t GROUP BY link_id""")
def dir_slopes(spark, sf):
    p = fx.series(spark, sf).select(F.lit(0).alias("net_id"), F.col("series_id").alias("link_id"), "seq", F.floor("y").cast("int").alias("r"), F.col("x").cast("int").alias("c"), (F.col("y") * 0.5 + F.col("seq")).alias("z"))
    return op.surface_slopes(p).select("link_id", F.round("slope", 6).alias("slope"))


@register("dir_shortest")
def dir_shortest(spark, sf):
    links = _links(spark, sf)
    return op.shortest(links, _nodes(links, "node > 990")).select("node", F.round("dist", 6).alias("dist"), "pred")


@register("dir_shortest_dag", fx.with_("flow") + """, w AS (SELECT 0::BIGINT AS node, 0.0::DOUBLE AS dist, 0 AS k UNION ALL SELECT e.v, w.dist + e.w, w.k + 1 FROM w JOIN e ON e.u = w.node WHERE w.k < 3) SELECT node, round(min(dist), 6) AS dist FROM w GROUP BY node""")
def dir_shortest_dag(spark, sf):
    e = fx.flow_edges(spark, sf).withColumn("net_id", F.lit(0).cast("long"))
    start = e.where("u = 0").select("net_id", F.col("u").alias("node")).distinct()
    return op.shortest(e, start, "w", directed=True).select("node", F.round("dist", 6).alias("dist"))


@register("dir_shortest_guesses")
def dir_shortest_guesses(spark, sf):
    links = _links(spark, sf)
    return op.shortest_path_guesses(links, _nodes(links, "node > 990")).select("link_id", "us")


@register("dir_main_channel_cost", _L + " SELECT link_id, round((max(wid) OVER () - wid) * len, 6) AS cost FROM l")
def dir_main_channel_cost(spark, sf):
    return op.main_channel_cost(_links(spark, sf)).select("link_id", F.round("cost", 6).alias("cost"))


@register("dir_continuity")
def dir_continuity(spark, sf):
    links = _links(spark, sf)
    inlets, outlets = _nodes(links, "node < 20"), _nodes(links, "node > 990")
    facts = op.continue_flow(links, op.inlet_outlet_facts(links, inlets, outlets), inlets.unionByName(outlets))
    return op.apply_facts(links, op.parallel_facts(links, facts)).select("link_id", "u", "v", "certain", "alg")


@register("dir_hulls", """WITH pts AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS net_id, CAST(s_suppkey % 97 AS DOUBLE) AS r, CAST(floor(s_acctbal / 500) AS DOUBLE) AS c FROM supplier),
seen AS (SELECT a.net_id, a.r, a.c, b.r AS br, b.c AS bc, (b.r - a.r) * (p.c - a.c) - (b.c - a.c) * (p.r - a.r) AS side, (b.r - a.r) * (p.r - a.r) + (b.c - a.c) * (p.c - a.c) AS ahead
  FROM pts a JOIN pts b ON a.net_id = b.net_id AND (a.r, a.c) <> (b.r, b.c) JOIN pts p ON p.net_id = a.net_id),
sides AS (SELECT net_id, r, c FROM seen GROUP BY net_id, r, c, br, bc HAVING min(side) >= 0 AND count(*) FILTER (WHERE side = 0 AND ahead < 0) = 0)
SELECT DISTINCT net_id, r, c FROM sides UNION SELECT net_id, min(r), min(c) FROM pts GROUP BY net_id HAVING count(*) = 1""")
def dir_hulls(spark, sf):
    s = fx.table(spark, sf, "supplier")
    points = s.select(F.col("s_nationkey").cast("long").alias("net_id"), (F.col("s_suppkey") % 97).alias("r"), F.floor(F.col("s_acctbal") / 500).alias("c"))
    return op.hulls(points).select("net_id", "r", "c")


@register("dir_synthetic_surface", fx.with_("cells", "pixels", "images") + """ SELECT image_id, r, c, round(sqrt(pow(nrows - 1 - r, 2) + pow(c, 2)) / sqrt(pow(nrows - 1, 2) + pow(ncols - 1, 2)) + 1 - coalesce(r / nullif(nrows - 1, 0), 0), 6) AS z FROM pixels JOIN images USING (image_id)""")
def dir_synthetic_surface(spark, sf):
    """Inlets at both ends of the upper row, the outlet in the lower left corner."""
    im, net = fx.images(spark, sf), F.col("image_id").alias("net_id")
    high = im.select(net, F.lit(0).alias("r"), F.explode(F.array(F.lit(0), F.col("ncols") - 1)).alias("c"))
    low = im.select(net, (F.col("nrows") - 1).alias("r"), F.lit(0).alias("c"))
    px = fx.pixels(spark, sf).withColumnRenamed("image_id", "net_id")
    return op.synthetic_surface(px, im, high, low).select(F.col("net_id").alias("image_id"), "r", "c", F.round("z", 6).alias("z"))


@register("dir_cycle_flips", fx.with_("rings") + """ SELECT CAST(net_id AS BIGINT) AS net_id, CAST(link_id AS BIGINT) AS link_id, CAST(CASE WHEN NOT whole OR link_id > 5 THEN u WHEN link_id < b THEN link_id ELSE (link_id + 1) % 6 END AS BIGINT) AS u,
CAST(CASE WHEN NOT whole OR link_id > 5 THEN v WHEN link_id < b THEN link_id + 1 ELSE link_id END AS BIGINT) AS v FROM rings JOIN ringed USING (net_id)""")
def dir_cycle_flips(spark, sf):
    links = stored(fx.rings(spark, sf))
    return lk.flip(links, op.cycle_flips(links, links.select("net_id", F.col("u").alias("node")).limit(0)).where("fixed"))


@register("dir_bridges")
def dir_bridges(spark, sf):
    return op.bridges(_links(spark, sf)).select("link_id")


@register("dir_bridge_facts")
def dir_bridge_facts(spark, sf):
    links = _links(spark, sf)
    return op.bridge_facts(links, _nodes(links, "node < 20"), _nodes(links, "node > 990")).select("link_id", "us", "alg")


@register("dir_known_angles")
def dir_known_angles(spark, sf):
    links = _links(spark, sf)
    vectors = links.select("net_id", "link_id", (F.col("v") * 37 % 101 - F.col("u") * 37 % 101).cast("double").alias("dx"), (F.col("v") * 53 % 89 - F.col("u") * 53 % 89).cast("double").alias("dy"))
    facts = op.inlet_outlet_facts(links, _nodes(links, "node < 20"), _nodes(links, "node > 990"))
    return op.known_angle_facts(links, vectors, facts, [k / 10 for k in range(1, 21)]).select("link_id", "us", "alg")


@register("dir_cycles")
def dir_cycles(spark, sf):
    return op.cycles(_links(spark, sf)).select("cycle", "link_id")


@register("dir_repaired")
def dir_repaired(spark, sf):
    links = _links(spark, sf)
    return op.repaired(links, _nodes(links, "node < 20 OR node > 990")).select("link_id", "u", "v")


@register("manual_dirs", _L + ", m AS (SELECT link_id, CASE WHEN link_id % 2 = 0 THEN v ELSE u + link_id % 4 END AS usnode FROM l) SELECT link_id, usnode AS us, -1.0::DOUBLE AS alg FROM m JOIN l USING (link_id) WHERE usnode IN (u, v)")
def manual_dirs(spark, sf):
    links = _links(spark, sf)
    rows = links.select("net_id", "link_id", F.when(F.col("link_id") % 2 == 0, F.col("v")).otherwise(F.col("u") + F.col("link_id") % 4).alias("usnode"))
    return op.manual_facts(links, rows).select("link_id", "us", "alg")


_SEG = fx.with_("series") + ", seg AS (SELECT series_id AS id, seq AS seg, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM series WINDOW w AS (PARTITION BY series_id ORDER BY seq)), ls AS (SELECT * FROM seg WHERE x2 IS NOT NULL), tr AS (SELECT k AS id, 0 AS seg, 2.37 + k * 0.9 AS x1, -3.0 AS y1, 2.11 + k AS x2, 120.5 AS y2 FROM range(30) t(k))"
_HIT = """, c AS (SELECT *, CAST((x2 - x1) * (by2 - by1) - (y2 - y1) * (bx2 - bx1) AS DOUBLE) AS det FROM tr CROSS JOIN (SELECT id AS b_id, seg AS b_seg, x1 AS bx1, y1 AS by1, x2 AS bx2, y2 AS by2 FROM ls)),
h AS (SELECT id, b_id, b_seg, x1 + t * (x2 - x1) AS x, y1 + t * (y2 - y1) AS y FROM (SELECT *, ((bx1 - x1) * (by2 - by1) - (by1 - y1) * (bx2 - bx1)) / nullif(det, 0) AS t, ((bx1 - x1) * (y2 - y1) - (by1 - y1) * (x2 - x1)) / nullif(det, 0) AS u FROM c) WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1)"""


def _crossed(spark, sf):
    """Transects and lines; the transects' places are decimals, as in SQL, so that their sums and differences are exact."""
    lines = spatial.segments(fx.series(spark, sf))
    transects = spark.range(30).selectExpr("id", "0 AS seg", "2.37 + id * 0.9 AS x1", "-3.0 AS y1", "2.11 + id AS x2", "120.5 AS y2")
    return transects, lines


def _places(*columns):
    """Columns rounded to 5 digits as SQL does: the scaled value, not its decimal text, is rounded."""
    return [(F.round(F.col(c) * 1e5) / 1e5).alias(c) for c in columns]


@register("transect_crossings", _SEG + _HIT + " SELECT id AS transect, b_id AS link_id, b_seg AS seg, round(x, 5) AS x, round(y, 5) AS y FROM h")
def transect_crossings(spark, sf):
    t, lines = _crossed(spark, sf)
    return spatial.crossings(t, lines, 8.0).select(F.col("a_id").alias("transect"), F.col("b_id").alias("link_id"), F.col("b_seg").alias("seg"), *_places("x", "y"))


@register("transect_bi", _SEG + _HIT + ", d AS (SELECT DISTINCT id, b_id, 10.0 + b_id % 7 AS wid FROM h), p AS (SELECT *, wid / sum(wid) OVER (PARTITION BY id) AS p FROM d), e AS (SELECT id, count(*) AS bi, pow(2, -sum(p * log2(p))) AS ebi FROM p GROUP BY id) SELECT tr.id AS transect, coalesce(bi, 0) AS bi, round(coalesce(ebi, 0), 6) AS ebi FROM tr LEFT JOIN e USING (id)")
def transect_bi(spark, sf):
    t, lines = _crossed(spark, sf)
    widths = lines.select("id").distinct().withColumn("wid", F.lit(10.0) + F.col("id") % 7)
    return spatial.braiding(t, lines, widths, 8.0).withColumn("ebi", F.round("ebi", 6))


@register("clip_shoreline", _SEG + _HIT + ", k AS (SELECT id, b_id, b_seg, x, y, row_number() OVER (PARTITION BY b_id ORDER BY b_seg, (x - s.x1) * (x - s.x1) + (y - s.y1) * (y - s.y1)) AS k FROM h JOIN (SELECT id AS b_id, seg AS b_seg, x1, y1 FROM ls) s USING (b_id, b_seg) WHERE id = 12) SELECT b_id AS id, b_seg AS seg, round(x, 5) AS x, round(y, 5) AS y FROM k WHERE k = 1")
def clip_shoreline(spark, sf):
    t, lines = _crossed(spark, sf)
    return spatial.clip_links(lines, t.where("id = 12"), 8.0).select("id", "seg", *_places("x", "y"))


@register("points_in_cells", fx.with_("points") + ", cells AS (SELECT k AS cell_id, k * 10 + 0.5 AS xa, k * 10 + 10.5 AS xb FROM range(10) t(k)) SELECT node_id AS point_id, cell_id FROM points, cells WHERE x > xa AND x < xb AND y > 100.25 AND y < 5000.75")
def points_in_cells(spark, sf):
    pts = fx.points(spark, sf).withColumnRenamed("node_id", "point_id")
    c = spark.range(10).select(F.col("id").alias("cell_id"), (F.col("id") * 10 + 0.5).alias("a"), (F.col("id") * 10 + 10.5).alias("b"))
    edge = lambda x1, y1, x2, y2: F.struct(x1.alias("x1"), F.lit(y1).alias("y1"), x2.alias("x2"), F.lit(y2).alias("y2"))
    a, b = F.col("a"), F.col("b")
    ring = F.array(edge(a, 100.25, b, 100.25), edge(b, 100.25, b, 5000.75), edge(b, 5000.75, a, 5000.75), edge(a, 5000.75, a, 100.25))
    return spatial.in_cells(pts, c.select("cell_id", F.explode(ring).alias("e")).select("cell_id", "e.*"), 500.0)


@register("interpolate", fx.with_("series") + """, kn AS (SELECT series_id, CAST(seq AS DOUBLE) AS s, y AS v FROM series WHERE seq % 5 = 2), ask AS (SELECT series_id, seq + 0.5 AS s FROM series),
p AS (SELECT ask.series_id, ask.s, max(kn.s) FILTER (WHERE kn.s <= ask.s) AS a, min(kn.s) FILTER (WHERE kn.s >= ask.s) AS b FROM ask JOIN kn USING (series_id) GROUP BY ALL)
SELECT p.series_id, CAST(p.s AS DOUBLE) AS s, round(coalesce(ka.v + (p.s - p.a) * (kb.v - ka.v) / nullif(p.b - p.a, 0), ka.v, kb.v), 6) AS v FROM p LEFT JOIN kn ka ON ka.series_id = p.series_id AND ka.s = p.a LEFT JOIN kn kb ON kb.series_id = p.series_id AND kb.s = p.b""")
def interpolate(spark, sf):
    s = fx.series(spark, sf)
    known = s.where("seq % 5 = 2").select("series_id", F.col("seq").cast("double").alias("s"), F.col("y").alias("v"))
    return spatial.interpolated(s.select("series_id", (F.col("seq") + 0.5).cast("double").alias("s")), known).withColumn("v", F.round("v", 6))


@register("migration_rates")
def migration_rates(spark, sf):
    t, lines = _crossed(spark, sf)
    return spatial.migration(t, lines, spatial.following(lines), 5.0, 8.0).select("line1", "line2", "matcher", F.round("s", 5).alias("s"), F.round("rate", 6).alias("rate"))


@register("line_wkt", fx.with_("series") + " SELECT series_id, count(*) AS n FROM series GROUP BY series_id")
def line_wkt(spark, sf):
    return spatial.wkt_line(fx.series(spark, sf)).select("series_id", F.size(F.split("wkt", ",")).cast("long").alias("n"))


@register("dir_algorithms", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in op.ALGORITHMS.items()) + ") AS t(name, alg)")
def dir_algorithms(spark, sf):
    return spark.createDataFrame([(k, op.algorithm(k)) for k in op.ALGORITHMS], "name string, alg double")


@register("path_links", fx.with_("links") + ", k AS (SELECT least(u, v) AS a, greatest(u, v) AS b, min(link_id) AS link_id FROM links GROUP BY ALL) SELECT l.link_id AS path_id, 0 AS seq, k.link_id FROM links l JOIN k ON k.a = least(l.u, l.v) AND k.b = greatest(l.u, l.v)")
def path_links(spark, sf):
    """Each link's two ends as a path: it takes the least of parallel links."""
    links = fx.multigraph(spark, sf).withColumn("net_id", F.lit(0).cast("long"))
    paths = links.select("net_id", F.col("link_id").alias("path_id"), F.posexplode(F.array("u", "v")).alias("seq", "node"))
    return op.path_links(paths, links).select("path_id", "seq", "link_id")


@register("dir_main_channel_guesses")
def dir_main_channel_guesses(spark, sf):
    links = fx.multigraph(spark, sf).withColumn("net_id", F.lit(0).cast("long"))
    ends = lk.degrees(links).select("net_id", "node")
    return op.main_channel_guesses(links, ends.where("node % 8 = 1"), ends.where("node % 8 = 5")).select("link_id", "us", "alg")
