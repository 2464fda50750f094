"""Joins by place: crossing segments, points in cells, and what is counted over them.

Things near each other meet in the squares of a grid (an equi-join), and the exact test follows; a pair that meets in
several squares is kept where its common box begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(lines: DataFrame, key: str = "series_id") -> DataFrame:
    """id, seg, x1, y1, x2, y2 of consecutive vertices."""
    w = Window.partitionBy(key).orderBy("seq")
    out = lines.select(F.col(key).alias("id"), F.col("seq").alias("seg"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    return out.where("x2 IS NOT NULL")


def _boxed(segs: DataFrame, side: float, name: str) -> DataFrame:
    square = lambda f, c: F.floor(f(f"{c}1", f"{c}2") / side)
    named = segs.select(*[F.col(c).alias(f"{name}_{c}") for c in ("id", "seg", "x1", "y1", "x2", "y2")], square(F.least, "x").alias(f"{name}_gx"), square(F.least, "y").alias(f"{name}_gy"), square(F.greatest, "x").alias("hx"), square(F.greatest, "y").alias("hy"))
    many = named.withColumn("gx", F.explode(F.sequence(f"{name}_gx", "hx"))).withColumn("gy", F.explode(F.sequence(f"{name}_gy", "hy")))
    return many.drop("hx", "hy")


def crossings(a: DataFrame, b: DataFrame, side: float) -> DataFrame:
    """a_id, a_seg, b_id, b_seg, x, y, t of every crossing (t: its place along a's segment, 0 to 1); side: of the grid's squares, near a usual segment's length."""
    near = _boxed(a, side, "a").join(_boxed(b, side, "b"), ["gx", "gy"])
    near = near.where((F.col("gx") == F.greatest("a_gx", "b_gx")) & (F.col("gy") == F.greatest("a_gy", "b_gy")))
    c = F.col
    dxa, dya, dxb, dyb = c("a_x2") - c("a_x1"), c("a_y2") - c("a_y1"), c("b_x2") - c("b_x1"), c("b_y2") - c("b_y1")
    det = dxa * dyb - dya * dxb
    det = F.when(det != 0, det)
    ox, oy = c("b_x1") - c("a_x1"), c("b_y1") - c("a_y1")
    near = near.withColumns({"t": (ox * dyb - oy * dxb) / det, "u": (ox * dya - oy * dxa) / det}).where("t >= 0 AND t <= 1 AND u >= 0 AND u <= 1")
    return near.select("a_id", "a_seg", "b_id", "b_seg", (c("a_x1") + c("t") * dxa).alias("x"), (c("a_y1") + c("t") * dya).alias("y"), "t")


def braiding(transects: DataFrame, links: DataFrame, widths: DataFrame, side: float) -> DataFrame:
    """transect, bi (links that cross it) and ebi (two to the entropy of their widths): transects and links as segments, widths (id, wid).

    A transect that nothing crosses has 0. Equal widths are summed as one, so that many links don't add up errors.
    """
    hit = crossings(transects, links, side).select(F.col("a_id").alias("transect"), F.col("b_id").alias("id")).distinct().join(widths, "id")
    sizes = hit.groupBy("transect", "wid").agg(F.count("*").alias("n"))
    p = sizes.where("wid > 0").withColumn("p", F.col("wid") / F.sum(F.col("n") * F.col("wid")).over(Window.partitionBy("transect")))
    e = p.groupBy("transect").agg(F.pow(F.lit(2.0), -F.sum(F.col("n") * F.col("p") * F.log2("p"))).alias("ebi"))
    n = sizes.groupBy("transect").agg(F.sum("n").alias("bi"))
    every = transects.select(F.col("id").alias("transect")).distinct()
    return every.join(n, "transect", "left").join(e, "transect", "left").select("transect", F.coalesce("bi", F.lit(0)).cast("long").alias("bi"), F.coalesce("ebi", F.lit(0.0)).alias("ebi"))


def clip_links(link_segments: DataFrame, shoreline: DataFrame, side: float) -> DataFrame:
    """id, seg, t, x, y of the first crossing of each link with the shoreline: where it is cut and gets an outlet."""
    hit = crossings(link_segments, shoreline, side)
    first = hit.groupBy("a_id").agg(F.min(F.struct("a_seg", "t", "x", "y")).alias("f"))
    return first.select(F.col("a_id").alias("id"), F.col("f.a_seg").alias("seg"), "f.t", "f.x", "f.y")


def in_cells(points: DataFrame, edges: DataFrame, side: float) -> DataFrame:
    """point_id, cell_id of the polygons a point is in, from their edges (cell_id, x1, y1, x2, y2), by crossings of the way to the right.

    A point on an edge is in none of the edge's polygons. Points and edges meet in strips of y.
    """
    strip = lambda y: F.floor(y / side)
    e = edges.withColumn("strip", F.explode(F.sequence(strip(F.least("y1", "y2")), strip(F.greatest("y1", "y2")))))
    both = points.withColumn("strip", strip(F.col("y"))).join(e, "strip")
    over = (F.col("y1") <= F.col("y")) != (F.col("y2") <= F.col("y"))
    run = F.col("y2") - F.col("y1")
    at = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.when(run != 0, run)
    level = (F.col("y") >= F.least("y1", "y2")) & (F.col("y") <= F.greatest("y1", "y2"))
    beside = (F.col("x") >= F.least("x1", "x2")) & (F.col("x") <= F.greatest("x1", "x2"))
    on = level & beside & ((F.col("x") - F.col("x1")) * run == (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")))
    seen = both.select("point_id", "cell_id", on.alias("on"), F.coalesce(over & (F.col("x") < at), F.lit(False)).alias("hit")).where("on OR hit")
    hits = seen.groupBy("point_id", "cell_id").agg(F.count_if("hit").alias("n"), F.max("on").alias("on"))
    return hits.where("n % 2 = 1 AND NOT on").select("point_id", "cell_id")


def cell_of_links(found: DataFrame, links: DataFrame) -> DataFrame:
    """net_id, link_id, cldist: how many mesh cells lie between the cells of a link's ends, downstream positive; of several cells the least."""
    per = found.groupBy(F.col("point_id").alias("node")).agg(F.min("cell_id").alias("cell"))
    side = lambda c: per.select(F.col("node").alias(c), F.col("cell").alias(f"cell_{c}"))
    return links.join(side("u"), "u").join(side("v"), "v").select("net_id", "link_id", (F.col("cell_v") - F.col("cell_u")).alias("cldist"))


def interpolated(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (series_id, s) with v by linear interpolation between the known (series_id, s, v) before and after; the nearest beyond the ends."""
    both = rows.select("series_id", "s", F.lit(None).cast("double").alias("v"), F.lit(1).alias("ask")).unionByName(known.select("series_id", "s", "v", F.lit(0).alias("ask")))
    back = Window.partitionBy("series_id").orderBy("s", "ask").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("series_id").orderBy("s", F.desc("ask")).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("ask") == 0, F.struct("s", "v"))
    out = both.withColumns({"a": F.last(at, True).over(back), "b": F.first(at, True).over(ahead)}).where("ask = 1")
    gap = F.col("b.s") - F.col("a.s")
    line = F.col("a.v") + (F.col("s") - F.col("a.s")) * (F.col("b.v") - F.col("a.v")) / F.when(gap > 0, gap)
    return out.select("series_id", "s", F.coalesce(line, F.col("a.v"), F.col("b.v")).alias("v"))


def following(lines: DataFrame, bin_size: int = 1000) -> DataFrame:
    """line1, line2: each line's id with the next larger one there is."""
    ids = lines.select("id").distinct().withColumn("bin", F.floor(F.col("id") / bin_size))
    after = ids.groupBy("bin").agg(F.min("id").alias("start")).select("bin", F.lead("start").over(Window.orderBy("bin")).alias("after"))
    own = F.lead("id").over(Window.partitionBy("bin").orderBy("id"))
    return ids.join(after, "bin").select(F.col("id").alias("line1"), F.coalesce(own, "after").alias("line2")).where("line2 IS NOT NULL")


def migration(matchers: DataFrame, lines: DataFrame, pairs: DataFrame, years: float, side: float) -> DataFrame:
    """line1, line2, matcher, s (along line1) and rate: distance between where a matcher crosses the two lines (segments) of a pair (line1, line2), over the years; the first crossing of each."""
    hit = crossings(lines, matchers, side)
    size = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    before = Window.partitionBy("id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    along = lines.withColumn("_size", size).withColumn("_s", F.coalesce(F.sum("_size").over(before), F.lit(0.0))).select(F.col("id").alias("a_id"), F.col("seg").alias("a_seg"), "_s", "_size")
    own = hit.join(along, ["a_id", "a_seg"]).withColumn("s", F.col("_s") + F.col("t") * F.col("_size"))
    first = own.groupBy(F.col("a_id").alias("line"), F.col("b_id").alias("matcher")).agg(F.min(F.struct("s", "x", "y")).alias("at"))
    of = lambda line, name: first.select(F.col("line").alias(line), "matcher", F.col("at").alias(name))
    both = pairs.join(of("line1", "p"), "line1").join(of("line2", "q"), ["line2", "matcher"])
    return both.select("line1", "line2", "matcher", F.col("p.s").alias("s"), (F.hypot(F.col("p.x") - F.col("q.x"), F.col("p.y") - F.col("q.y")) / years).alias("rate"))


def wkt_line(lines: DataFrame, key: str = "series_id") -> DataFrame:
    """key and wkt of each line."""
    text = F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))
    return lines.groupBy(key).agg(text.alias("wkt"))


def pixel_square(x: Column, y: Column, pixlen: float) -> Column:
    """WKT of the square around a cell's centre."""
    h = pixlen / 2
    corner = lambda a, b: F.concat_ws(" ", (x + a).cast("string"), (y + b).cast("string"))
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[corner(a, b) for a, b in ((-h, -h), (h, -h), (h, h), (-h, h), (-h, -h))]), F.lit("))"))
