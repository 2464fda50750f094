"""Links and nodes of channel networks: tables (net_id, link_id, u, v, ...), and their pixels (net_id, link_id, seq, r, c, ...).

u is the upper end once directions are known. Edits return new tables; nodes are what links name.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thalweg.operators.regions import stored


def ends(links: DataFrame) -> DataFrame:
    """net_id, node, link_id: each link at both of its ends."""
    return links.select("net_id", "link_id", F.explode(F.array("u", "v")).alias("node"))


def degrees(links: DataFrame) -> DataFrame:
    """net_id, node, degree, link_ids (ascending); a link from a node to itself counts twice."""
    return ends(links).groupBy("net_id", "node").agg(F.count("*").alias("degree"), F.sort_array(F.collect_list("link_id")).alias("link_ids"))


def parallel(links: DataFrame) -> DataFrame:
    """net_id, a, b, link_ids of the pairs of nodes that several links join."""
    pair = links.select("net_id", "link_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    return pair.groupBy("net_id", "a", "b").agg(F.sort_array(F.collect_list("link_id")).alias("link_ids")).where(F.size("link_ids") > 1)


def flip(links: DataFrame, link_ids: DataFrame) -> DataFrame:
    """Links with the ends of those in link_ids (net_id, link_id) exchanged."""
    marked = links.join(link_ids.select("net_id", "link_id").distinct().withColumn("_flip", F.lit(True)).hint("merge"), ["net_id", "link_id"], "left")
    turned = F.col("_flip").isNotNull()
    return marked.withColumns({"u": F.when(turned, F.col("v")).otherwise(F.col("u")), "v": F.when(turned, F.col("u")).otherwise(F.col("v"))}).select(*links.columns)


def flip_pixels(pixels: DataFrame, link_ids: DataFrame) -> DataFrame:
    """Pixels of those links in reverse order."""
    marked = pixels.join(link_ids.select("net_id", "link_id").distinct().withColumn("_flip", F.lit(True)), ["net_id", "link_id"], "left")
    last = F.max("seq").over(Window.partitionBy("net_id", "link_id"))
    return marked.withColumn("seq", F.when(F.col("_flip"), last - F.col("seq")).otherwise(F.col("seq"))).select(*pixels.columns)


def delete(links: DataFrame, link_ids: DataFrame) -> DataFrame:
    return links.join(link_ids, ["net_id", "link_id"], "left_anti").select(*links.columns)


def add(links: DataFrame, more: DataFrame) -> DataFrame:
    """With the links of more (net_id, u, v, ...), which get the ids after the highest."""
    top = links.groupBy("net_id").agg(F.max("link_id").alias("_top"))
    rank = F.row_number().over(Window.partitionBy("net_id").orderBy("u", "v"))
    new = more.join(top, "net_id", "left").withColumn("link_id", F.coalesce(F.col("_top"), F.lit(-1)) + rank).drop("_top")
    return links.unionByName(new, allowMissingColumns=True)


def without_spurs(links: DataFrame, keep_nodes: DataFrame) -> DataFrame:
    """Links left when those with an end of degree 1 that isn't in keep_nodes (net_id, node), and those from a node to itself, go again and again."""
    links = stored(links.where("u <> v"))
    while True:
        loose = degrees(links).where("degree = 1").join(keep_nodes, ["net_id", "node"], "left_anti").select("net_id", F.col("link_ids")[0].alias("link_id")).distinct()
        loose = stored(loose)
        if not loose.limit(1).count():
            return links
        links = stored(delete(links, loose))


def contract(links: DataFrame, keep_nodes: DataFrame, sums: tuple[str, ...] = ("len",)) -> DataFrame:
    """Chains of links through nodes of degree 2 (not in keep_nodes) as one link each: its least id, its two ends, and sums of columns.

    A ring without any other node goes.
    """
    from thalweg.operators.regions import least_labels

    inner = degrees(links).where("degree = 2").join(keep_nodes, ["net_id", "node"], "left_anti").select("net_id", "node", "link_ids")
    pairs = inner.select(F.col("net_id").alias("g"), F.col("link_ids")[0].alias("a"), F.col("link_ids")[1].alias("b")).where("a <> b")
    both = pairs.unionByName(pairs.select("g", F.col("b").alias("a"), F.col("a").alias("b")))
    chain = least_labels(links.select(F.col("net_id").alias("g"), F.col("link_id").alias("n")), both).select(F.col("g").alias("net_id"), F.col("n").alias("link_id"), "label")
    own = links.join(chain, ["net_id", "link_id"])
    outer = own.select("net_id", "label", F.explode(F.array("u", "v")).alias("node")).join(inner.select("net_id", "node"), ["net_id", "node"], "left_anti")
    tips = outer.groupBy("net_id", "label").agg(F.sort_array(F.collect_list("node")).alias("tips")).where(F.size("tips") == 2)
    total = own.groupBy("net_id", "label").agg(F.count("*").alias("n_links"), *[F.sum(c).alias(c) for c in sums])
    return total.join(tips, ["net_id", "label"]).select("net_id", F.col("label").alias("link_id"), F.col("tips")[0].alias("u"), F.col("tips")[1].alias("v"), "n_links", *sums)


def single_pixel(pixels: DataFrame) -> DataFrame:
    """net_id, link_id of links with one pixel."""
    return pixels.groupBy("net_id", "link_id").agg(F.count("*").alias("n")).where("n = 1").select("net_id", "link_id")


def duplicates(pixels: DataFrame) -> DataFrame:
    """net_id, link_id of links whose pixels are those of a link with a smaller id."""
    sets = pixels.groupBy("net_id", "link_id").agg(F.sort_array(F.collect_set(F.struct("r", "c"))).alias("cells"))
    first = F.min("link_id").over(Window.partitionBy("net_id", "cells"))
    return sets.withColumn("first", first).where("link_id <> first").select("net_id", "link_id")


def end_pixels(pixels: DataFrame) -> DataFrame:
    """net_id, link_id, and first and last pixel."""
    cell = F.struct("r", "c")
    return pixels.groupBy("net_id", "link_id").agg(F.min_by(cell, "seq").alias("first"), F.max_by(cell, "seq").alias("last"))


def lengths(pixels: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """net_id, link_id, len: along the pixels' coordinates."""
    w = Window.partitionBy("net_id", "link_id").orderBy("seq")
    step = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    return pixels.withColumn("_d", F.coalesce(step, F.lit(0.0))).groupBy("net_id", "link_id").agg(F.sum("_d").alias("len"))


def widths_and_lengths(pixels: DataFrame, pixlen: float = 1.0) -> DataFrame:
    """Per link wid, wid_adj, wid_med, len, len_adj, sinuosity, from its pixels (r, c) and their distance d to the bank.

    A pixel is 2 d wide. The adjusted values leave out what is nearer to an end than 1.1 half-widths there; a link
    that has nothing left is taken whole. Widths and lengths are at least pixlen.
    """
    key = ("net_id", "link_id")
    line = Window.partitionBy(*key).orderBy("seq")
    whole = Window.partitionBy(*key)
    p = pixels.withColumn("wid", 2 * F.col("d") * pixlen)
    step = F.hypot(F.col("r") - F.lag("r").over(line), F.col("c") - F.lag("c").over(line)) * pixlen
    p = p.withColumn("step", F.coalesce(step.cast("double"), F.lit(0.0)))
    p = p.withColumn("dist", F.sum("step").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumns({"total": F.max("dist").over(whole), "w0": F.min_by("wid", "seq").over(whole), "w1": F.max_by("wid", "seq").over(whole), "last": F.max("seq").over(whole)})
    off0, off1 = F.abs(F.col("dist") - 1.1 * F.col("w0") / 2), F.abs(F.col("total") - F.col("dist") - 1.1 * F.col("w1") / 2)
    p = p.withColumns({"i0": F.min_by("seq", F.struct(F.round(off0, 9), "seq")).over(whole), "i1": F.min_by("seq", F.struct(F.round(off1, 9), -F.col("seq"))).over(whole)})
    p = p.withColumn("all", F.col("i0") >= F.col("i1")).withColumn("inside", F.col("all") | ((F.col("seq") >= F.col("i0")) & (F.col("seq") < F.col("i1"))))
    a, b = F.when(F.col("all"), F.lit(0)).otherwise(F.col("i0")), F.when(F.col("all"), F.col("last")).otherwise(F.col("i1"))
    at = lambda c, k: F.max(F.when(F.col("seq") == k, F.col(c)))
    own = F.when(F.col("inside"), F.col("wid"))
    g = p.withColumns({"a": a, "b": b}).groupBy(*key).agg(
        F.avg("wid").alias("wid"), F.avg(own).alias("wid_adj"), F.percentile(own, 0.5).alias("wid_med"), F.max("total").alias("len"),
        (at("dist", F.col("b")) - at("dist", F.col("a"))).alias("len_adj"),
        at("r", F.col("a")).alias("r0"), at("c", F.col("a")).alias("c0"), at("r", F.col("b")).alias("r1"), at("c", F.col("b")).alias("c1"),
    )
    chord = F.hypot(F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")) * pixlen
    floor = lambda c: F.greatest(F.col(c), F.lit(float(pixlen))).alias(c)
    return g.select(*key, floor("wid"), floor("wid_adj"), "wid_med", floor("len"), floor("len_adj"), (F.col("len_adj") / F.when(chord > 0, chord)).alias("sinuosity"))


def link_vectors(pixels: DataFrame, normalized: bool = True) -> DataFrame:
    """net_id, link_id, dx, dy from the first to the last pixel, with y up."""
    e = end_pixels(pixels)
    dx, dy = (F.col("last.c") - F.col("first.c")).cast("double"), (F.col("first.r") - F.col("last.r")).cast("double")
    size = F.when(F.hypot(dx, dy) > 0, F.hypot(dx, dy)) if normalized else F.lit(1.0)
    return e.select("net_id", "link_id", (dx / size).alias("dx"), (dy / size).alias("dy"))


def split_at_half(links: DataFrame, pixels: DataFrame) -> DataFrame:
    """net_id, link_id, seq where all but the shortest link of each parallel set is split: the vertex nearest to half its length."""
    w = Window.partitionBy("net_id", "link_id").orderBy("seq")
    step = F.coalesce(F.hypot(F.col("r") - F.lag("r").over(w), F.col("c") - F.lag("c").over(w)).cast("double"), F.lit(0.0))
    along = pixels.withColumn("_d", step).withColumn("dist", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = along.groupBy("net_id", "link_id").agg(F.max("dist").alias("total"))
    sets = parallel(links).select("net_id", "a", "b", F.explode("link_ids").alias("link_id")).join(total, ["net_id", "link_id"])
    rank = F.row_number().over(Window.partitionBy("net_id", "a", "b").orderBy("total", "link_id"))
    long = sets.withColumn("k", rank).where("k > 1").select("net_id", "link_id", "total")
    off = F.struct(F.round(F.abs(F.col("dist") - F.col("total") / 2), 9), F.col("seq"))
    return along.join(long, ["net_id", "link_id"]).groupBy("net_id", "link_id").agg(F.min_by("seq", off).alias("seq"))


def flow_raster(pixels: DataFrame) -> DataFrame:
    """net_id, r, c, v: 0 to 1 along each link; of several links at a pixel the one with the highest id, where it comes last."""
    last = pixels.groupBy("net_id", "link_id").agg(F.max("seq").alias("n"))
    at = pixels.groupBy("net_id", "r", "c").agg(F.max(F.struct("link_id", "seq")).alias("top")).select("net_id", "r", "c", "top.*")
    return at.join(last, ["net_id", "link_id"]).select("net_id", "r", "c", F.when(F.col("n") > 0, F.col("seq") / F.col("n")).otherwise(F.lit(0.0)).alias("v"))


def unpadded(pixels: DataFrame, pad: int) -> DataFrame:
    """Pixels found in an image with pad more cells on every side, by their place in the image itself."""
    return pixels.withColumns({"r": F.col("r") - pad, "c": F.col("c") - pad})


def add_nodes(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """nodes (net_id, node_id, r, c) with the pixels of more (net_id, r, c) that aren't nodes yet, by row and column under the ids after the highest."""
    top = nodes.groupBy("net_id").agg(F.max("node_id").alias("_top"))
    new = more.select("net_id", "r", "c").distinct().join(nodes, ["net_id", "r", "c"], "left_anti").join(top, "net_id", "left")
    rank = F.row_number().over(Window.partitionBy("net_id").orderBy("r", "c"))
    return nodes.unionByName(new.select("net_id", (F.coalesce("_top", F.lit(-1)) + rank).alias("node_id"), "r", "c"), allowMissingColumns=True)


def linked_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes (net_id, node_id, ...) that a link still ends at."""
    return nodes.join(ends(links).select("net_id", F.col("node").alias("node_id")).distinct(), ["net_id", "node_id"], "left_semi").select(*nodes.columns)


def nearest_nodes(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """point_id, node_id, dist of each point's nearest node (x, y); of equal distances the smaller id.

    Nodes are sorted into square bins of about one node each; a point looks at rings of bins that grow until no
    nearer node can be outside, so points and nodes are never all paired.
    """
    stats = nodes.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    none = points.select("point_id").limit(0).withColumns({"node_id": F.lit(None).cast("long"), "dist": F.lit(None).cast("double")})
    if not stats[4]:
        return none
    area = max(stats[1] - stats[0], 1e-9) * max(stats[3] - stats[2], 1e-9)
    side = max((area / stats[4]) ** 0.5, max(stats[1] - stats[0], stats[3] - stats[2]) / 1e6, 1e-9) * 1.5
    bin_of = lambda c: F.floor(F.col(c) / side)
    binned = stored(nodes.select("node_id", F.col("x").alias("nx"), F.col("y").alias("ny"), bin_of("x").alias("bx"), bin_of("y").alias("by")))
    low = [int(v // side) for v in (stats[0], stats[2])]
    high = [int(v // side) for v in (stats[1], stats[3])]
    todo = stored(points.select("point_id", "x", "y", bin_of("x").alias("px"), bin_of("y").alias("py")))
    out, reach = None, 1
    while True:
        # beyond the last ring that the nodes' box has for any point, everything was seen
        most = todo.agg(F.max(F.greatest(F.abs(F.col("px") - low[0]), F.abs(F.col("px") - high[0]), F.abs(F.col("py") - low[1]), F.abs(F.col("py") - high[1])))).first()[0]
        if most is None:
            return none if out is None else out
        k = F.lit(reach)
        span = lambda at, a, b: F.sequence(F.greatest(F.col(at) - k, F.lit(a)), F.greatest(F.least(F.col(at) + k, F.lit(b)), F.greatest(F.col(at) - k, F.lit(a))))
        near = todo.withColumn("bx", F.explode(span("px", low[0], high[0]))).withColumn("by", F.explode(span("py", low[1], high[1]))).join(binned, ["bx", "by"])
        d = F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny"))
        best = near.groupBy("point_id").agg(F.min(F.struct(d.alias("dist"), F.col("node_id"))).alias("b")).select("point_id", "b.node_id", "b.dist")
        best = stored(best)
        sure = best if reach > most else best.where(F.col("dist") <= side * reach)
        sure = stored(sure)
        out = sure if out is None else out.unionByName(sure)
        todo = stored(todo.join(sure, "point_id", "left_anti"))
        reach *= 4


def widest_inlet(links: DataFrame, inlets: DataFrame, wid: str = "wid") -> DataFrame:
    """net_id, node: the inlet whose links are widest in sum; of equals the smaller."""
    total = ends(links).join(links.select("net_id", "link_id", wid), ["net_id", "link_id"]).join(inlets, ["net_id", "node"], "left_semi").groupBy("net_id", "node").agg(F.sum(wid).alias("w"))
    return total.groupBy("net_id").agg(F.max_by("node", F.struct("w", -F.col("node"))).alias("node"))


def wide_inlets(links: DataFrame, inlets: DataFrame, wid: str = "wid", share: float = 0.25) -> DataFrame:
    """net_id, node: inlets whose link (of several the one of least id) is less than that share narrower than the network's widest."""
    own = ends(links).join(inlets.select("net_id", "node").distinct(), ["net_id", "node"], "left_semi").join(links.select("net_id", "link_id", wid), ["net_id", "link_id"])
    own = own.groupBy("net_id", "node").agg(F.min_by(wid, "link_id").alias("w"))
    top = own.groupBy("net_id").agg(F.max("w").alias("_top"))
    return own.join(top, "net_id").where((F.col("w") > F.col("_top") * (1 - share)) | (F.col("w") == F.col("_top"))).select("net_id", "node")


def distance_from_apex(nodes: DataFrame, inlets: DataFrame) -> DataFrame:
    """net_id, node_id, dist: from the mean place of the inlets, relative to the greatest."""
    apex = nodes.join(inlets, ["net_id", "node_id"], "left_semi").groupBy("net_id").agg(F.avg("x").alias("ax"), F.avg("y").alias("ay"))
    d = nodes.join(apex, "net_id").withColumn("d", F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay")))
    return d.select("net_id", "node_id", (F.col("d") / F.max("d").over(Window.partitionBy("net_id"))).alias("dist"))


def junction_types(links: DataFrame, wid: str = "wid") -> DataFrame:
    """net_id, node, jtype ('b' one in and two out, 'c' two in and one out, else null) and width_ratio (wider over narrower of the two) at nodes with three links."""
    both = links.select("net_id", F.explode(F.array(F.struct(F.col("u").alias("node"), F.col(wid).alias("out"), F.lit(None).cast("double").alias("in")), F.struct(F.col("v").alias("node"), F.lit(None).cast("double").alias("out"), F.col(wid).alias("in")))).alias("e"))
    g = both.groupBy("net_id", "e.node").agg(F.count("e.out").alias("n_out"), F.count("e.in").alias("n_in"), F.max("e.out").alias("max_out"), F.min("e.out").alias("min_out"), F.max("e.in").alias("max_in"), F.min("e.in").alias("min_in"))
    kind = F.when((F.col("n_in") == 1) & (F.col("n_out") == 2), "b").when((F.col("n_in") == 2) & (F.col("n_out") == 1), "c")
    ratio = F.when(kind == "b", F.col("max_out") / F.col("min_out")).when(kind == "c", F.col("max_in") / F.col("min_in"))
    return g.where("n_in + n_out = 3").select("net_id", "node", kind.alias("jtype"), ratio.alias("width_ratio"))


def split_ratios(links: DataFrame, inlets: DataFrame, wid: str = "wid") -> DataFrame:
    """net_id, node, qr: wider over narrower of the two links that leave a node of three links, or an inlet of two."""
    out = links.groupBy("net_id", F.col("u").alias("node")).agg(F.count("*").alias("n_out"), (F.max(wid) / F.min(wid)).alias("qr")).where("n_out = 2")
    marked = degrees(links).join(inlets.select("net_id", "node").distinct().withColumn("_inlet", F.lit(True)), ["net_id", "node"], "left")
    fit = marked.where("degree = 3 OR (degree = 2 AND _inlet)").select("net_id", "node")
    return out.join(fit, ["net_id", "node"], "left_semi").select("net_id", "node", "qr")


def add_super_apex(links: DataFrame, inlets: DataFrame, wid: str = "wid") -> DataFrame:
    """With a link of no length from a new node (one below the least id) to each inlet, as wide as the inlet's links together."""
    apex = ends(links).groupBy("net_id").agg((F.min("node") - 1).alias("u"), F.max("link_id").alias("top"))
    total = ends(links).join(links.select("net_id", "link_id", wid), ["net_id", "link_id"]).join(inlets, ["net_id", "node"], "left_semi").groupBy("net_id", "node").agg(F.sum(wid).alias(wid))
    rank = F.row_number().over(Window.partitionBy("net_id").orderBy("node"))
    new = total.join(apex, "net_id").select("net_id", (F.col("top") + rank).alias("link_id"), "u", F.col("node").alias("v"), wid, F.lit(0.0).alias("len"))
    return links.unionByName(new, allowMissingColumns=True)


def super_apex(links: DataFrame) -> DataFrame:
    """net_id, node: the node that add_super_apex adds to links."""
    return ends(links).groupBy("net_id").agg((F.min("node") - 1).alias("node"))


def delete_super_apex(links: DataFrame, apex: DataFrame) -> DataFrame:
    """Without what add_super_apex added: the links from apex (net_id, node), as super_apex told before."""
    return links.join(apex.select("net_id", F.col("node").alias("u")), ["net_id", "u"], "left_anti").select(*links.columns)


def single_inlet(links: DataFrame, inlets: DataFrame, outlets: DataFrame, wid: str = "wid") -> DataFrame:
    """The links below the widest inlet of each network: what its water can reach, without the spurs that leaves."""
    from thalweg.operators.delta_metrics import hops

    start = widest_inlet(links, inlets, wid)
    wet = hops(links.select("net_id", "u", "v").distinct(), start)
    own = links.join(wet.select("net_id", F.col("node").alias("u")), ["net_id", "u"], "left_semi").select(*links.columns)
    return without_spurs(own, start.unionByName(outlets).distinct())


def angle_between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees in [0, 180] between two vectors."""
    turn = F.pmod(F.degrees(F.atan2(ay, ax) - F.atan2(by, bx)), F.lit(360.0))
    return F.least(turn, 360 - turn)


def junction_angles(links: DataFrame, vectors: DataFrame, wid: str = "wid") -> DataFrame:
    """net_id, node, int_ang: at bifurcations between the two links out, at confluences between the two in, from their vectors (dx, dy downstream)."""
    kinds = junction_types(links, wid).where("jtype IS NOT NULL")
    v = links.join(vectors, ["net_id", "link_id"])
    out = kinds.where("jtype = 'b'").join(v, (kinds.net_id == v.net_id) & (kinds.node == v.u)).select(kinds.net_id, "node", "link_id", "dx", "dy")
    into = kinds.where("jtype = 'c'").join(v, (kinds.net_id == v.net_id) & (kinds.node == v.v)).select(kinds.net_id, "node", "link_id", (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"))
    two = out.unionByName(into).groupBy("net_id", "node").agg(F.sort_array(F.collect_list(F.struct("link_id", "dx", "dy"))).alias("l"))
    a, b = F.col("l")[0], F.col("l")[1]
    return two.select("net_id", "node", angle_between(a["dx"], a["dy"], b["dx"], b["dy"]).alias("int_ang"))


def merged(lists: DataFrame) -> DataFrame:
    """list_id, item rows with label: lists that share an item, directly or through others, have one label (the least list_id)."""
    from thalweg.operators.regions import least_labels

    first = F.min("list_id").over(Window.partitionBy("item"))
    pairs = lists.select(F.lit(0).alias("g"), F.col("list_id").alias("a"), first.alias("b")).where("a <> b").distinct()
    both = pairs.unionByName(pairs.select("g", F.col("b").alias("a"), F.col("a").alias("b")))
    labels = least_labels(lists.select(F.lit(0).alias("g"), F.col("list_id").alias("n")).distinct(), both)
    return lists.join(labels.select(F.col("n").alias("list_id"), "label"), "list_id")


