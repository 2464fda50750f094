"""Facades: a raster's way to a directed network and its metrics, a stage after the other, every stage made once and kept as a table."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.functions.geo import cell_centre
from thalweg.operators import delta_metrics, directions, links, mesh, raster, regions, series, skeleton
from thalweg.operators.regions import stored
from thalweg.sources import geo


class StageMissing(RuntimeError):
    """A stage that must come first hasn't been made."""


class Network:
    """Images (image_id, nrows, ncols, gt, pixlen) with their on-pixels (image_id, r, c); every image is a network of its own (net_id = image_id)."""

    def __init__(self, pixels: DataFrame, images: DataFrame, pixlen: float = 1.0) -> None:
        self.pixels, self.images, self.pixlen = pixels.select(*raster.PIXEL), images, float(pixlen)
        self.inlets: DataFrame | None = None
        self.outlets: DataFrame | None = None

    @cached_property
    def skeleton(self) -> DataFrame:
        return stored(skeleton.skeletonize(self.pixels))

    @cached_property
    def distances(self) -> DataFrame:
        return stored(regions.distances(self.pixels, self.images))

    @cached_property
    def link_pixels(self) -> DataFrame:
        """net_id, link_id, u, v, seq, r, c, d."""
        own = skeleton.skeleton_links(self.skeleton).join(self.distances, list(raster.PIXEL), "left")
        return stored(own.withColumnRenamed("image_id", "net_id").withColumn("d", F.coalesce("d", F.lit(0.0))))

    @cached_property
    def nodes(self) -> DataFrame:
        found = skeleton.skeleton_nodes(self.skeleton).join(self.images.select("image_id", "gt"), "image_id")
        x, y = cell_centre("r", "c", F.col("gt"))
        return stored(found.select(F.col("image_id").alias("net_id"), "node_id", "r", "c", "pixels", x.alias("x"), y.alias("y")))

    @cached_property
    def measured(self) -> DataFrame:
        """net_id, link_id, u, v with widths, lengths and sinuosity."""
        size = links.widths_and_lengths(self.link_pixels.select("net_id", "link_id", "seq", "r", "c", "d"), self.pixlen)
        return stored(self.link_pixels.select("net_id", "link_id", "u", "v").distinct().join(size, ["net_id", "link_id"]))

    @cached_property
    def islands(self) -> DataFrame:
        return stored(regions.islands(self.pixels, self.images, self.pixlen))

    def ends_by_points(self, inlets: DataFrame, outlets: DataFrame) -> None:
        """Inlets and outlets as the nodes nearest to points (point_id, x, y)."""
        self.inlets, self.outlets = (stored(links.nearest_nodes(p, self.nodes).join(self.nodes, "node_id").select("net_id", F.col("node_id").alias("node")).distinct()) for p in (inlets, outlets))

    def ends_by_sides(self, sides: str) -> None:
        """Inlets at the first of the two sides (of n, e, s, w) and outlets at the second: the nodes on the skeleton's extreme row or column."""
        if len(sides) != 2 or not set(sides.lower()) <= set("nesw"):
            raise ValueError("sides are two of n, e, s and w")
        box = self.skeleton.groupBy(F.col("image_id").alias("net_id")).agg(F.min("r").alias("n"), F.max("r").alias("s"), F.min("c").alias("w"), F.max("c").alias("e"))
        at = self.nodes.join(box, "net_id")
        pick = lambda side: stored(at.where(F.col("r" if side in "ns" else "c") == F.col(side)).select("net_id", F.col("node_id").alias("node")))
        self.inlets, self.outlets = pick(sides[0].lower()), pick(sides[1].lower())

    def _ends(self) -> tuple[DataFrame, DataFrame]:
        if self.inlets is None or self.outlets is None:
            raise StageMissing("inlets and outlets come first: ends_by_points() or ends_by_sides()")
        return self.inlets, self.outlets

    @cached_property
    def pruned(self) -> DataFrame:
        """Links without spurs that lead neither from an inlet nor to an outlet."""
        ins, outs = self._ends()
        return stored(links.without_spurs(self.measured, ins.unionByName(outs).distinct()))

    def _guesses(self) -> DataFrame:
        """The recipe's facts, the surest first: inlets and outlets, bridges, continuity."""
        ins, outs = self._ends()
        net = self.pruned
        facts = directions.inlet_outlet_facts(net, ins, outs)
        more = directions.bridge_facts(net, ins, outs).join(facts.select("net_id", "link_id"), ["net_id", "link_id"], "left_anti")
        return directions.continue_flow(net, facts.unionByName(more), ins.unionByName(outs))

    def _facts(self, facts: DataFrame, vectors: DataFrame) -> DataFrame:
        """Facts for the rest of the links: by angles from known ones, then by distance to outlets."""
        facts = stored(directions.known_angle_facts(self.pruned, vectors, facts, [k / 10 for k in range(1, 21)]))
        rest = directions.shortest_path_guesses(self.pruned, self._ends()[1]).join(facts.select("net_id", "link_id"), ["net_id", "link_id"], "left_anti")
        return facts.unionByName(rest.withColumn("alg", F.lit(directions.algorithm("sp_links"))))

    @cached_property
    def directed(self) -> DataFrame:
        """Links with u the upper end: the surest facts, the recipe for the rest, and repair of bad nodes and cycles."""
        ins, outs = self._ends()
        net = self.pruned
        vectors = links.link_vectors(self.link_pixels)
        facts = stored(self._facts(stored(directions.parallel_facts(net, self._guesses())), vectors))
        ends = ins.unionByName(outs)
        flow = stored(directions.repaired(directions.apply_facts(net, facts), ends))
        if not directions.cycles(flow).limit(1).count():
            return flow
        # cycles: set again by angles what isn't sure, then the fewest flips
        was = flow.select("net_id", "link_id", "u").join(facts.select("net_id", "link_id", "us", "alg"), ["net_id", "link_id"], "left")
        alg = F.when(F.col("us") == F.col("u"), F.col("alg")).otherwise(F.lit(directions.algorithm("sourcesinkfix")))
        facts = directions.reset_cycles(net, vectors, stored(was.select("net_id", "link_id", F.col("u").alias("us"), alg.alias("alg"))))
        flow = stored(directions.repaired(directions.apply_facts(net, facts), ends))
        manual = facts.where(F.col("alg") == directions.algorithm("manual_set"))
        flips = directions.cycle_flips(flow, ends, manual).where("fixed")
        return stored(links.flip(flow, flips))

    @cached_property
    def cycles(self) -> DataFrame:
        """net_id, cycle, link_id of the cycles that couldn't be repaired."""
        return stored(directions.cycles(self.directed))

    @cached_property
    def junctions(self) -> DataFrame:
        vectors = links.link_vectors(self.link_pixels)
        flow = self.directed.join(self.pruned.select("net_id", "link_id", F.col("u").alias("_u")), ["net_id", "link_id"]).join(vectors, ["net_id", "link_id"])
        turned = flow.select("net_id", "link_id", *[F.when(F.col("u") == F.col("_u"), F.col(c)).otherwise(-F.col(c)).alias(c) for c in ("dx", "dy")])
        kinds = links.junction_types(self.directed, "wid_adj")
        return stored(kinds.join(links.junction_angles(self.directed, turned, "wid_adj"), ["net_id", "node"], "left"))

    def adjacency(self, weight: str = "wid_adj") -> DataFrame:
        return delta_metrics.adjacency(delta_metrics.graph(self.directed, weight))

    def features(self) -> dict[str, DataFrame]:
        """GeoJSON features of links and nodes."""
        xy = self.link_pixels.join(self.images.select(F.col("image_id").alias("net_id"), "gt"), "net_id")
        x, y = cell_centre("r", "c", F.col("gt"))
        key = F.struct("net_id", "link_id")
        lines = xy.select(key.alias("key"), "seq", x.alias("x"), y.alias("y"))
        return {"links": geo.line_features(lines, "key", self.measured.withColumn("key", key).drop("net_id", "link_id")), "nodes": geo.point_features(self.nodes)}

    def save(self, path: str) -> None:
        geo.write_network({"links": self.measured, "nodes": self.nodes, "link_pixels": self.link_pixels}, path)


class Delta(Network):
    """A network from inlets to the sea."""

    def _facts(self, facts: DataFrame, vectors: DataFrame) -> DataFrame:
        """The delta's recipe, with guesses by the main channel, a surface from inlets down to outlets, and shortest paths."""
        ins, outs = self._ends()
        net = self.pruned
        at = self.nodes.select("net_id", F.col("node_id").alias("node"), "r", "c")
        wide = links.wide_inlets(net, ins, "wid_adj")
        pixels = self.link_pixels.join(net.select("net_id", "link_id"), ["net_id", "link_id"], "left_semi").select("net_id", "link_id", "seq", "r", "c")
        surface = directions.synthetic_surface(pixels, self.images, *(at.join(x.select("net_id", "node").distinct(), ["net_id", "node"], "left_semi") for x in (wide, outs)))
        slopes = stored(directions.surface_slopes(surface))
        shortest = directions.shortest_path_guesses(net, outs).withColumn("alg", F.lit(directions.algorithm("sp_links")))
        main = directions.main_channel_guesses(net.withColumn("wid", F.col("wid_adj")), ins, outs)
        guesses = main.unionByName(shortest).unionByName(directions.surface_guesses(net, slopes))
        return directions.delta_facts(net, vectors, facts, guesses, slopes)

    def metrics(self, weight: str = "wid_adj") -> dict[str, DataFrame]:
        if self.cycles.limit(1).count():
            raise delta_metrics.CyclicNetwork("links flow in a cycle")
        return delta_metrics.metrics(delta_metrics.graph(self.directed, weight))


class River(Network):
    """A channel belt between two sides of its image."""

    def __init__(self, pixels: DataFrame, images: DataFrame, sides: str, pixlen: float = 1.0) -> None:
        super().__init__(pixels, images, pixlen)
        self.ends_by_sides(sides)

    @cached_property
    def centerline(self) -> DataFrame:
        """series_id (the image), seq, x, y: the longest way through the hole-filled largest blob."""
        big = regions.largest_blobs(regions.label(self.pixels, self.images))
        path = skeleton.longest_path(skeleton.skeletonize(stored(regions.fill_holes(big, self.images))))
        both = path.join(self.images.select("image_id", "gt"), "image_id")
        x, y = cell_centre("r", "c", F.col("gt"))
        return stored(both.select(F.col("image_id").alias("series_id"), "seq", x.alias("x"), y.alias("y")))

    def mesh(self, vertices: int, half: float, window: int = 11) -> DataFrame:
        line = series.smooth(series.resample(self.centerline, vertices), window=window)
        return mesh.transects(line, half)


class Centerline:
    """Ordered vertices (series_id, seq, x, y) of any number of lines."""

    def __init__(self, lines: DataFrame) -> None:
        self.lines = lines

    def smooth(self, window: int = 5, order: int = 3, passes: int = 1) -> Centerline:
        return Centerline(stored(series.smooth(self.lines, window=window, order=order, passes=passes)))

    def resample(self, n: int) -> Centerline:
        return Centerline(stored(series.resample(self.lines, n)))

    def s(self) -> DataFrame:
        return series.steps(self.lines)

    def curvature(self) -> DataFrame:
        """series_id, seq, curv: a value per vertex; the first is 0 and the others are those of the segments with their sign turned."""
        c = series.curvature(self.lines).select("series_id", (F.col("seq") + 1).alias("seq"), (-F.col("curv")).alias("curv"))
        first = self.lines.groupBy("series_id").agg(F.min("seq").alias("seq")).withColumn("curv", F.lit(0.0))
        return first.unionByName(c)

    def inflections(self) -> DataFrame:
        return series.inflections(self.curvature())

    def smoothed_curvature(self, window: int, order: int = 3) -> DataFrame:
        """The curvature of each vertex, smoothed along its line."""
        return series.smooth(self.curvature(), ("curv",), window, order)

    def curvature_of_variation(self, target: float, tolerance: float = 10.0) -> DataFrame:
        """The curvature of each vertex, smoothed until its differences vary as wanted."""
        return series.smooth_to_variation(self.curvature(), target, tolerance)

    def inflections_oversmooth(self, most: int) -> DataFrame:
        return series.inflections_oversmooth(self.lines, most)
