"""Metrics of flow networks as relations: edges (net_id, u, v, w) of directed acyclic networks with one apex each.

Flux and membership are propagated level by level, one sum per node and level, so no path is ever
enumerated; the rounds end when no flow is left. Networks of any number are handled together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thalweg.operators.regions import stored


class CyclicNetwork(RuntimeError):
    """The links have a cycle, so nothing can be propagated."""


def graph(links: DataFrame, weight: str = "w") -> DataFrame:
    """net_id, u, v, w: one edge for parallel links, with the sum of their weights, which must be positive."""
    edges = links.groupBy("net_id", "u", "v").agg(F.sum(weight).alias("w"), F.min(weight).alias("least"))
    return edges.select("net_id", "u", "v", F.when(F.col("least") > 0, F.col("w")).otherwise(F.raise_error(F.lit("weights must be positive"))).alias("w"))


def normalize(edges: DataFrame) -> DataFrame:
    """With p: an edge's share of what leaves its node."""
    return edges.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("net_id", "u")))


def equal_split(edges: DataFrame) -> DataFrame:
    """With p: the same share for every edge that leaves a node."""
    return edges.withColumn("p", 1 / F.count("*").over(Window.partitionBy("net_id", "u")))


def inlets_and_outlets(edges: DataFrame) -> DataFrame:
    """net_id, node, role: nodes without an edge in, or without one out."""
    ends = edges.select("net_id", F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("e"))
    per = ends.groupBy("net_id", "e.node").agg(F.sum("e.out").alias("out"), F.sum("e.in").alias("in"))
    return per.where("`in` = 0 OR out = 0").select("net_id", "node", F.when(F.col("in") == 0, "inlet").otherwise("outlet").alias("role"))


def _propagate(start: DataFrame, edges: DataFrame, keys: list[str], frm: str, to: str, share: str) -> DataFrame:
    """Sum over all paths of start's x (by keys and node) times the shares along them, the empty path included."""
    moving, total = start, start
    bound = edges.select("net_id", "u").distinct().groupBy("net_id").count().agg(F.max("count")).first()[0] or 0
    step = edges.select("net_id", F.col(frm).alias("node"), F.col(to).alias("next"), F.col(share).alias("share"))
    for _ in range(bound + 1):
        moving = stored(moving.join(step, ["net_id", "node"]).groupBy(*keys, F.col("next").alias("node")).agg(F.sum(F.col("x") * F.col("share")).alias("x")))
        if not moving.limit(1).count():
            return total.groupBy(*keys, "node").agg(F.sum("x").alias("x"))
        total = total.unionByName(moving)
    raise CyclicNetwork("the network has a cycle")


def flux(shares: DataFrame) -> DataFrame:
    """net_id, node, f: the part of the apex's flow that passes a node."""
    start = stored(inlets_and_outlets(shares).where("role = 'inlet'").select("net_id", "node", F.lit(1.0).alias("x")))
    return _propagate(start, shares, ["net_id"], "u", "v", "p").withColumnRenamed("x", "f")


def membership(shares: DataFrame) -> DataFrame:
    """net_id, node, outlet, s: the part of a node's flow that reaches an outlet; only nodes that reach it."""
    start = stored(inlets_and_outlets(shares).where("role = 'outlet'").select("net_id", F.col("node").alias("outlet"), "node", F.lit(1.0).alias("x")))
    return _propagate(start, shares, ["net_id", "outlet"], "v", "u", "p").withColumnRenamed("x", "s")


def path_counts(edges: DataFrame) -> DataFrame:
    """net_id, outlet, paths: ways from the apex to each outlet."""
    ends = stored(inlets_and_outlets(edges))
    start = ends.where("role = 'inlet'").select("net_id", "node", F.lit(1).cast("long").alias("x"))
    found = _propagate(start, edges.withColumn("one", F.lit(1).cast("long")), ["net_id"], "u", "v", "one")
    return found.join(ends.where("role = 'outlet'").select("net_id", "node"), ["net_id", "node"]).select("net_id", F.col("node").alias("outlet"), F.col("x").alias("paths"))


def link_flux(shares: DataFrame, fluxes: DataFrame) -> DataFrame:
    """With f: flux of each edge."""
    return shares.join(fluxes.select("net_id", F.col("node").alias("u"), F.col("f").alias("fu")), ["net_id", "u"]).withColumn("f", F.col("fu") * F.col("p")).drop("fu")


def subnetwork_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """Each edge once per outlet that both of its ends reach, with s of its lower end."""
    up = members.select("net_id", "outlet", F.col("node").alias("u"))
    down = members.select("net_id", "outlet", F.col("node").alias("v"), "s")
    return links.join(up, ["net_id", "u"]).join(down, ["net_id", "outlet", "v"])


def sharing_indices(own: DataFrame) -> DataFrame:
    """net_id, outlet, lsi (links shared with other subnetworks) and fsi (flux that goes to others), from subnetwork_links."""
    belong = F.count("*").over(Window.partitionBy("net_id", "u", "v"))
    return own.withColumn("b", belong).groupBy("net_id", "outlet").agg((1 - F.avg(1 / F.col("b"))).alias("lsi"), (1 - F.avg("s")).alias("fsi"))


def leakage(fluxes: DataFrame, members: DataFrame, own: DataFrame) -> DataFrame:
    """net_id, outlet, li: of the flux at a subnetwork's nodes, the part that leaves it; own has f."""
    nodes = members.join(fluxes, ["net_id", "node"]).where("node <> outlet").groupBy("net_id", "outlet").agg(F.sum("f").alias("at_nodes"))
    links = own.groupBy("net_id", "outlet").agg(F.sum("f").alias("in_links"))
    return nodes.join(links, ["net_id", "outlet"]).select("net_id", "outlet", ((F.col("at_nodes") - F.col("in_links")) / F.col("at_nodes")).alias("li"))


def pairwise_dependence(own: DataFrame) -> DataFrame:
    """net_id, i, k, tpd (of k's links, the part also in i) and dpd (the same by flux f); pairs that share no link have no row."""
    sides = own.select("net_id", "u", "v", "f", F.col("outlet").alias("k"))
    pairs = sides.join(own.select("net_id", "u", "v", F.col("outlet").alias("i")), ["net_id", "u", "v"]).groupBy("net_id", "i", "k").agg(F.count("*").alias("n"), F.sum("f").alias("f"))
    total = pairs.where("i = k").select("net_id", "k", F.col("n").alias("n_k"), F.col("f").alias("f_k"))
    return pairs.join(total, ["net_id", "k"]).select("net_id", "i", "k", (F.col("n") / F.col("n_k")).alias("tpd"), (F.col("f") / F.col("f_k")).alias("dpd"))


def information(own: DataFrame) -> DataFrame:
    """net_id, outlet, mi and ce: mutual information of a subnetwork's upper and lower ends by flux f, and conditional entropy."""
    by = ("net_id", "outlet")
    total = own.withColumn("g", F.col("f") / F.sum("f").over(Window.partitionBy(*by)))
    total = total.withColumn("down", F.sum("g").over(Window.partitionBy(*by, "v"))).withColumn("up", F.sum("g").over(Window.partitionBy(*by, "u"))).where("g > 0")
    mi, ce = F.col("g") * F.log2(F.col("g") / (F.col("down") * F.col("up"))), -F.col("g") * F.log2(F.col("g") * F.col("g") / F.col("down") / F.col("up"))
    return total.groupBy(*by).agg(F.sum(mi).alias("mi"), F.sum(ce).alias("ce"))


def entropy_rate(fluxes: DataFrame, members: DataFrame) -> DataFrame:
    """net_id, ner: flux-weighted entropy of where nodes' flow goes, each relative to its number of outlets."""
    entropy = -F.sum(F.col("s") * F.log2("s"))
    per = members.where("s > 0").groupBy("net_id", "node").agg(F.count("*").alias("n"), entropy.alias("h"))
    own = fluxes.join(per, ["net_id", "node"]).withColumn("h", F.when(F.col("n") > 1, F.col("h") / F.log2("n")).otherwise(F.col("h")))
    return own.groupBy("net_id").agg((F.sum(F.col("f") * F.col("h")) / F.sum("f")).alias("ner"))


def entropy_exceedance(edges: DataFrame, trials: int = 200, seed: int = 1) -> DataFrame:
    """net_id, ner, exceedance: the share of trials with random weights whose entropy rate is above the network's.

    All trials are one set of networks, propagated together.
    """
    shares = stored(normalize(edges))
    own = entropy_rate(flux(shares), membership(shares))
    draw = (F.pmod(F.xxhash64("net_id", "u", "v", "trial", F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    many = edges.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials)))).withColumn("w", draw)
    many = many.select(F.concat_ws("/", "net_id", "trial").alias("net_id"), "u", "v", "w", F.col("net_id").alias("of"))
    names = many.select("net_id", "of").distinct()
    random = stored(normalize(many.drop("of")))
    rates = entropy_rate(flux(random), membership(random)).join(names, "net_id").select(F.col("of").alias("net_id"), F.col("ner").alias("random"))
    return own.join(rates, "net_id").groupBy("net_id", "ner").agg(F.avg((F.col("random") > F.col("ner")).cast("double")).alias("exceedance"))


def resistance_distance(edges: DataFrame, members: DataFrame) -> DataFrame:
    """net_id, outlet, rd: effective resistance between apex and outlet on the undirected subnetwork, every link one unit."""
    ends = inlets_and_outlets(edges)
    own = subnetwork_links(edges, members).join(ends.where("role = 'inlet'").select("net_id", F.col("node").alias("apex")), "net_id")

    def solve(key, frame: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(frame[["u", "v"]].to_numpy())
        i, j = np.searchsorted(nodes, frame["u"]), np.searchsorted(nodes, frame["v"])
        laplacian = np.zeros((len(nodes), len(nodes)))
        np.add.at(laplacian, (i, j), -1.0)
        np.add.at(laplacian, (j, i), -1.0)
        laplacian -= np.diag(laplacian.sum(axis=1))
        inverse = np.linalg.pinv(laplacian)
        a, b = np.searchsorted(nodes, frame["apex"].iloc[0]), np.searchsorted(nodes, key[1])
        return pd.DataFrame({"net_id": [key[0]], "outlet": [key[1]], "rd": [inverse[a, a] + inverse[b, b] - 2 * inverse[a, b]]})

    kind = edges.schema["net_id"].dataType.simpleString()
    return own.groupBy("net_id", "outlet").applyInPandas(solve, f"net_id {kind}, outlet long, rd double")


def hops(edges: DataFrame, start: DataFrame) -> DataFrame:
    """net_id, node, hops: fewest edges from a node of start (net_id, node); nodes that can't be reached are missing."""
    seen = stored(start.select("net_id", "node", F.lit(0).alias("hops")))
    front, k = seen, 0
    step = edges.select("net_id", F.col("u").alias("node"), F.col("v").alias("next"))
    while front.limit(1).count():
        k += 1
        front = stored(front.join(step, ["net_id", "node"]).select("net_id", F.col("next").alias("node")).distinct().join(seen, ["net_id", "node"], "left_anti").withColumn("hops", F.lit(k)))
        seen = stored(seen.unionByName(front))
    return seen


def adjacency(edges: DataFrame, value: str = "w") -> DataFrame:
    """A dense matrix as rows: net_id, u, and a column n<v> per lower node; for export of small networks."""
    columns = [r.v for r in edges.select("v").distinct().orderBy("v").collect()]
    return edges.withColumn("v", F.concat(F.lit("n"), "v")).groupBy("net_id", "u").pivot("v", [f"n{v}" for v in columns]).sum(value).fillna(0.0)


def metrics(edges: DataFrame) -> dict[str, DataFrame]:
    """All metrics of the networks, by name; flux and membership are made once."""
    weighted, even = stored(normalize(edges)), stored(equal_split(edges))
    f, s, fe, se = (stored(x) for x in (flux(weighted), membership(weighted), flux(even), membership(even)))
    own, own_even = stored(subnetwork_links(link_flux(weighted, f), s)), stored(subnetwork_links(link_flux(even, fe), se))
    return {
        "flux": f,
        "membership": s,
        "nER": entropy_rate(f, s),
        "nER_exceedance": entropy_exceedance(edges),
        "TMI_TCE": information(own_even),
        "DMI_DCE": information(own),
        "LSI": sharing_indices(own_even).select("net_id", "outlet", "lsi"),
        "FSI": sharing_indices(own).select("net_id", "outlet", "fsi"),
        "LI": leakage(f, s, own),
        "TPD": pairwise_dependence(own_even).select("net_id", "i", "k", "tpd"),
        "DPD": pairwise_dependence(own).select("net_id", "i", "k", "dpd"),
        "NAP": path_counts(edges),
        "RD": resistance_distance(edges, se),
    }
