"""Operators on small literal inputs, and against brute force in plain Python."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.functions import geo as gf
from thalweg.network import Centerline, Delta, StageMissing
from thalweg.operators import directions, links, raster, regions, series, skeleton
from thalweg.sources import geo

#: Fixed value: a channel that splits round an island and joins again.
LOOP = [(0, 7), (1, 6), (2, 5), (2, 3), (3, 3), (3, 4), (3, 5), (4, 2), (4, 3), (4, 5), (4, 6), (5, 1), (5, 2), (5, 6), (5, 7), (6, 1), (6, 2), (6, 6), (6, 7), (7, 2), (7, 3), (7, 5), (7, 6), (8, 3), (8, 4), (8, 5)]
LOOP += [(r, 4) for r in range(9, 15)]


def frame(spark, cells, image_id=0):
    return spark.createDataFrame([(image_id, r, c) for r, c in cells], "image_id long, r int, c int")


def images(spark, nrows, ncols, image_id=0):
    return spark.createDataFrame([(image_id, nrows, ncols, gt_of(ncols))], "image_id long, nrows int, ncols int, gt array<double>")


def gt_of(ncols):
    return [0.0, 1.0, 0.0, float(ncols), 0.0, -1.0]


def test_curvature_of_a_parabola(spark):
    # fixed values: the line, and what is expected of it
    ys = [1, 4, 9, 16, 25, 16, 9, 4, 1, 0]
    line = spark.createDataFrame([(0, k, float(k + 1), float(y)) for k, y in enumerate(ys)], "series_id long, seq int, x double, y double")
    got = series.curvature(line).orderBy("seq").collect()
    assert len(got) == 9
    assert got[0].curv == pytest.approx(-0.0313176715)
    assert got[4].angle == pytest.approx(-1.4601391056)
    assert got[7].s == pytest.approx(48.7755002475)
    assert [r.seq for r in series.inflections(series.curvature(line)).orderBy("seq").collect()] == [3, 5]


def test_facade_curvature_of_a_fold(spark):
    xs = [0, 1, 2, 3, 4, 5, 4, 3, 2, 1, 0]
    line = Centerline(spark.createDataFrame([(0, k, float(x), 0.0) for k, x in enumerate(xs)], "series_id long, seq int, x double, y double"))
    got = [r.curv for r in line.curvature().orderBy("seq").collect()]
    assert got == pytest.approx([0, 0, 0, 0, 0, np.pi / 2, np.pi / 2, 0, 0, 0, 0], abs=1e-9)


def test_curvature_smoothed_to_a_variation(spark):
    rng = np.random.default_rng(5)
    noisy = {0: np.cumsum(rng.random(80)) + rng.normal(size=80), 1: rng.random(7), 2: np.ones(40), 3: np.arange(60.0) ** 2}
    rows = [(k, i, float(v)) for k, vs in noisy.items() for i, v in enumerate(vs)] + [(4, 0, None)]
    curves = spark.createDataFrame(rows, "series_id long, seq int, curv double")
    got = defaultdict(list)
    for r in series.smooth_to_variation(curves, 1.0, 40.0).orderBy("series_id", "seq").collect():
        got[r.series_id].append(r)
    # brute force: least-squares cubics, a window at a time
    def smoothed(v, window):
        half, out = window // 2, []
        for i in range(len(v)):
            at = min(max(i - half, 0), len(v) - window)
            out.append(np.polyval(np.polyfit(np.arange(window) - (i - at), v[at : at + window], 3), 0))
        return np.array(out)
    for k in (0, 3):
        for window in range(5, len(noisy[k]) // 2 + 1, 2):
            out = smoothed(noisy[k], window)
            d = np.diff(out)
            cv = d.std() / d.mean()
            if abs((cv - 1) / cv) <= 0.4:
                break
        assert got[k][0].window == window and got[k][0].cv == pytest.approx(cv)
        assert got[k][0].found == (abs((cv - 1) / cv) <= 0.4)
        assert [r.curv for r in got[k]] == pytest.approx(list(out))
    assert [r.curv for r in got[1]] == pytest.approx(list(noisy[1])) and got[1][0].window is None and not got[1][0].found
    assert [r.curv for r in got[2]] == pytest.approx([1.0] * 40) and not got[2][0].found
    assert [(r.curv, r.window, r.cv) for r in got[4]] == [(0.0, None, None)]
    line = Centerline(spark.createDataFrame([(0, i, float(i), float(np.sin(i / 3))) for i in range(40)], "series_id long, seq int, x double, y double"))
    raw = [r.curv for r in line.curvature().orderBy("seq").collect()]
    assert [r.curv for r in line.smoothed_curvature(7).orderBy("seq").collect()] == pytest.approx(list(smoothed(np.array(raw), 7)))
    assert line.curvature_of_variation(1.0).count() == 40 and line.inflections_oversmooth(6).count() == 1


def test_link_widths(spark):
    d = [1.0] * 8
    px = spark.createDataFrame([(0, 5, k, k, 3, v) for k, v in enumerate(d)], "net_id long, link_id long, seq int, r int, c int, d double")
    got = links.widths_and_lengths(px).first()
    assert (got.len, got.len_adj, got.wid_med, got.sinuosity) == (7, 5, 2, 1)


@pytest.mark.parametrize("border", ["zero", "reflect101"])
def test_connectivity(spark, border):
    rng = np.random.default_rng(3)
    a = (rng.random((7, 9)) < 0.5).astype(int)
    got = np.zeros_like(a)
    for r in raster.connectivity(frame(spark, list(zip(*map(lambda x: x.tolist(), np.nonzero(a)), strict=True))), images(spark, 7, 9), border).collect():
        got[r.r, r.c] = r.conn
    p = np.pad(a, 1, **({"mode": "reflect"} if border == "reflect101" else {}))
    want = sum(p[1 + dr : 8 + dr, 1 + dc : 10 + dc] for dr, dc in raster.EIGHT) * a
    assert (got == want).all()


def test_one_hole_and_its_island(spark):
    px, im = frame(spark, LOOP), images(spark, 15, 10)
    found = regions.islands(px, im).collect()
    assert [r.area for r in found] == [8 + 2] or [r.area for r in found] == [8.0]
    filled = regions.fill_holes(px, im)
    assert filled.count() == len(LOOP) + regions.holes(px, im).count()


def test_distances(spark):
    rng = np.random.default_rng(5)
    a = rng.random((12, 17)) < 0.9
    off = np.argwhere(~a)
    got = regions.distances(frame(spark, [tuple(map(int, p)) for p in np.argwhere(a)]), images(spark, 12, 17)).collect()
    assert len(got) == a.sum()
    for r in got:
        assert r.d == pytest.approx(np.sqrt(((off - (r.r, r.c)) ** 2).sum(axis=1).min()))


def test_skeleton_keeps_the_shape(spark):
    rng = np.random.default_rng(1)
    a = np.zeros((40, 40), bool)
    for _ in range(12):
        r, c = rng.integers(2, 30, 2)
        a[r : r + rng.integers(2, 9), c : c + rng.integers(2, 9)] = True
    px, im = frame(spark, [tuple(map(int, p)) for p in np.argwhere(a)]), images(spark, 40, 40)
    thin = skeleton.skeletonize(px).persist()
    parts = lambda x: regions.label(x, im).select("label").distinct().count()
    assert thin.count() < px.count() / 2 and parts(thin) == parts(px)


def test_graph_of_the_loop(spark):
    thin = skeleton.skeletonize(frame(spark, LOOP)).persist()
    nodes, found = skeleton.skeleton_nodes(thin).collect(), skeleton.skeleton_links(thin)
    assert len(nodes) == 4  # two ends, a split and a join
    ends = found.select("link_id", "u", "v").distinct().collect()
    assert len(ends) == 4 and len({tuple(sorted((e.u, e.v))) for e in ends}) == 3
    net = Delta(frame(spark, LOOP), images(spark, 15, 10))
    with pytest.raises(StageMissing):
        net.directed
    net.ends_by_sides("ns")
    flow = net.directed.collect()
    assert len(flow) == 4
    into = {n.node_id: sum(e.v == n.node_id for e in flow) for n in nodes}
    assert sorted(into.values()) == [0, 1, 1, 2]
    m = net.metrics()
    assert m["NAP"].first().paths == 1  # parallel links are one edge
    assert m["flux"].agg(F.max("f")).first()[0] == pytest.approx(1)
    assert {r.jtype for r in net.junctions.collect()} == {"b", "c"}


class Turned(Delta):
    """One of each pair of parallel links flows back."""

    def _facts(self, facts, vectors):
        one = links.parallel(self.pruned).select("net_id", F.col("link_ids")[0].alias("link_id"))
        one = one.join(self.pruned.select("net_id", "link_id", (F.col("u") + F.col("v")).alias("both")), ["net_id", "link_id"])
        back = super()._facts(facts, vectors).join(one, ["net_id", "link_id"], "left")
        return back.select("net_id", "link_id", F.coalesce(F.col("both") - F.col("us"), "us").alias("us"), F.when(F.col("alg") == 0, 0.0).otherwise(directions.algorithm("sp_links")).alias("alg"))


def test_a_cycle_is_repaired(spark):
    flows = []
    for kind in (Delta, Turned):
        net = kind(frame(spark, LOOP), images(spark, 15, 10))
        net.ends_by_sides("ns")
        flows.append({(r.u, r.v) for r in net.directed.collect()})
        assert not net.cycles.count()
    assert flows[0] == flows[1] and len(flows[0]) == 3


def to_sides(corners, p):
    """Distance of p from an open line of corners."""
    best = []
    for a, b in zip(corners, corners[1:] or corners, strict=False):
        d = (b[0] - a[0], b[1] - a[1])
        t = 0 if d == (0, 0) else min(1, max(0, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / (d[0] ** 2 + d[1] ** 2)))
        best.append(np.hypot(p[0] - a[0] - t * d[0], p[1] - a[1] - t * d[1]))
    return min(best)


def test_hulls_and_the_synthetic_surface(spark):
    rng = random.Random(3)
    nets = {n: [(rng.randrange(12), rng.randrange(15)) for _ in range(size)] for n, size in enumerate((1, 2, 3, 5, 9, 30))}
    nets |= {6: [(k, 2 * k) for k in range(5)], 7: [(4, 4)] * 3, 8: [(0, 0), (0, 9), (3, 9), (3, 0), (1, 4)]}
    points = spark.createDataFrame([(n, r, c) for n, own in nets.items() for r, c in own], "net_id long, r int, c int")
    got = defaultdict(list)
    for x in directions.hulls(points).orderBy("net_id", "seq").collect():
        got[x.net_id].append((x.r, x.c))
    side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    for n, own in nets.items():
        ring, own = got[n], sorted(set(own))
        assert set(ring) <= set(own) and len(set(ring)) == len(ring)
        if len(ring) > 2:
            turns = [(a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
            assert all(side(a, b, p) >= 0 for a, b in turns for p in own)
            size = [np.hypot(b[0] - a[0], b[1] - a[1]) for a, b in turns]
            assert size[-1] == pytest.approx(max(size))  # the open one
        else:
            assert ring == [own[0], own[-1]][: len(own)] and all(side(own[0], own[-1], p) == 0 for p in own)
    ins = spark.createDataFrame([(n, r % 3, c) for n, own in nets.items() for r, c in own], "net_id long, r int, c int")
    im = spark.createDataFrame([(n, 12, 15) for n in nets], "image_id long, nrows int, ncols int")
    px = spark.createDataFrame([(n, k, r, c) for n in nets for k, (r, c) in enumerate(((0, 0), (5, 7), (11, 14)))], "net_id long, seq int, r int, c int")
    surface = directions.synthetic_surface(px, im, ins, points).collect()
    assert len(surface) == 3 * len(nets)
    high = defaultdict(list)
    for x in directions.hulls(ins).orderBy("net_id", "seq").collect():
        high[x.net_id].append((x.r, x.c))
    cells = [(r, c) for r in range(12) for c in range(15)]
    for x in surface:
        share = lambda line: to_sides(line, (x.r, x.c)) / max(to_sides(line, p) for p in cells)  # noqa: B023, E731
        assert x.z == pytest.approx(share(got[x.net_id]) + 1 - share(high[x.net_id]))
    assert directions.synthetic_surface(px, im, ins.limit(0), points).count() == 0
    slopes = spark.createDataFrame([(0, 1, 0.5), (0, 2, -0.5), (0, 3, 0.0), (0, 4, None)], "net_id long, link_id long, slope double")
    flat = spark.createDataFrame([(0, k, 10, 20) for k in (1, 2, 3, 4)], "net_id long, link_id long, u long, v long")
    assert {r.link_id: r.us for r in directions.surface_guesses(flat, slopes).collect()} == {1: 20, 2: 10, 3: 10}


def test_wide_inlets(spark):
    own = spark.createDataFrame([(0, 1, 1, 9, 10.0), (0, 2, 2, 9, 7.5), (0, 3, 3, 9, 7.6), (0, 4, 3, 9, 1.0), (1, 1, 1, 2, 0.0)], "net_id long, link_id long, u long, v long, wid double")
    ins = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 1)], "net_id long, node long")
    assert {tuple(r) for r in links.wide_inlets(own, ins).collect()} == {(0, 1), (0, 3), (1, 1)}


def brute_spurs(edges, keep):
    edges = {k: e for k, e in edges.items() if e[0] != e[1]}
    while True:
        at = defaultdict(list)
        for k, (u, v) in edges.items():
            at[u].append(k)
            at[v].append(k)
        loose = {ks[0] for n, ks in at.items() if len(ks) == 1 and n not in keep}
        if not loose:
            return edges
        edges = {k: e for k, e in edges.items() if k not in loose}


def test_centerline_is_the_longest_over_all_ends(spark):
    import heapq

    from thalweg.plans import registered

    sf, got, images = "/root/testdata/sf0.001", defaultdict(list), defaultdict(set)
    for p in registered()["centerline"][0](spark, sf).orderBy("image_id", "seq").collect():
        got[p.image_id].append((p.r, p.c))
    for p in registered()["skeleton"][0](spark, sf).collect():
        images[p.image_id].add((p.r, p.c))
    step = lambda p, q: np.hypot(p[0] - q[0], p[1] - q[1])
    near = lambda on, p: [q for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (q := (p[0] + a, p[1] + b)) in on]
    assert set(got) == set(images)
    for image, on in images.items():
        ends, longest = [p for p in on if len(near(on, p)) == 1], 0.0
        for start in ends:  # over single pixels, without links
            dist, heap = {}, [(0.0, start)]
            while heap:
                d, p = heapq.heappop(heap)
                if p in dist:
                    continue
                dist[p] = d
                for q in near(on, p):
                    heapq.heappush(heap, (d + step(p, q), q))
            longest = max(longest, *(dist.get(p, 0.0) for p in ends))
        path = got[image]
        assert set(path) <= on and {path[0], path[-1]} <= set(ends)
        steps = [step(p, q) for p, q in zip(path, path[1:], strict=False)]
        assert max(steps) < 1.5 and sum(steps) == pytest.approx(longest), image


def test_spurs_bridges_and_cycles(spark):
    rng = random.Random(4)
    edges = {k: (rng.randrange(30), rng.randrange(30)) for k in range(40)}
    df = spark.createDataFrame([(0, k, u, v, 1.0) for k, (u, v) in edges.items()], "net_id long, link_id long, u long, v long, len double")
    keep = spark.createDataFrame([(0, 1), (0, 2)], "net_id long, node long")
    assert {r.link_id for r in links.without_spurs(df, keep).collect()} == set(brute_spurs(edges, {1, 2}))

    def parts(es):
        seen, n = set(), 0
        near = defaultdict(set)
        for u, v in es:
            near[u].add(v)
            near[v].add(u)
        for s in range(30):
            if s not in seen:
                n += 1
                todo = [s]
                while todo:
                    x = todo.pop()
                    if x not in seen:
                        seen.add(x)
                        todo += near[x]
        return n

    want = {k for k in edges if parts([e for j, e in edges.items() if j != k]) > parts(edges.values())}
    assert {r.link_id for r in directions.bridges(df).collect()} == want

    def reach(a, b):
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            if x == b:
                return True
            if x not in seen:
                seen.add(x)
                todo += [v for u, v in edges.values() if u == x]
        return False

    assert {r.link_id for r in directions.cycles(df).collect()} == {k for k, (u, v) in edges.items() if reach(v, u)}


def cyclic(pairs):
    left = list(pairs)
    while True:
        entered = {v for _, v in left}
        rest = [e for e in left if e[0] in entered]
        if len(rest) == len(left):
            return bool(left)
        left = rest


def test_cycle_flips_are_the_fewest(spark):
    """Against every set of flips, on networks of a few links."""
    rng = random.Random(12)
    nets = {n: {k: (rng.randrange(7), rng.randrange(7)) for k in range(9)} for n in range(40)}
    nets = {n: {k: e for k, e in own.items() if e[0] != e[1]} for n, own in nets.items()}
    nets[40] = {0: (0, 1), 1: (1, 1), 2: (1, 2)}  # no flip takes away a link from a node to itself
    df = spark.createDataFrame([(n, k, u, v) for n, own in nets.items() for k, (u, v) in own.items()], "net_id long, link_id long, u long, v long")
    ok = spark.createDataFrame([(n, 0) for n in nets], "net_id long, node long")
    parts = defaultdict(set)
    for r in directions.cycles(df).collect():
        parts[r.net_id, r.cycle] |= set(nets[r.net_id][r.link_id])
    got = defaultdict(set)
    for r in directions.cycle_flips(df, ok).collect():
        assert r.fixed == (r.link_id is not None)
        got[r.net_id, r.cycle] |= {r.link_id} if r.fixed else set()
    assert got.keys() == parts.keys() and len(parts) > 10

    def fine(n, nodes, flips):
        own = {k: (v, u) if k in flips else (u, v) for k, (u, v) in nets[n].items()}
        inside = [e for e in own.values() if set(e) <= nodes]
        balanced = all({u == x for u, v in own.values() if x in (u, v)} == {True, False} for x in nodes - {0})
        return balanced and not cyclic(inside)

    for (n, _), nodes in parts.items():
        inner = [k for k, e in nets[n].items() if set(e) <= nodes]
        sizes = [bin(m).count("1") for m in range(1 << len(inner)) if fine(n, nodes, {k for i, k in enumerate(inner) if m >> i & 1})]
        flips = got[n, _]
        assert len(flips) == min(sizes, default=0)
        assert not flips or fine(n, nodes, flips)
    kept = directions.cycle_flips(df, ok, df.select("net_id", "link_id"))
    assert not kept.where("fixed").count() and kept.count() == len(parts)
    none = directions.cycle_flips(df.where("link_id = 0 AND u <> v"), ok)
    assert none.count() == 0


def test_cycles_are_set_again_by_angles(spark):
    at = {0: (0, 0), 1: (1, 0), 2: (2, 1), 3: (2, -1), 4: (3, 0), 5: (4, 0)}
    edges = {0: (0, 1), 1: (1, 2), 2: (2, 4), 3: (4, 3), 4: (3, 1), 5: (4, 5)}  # 1, 2, 4, 3 flow in a circle
    rows = [(n, k, u, v, 1.0, float(at[v][0] - at[u][0]), float(at[v][1] - at[u][1])) for n in (0, 1, 2) for k, (u, v) in edges.items()]
    df = spark.createDataFrame(rows, "net_id long, link_id long, u long, v long, len double, dx double, dy double")
    net, vectors = df.drop("dx", "dy"), df.select("net_id", "link_id", "dx", "dy")
    right = {0: 0, 1: 1, 2: 2, 3: 3, 4: 1, 5: 4}
    sure, unsure = directions.algorithm("manual_set"), directions.algorithm("sp_links")
    facts = [(0, k, u, sure if k in (0, 5) else unsure) for k, (u, _) in edges.items()]
    facts += [(1, k, u, sure) for k, (u, _) in edges.items()] + [(2, k, us, unsure) for k, us in right.items()]
    facts = spark.createDataFrame(facts, "net_id long, link_id long, us long, alg double")
    got = {(r.net_id, r.link_id): (r.us, r.alg) for r in directions.reset_cycles(net, vectors, facts).collect()}
    assert {k: us for (n, k), (us, _) in got.items() if n == 0} == right
    assert {alg for (n, k), (_, alg) in got.items() if n == 0 and k not in (0, 5)} <= {directions.algorithm("known_fdr_rs"), directions.algorithm("continuity")}
    assert {k: x for (n, k), x in got.items() if n == 1} == {k: (u, sure) for k, (u, _) in edges.items()}  # all sure: left alone
    assert {k: x for (n, k), x in got.items() if n == 2} == {k: (us, unsure) for k, us in right.items()}  # no cycle


def test_shortest(spark):
    rng = random.Random(9)
    edges = [(k, rng.randrange(20), rng.randrange(20), float(rng.randint(1, 9))) for k in range(60)]
    df = spark.createDataFrame([(0, *e) for e in edges], "net_id long, link_id long, u long, v long, len double")
    dist = {0: 0.0}
    for _ in range(25):
        for _, u, v, w in edges:
            for a, b in ((u, v), (v, u)):
                if a in dist:
                    dist[b] = min(dist.get(b, 1e9), dist[a] + w)
    got = directions.shortest(df, spark.createDataFrame([(0, 0)], "net_id long, node long")).collect()
    assert {r.node: r.dist for r in got} == dist


def test_algorithm_numbers():
    # Fixed values
    want = {
        "sourcesinkfix": -2, "manual_set": -1, "inletoutlet": 0, "continuity": 1, "parallels": 2, "artificials": 2.1, "main_chans": 4, "bridges": 5, "known_fdr": 6, "known_fdr_rs": 6.1,
        "syn_dem": 10, "syn_dem_med": 10.1, "sym_dem_leftover": 10.2, "sp_links": 11, "sp_nodes": 12, "longest_steepest": 13, "three_agree": 15, "syn_dem_and_sp": 16, "cl_dist_guess": 20,
        "cl_ang_guess": 21, "cl_dist_set": 22, "cl_ang_set": 23, "cl_ang_rs": 23.1, "cl_dist_and_ang": 24, "short_no_bktrck": 25, "wid_pctdiff": 26,
    }
    assert {k: directions.algorithm(k) for k in directions.ALGORITHMS} == want


def test_super_apex_comes_and_goes(spark):
    own = spark.createDataFrame([(0, 1, 3, 4, 1.0, 2.0), (0, 2, 5, 4, 1.0, 3.0)], "net_id long, link_id long, u long, v long, len double, wid double")
    inlets = spark.createDataFrame([(0, 3), (0, 5)], "net_id long, node long")
    apex = links.super_apex(own)
    more = links.add_super_apex(own, inlets)
    assert more.count() == 4
    assert sorted(links.delete_super_apex(more, apex).collect()) == sorted(own.collect()) == sorted(links.delete_super_apex(own, apex).collect())


def test_nearest_nodes_of_nothing(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0)], "node_id long, x double, y double")
    points = spark.createDataFrame([], "point_id long, x double, y double")
    assert links.nearest_nodes(points, nodes).collect() == [] == links.nearest_nodes(points.unionByName(spark.createDataFrame([(1, 0.0, 0.0)], points.schema)), nodes.limit(0)).collect()


def test_main_channel(spark):
    rng = random.Random(4)
    rows = [(0, k, rng.randrange(15), rng.randrange(15), float(rng.randint(1, 9)), float(rng.randint(1, 9))) for k in range(50)]
    df = spark.createDataFrame(rows, "net_id long, link_id long, u long, v long, len double, wid double")
    outlets = [9, 12]
    got = {r.link_id: r.us for r in directions.main_channel_guesses(df, spark.createDataFrame([(0, 2)], "net_id long, node long"), spark.createDataFrame([(0, o) for o in outlets], "net_id long, node long")).collect()}
    widest = max(r[5] for r in rows)
    cost = {r[1]: (widest - r[5]) * r[4] for r in rows}
    dist = {2: 0.0}
    for _ in range(20):
        for _, k, u, v, _, _ in rows:
            for a, b in ((u, v), (v, u)):
                if a in dist:
                    dist[b] = min(dist.get(b, 1e9), dist[a] + cost[k])
    end = {r[1]: r[2:4] for r in rows}
    below = {}
    for k, us in got.items():
        u, v = end[k]
        ds = v if us == u else u
        assert abs(dist[us] + cost[k] - dist[ds]) < 1e-6
        below[ds] = us
    for o in outlets:
        while o != 2:
            o = below[o]


def test_coordinates(spark):
    row = spark.createDataFrame([(7.5, 47.25, "+proj=utm +zone=6 +units=m"), (-149.9, -33.9, "+proj=longlat")], "lon double, lat double, crs string")
    east, north = gf.utm("lon", "lat", 32)
    back = row.where("lat > 0").withColumns({"e": east, "n": north})
    lon, lat = gf.lonlat("e", "n", 32)
    got = back.select("e", "n", lon.alias("lon"), lat.alias("lat")).first()
    assert (got.lon, got.lat) == pytest.approx((7.5, 47.25), abs=1e-7) and 380_000 < got.e < 390_000 and 5_230_000 < got.n < 5_240_000
    assert [r.u for r in row.select(gf.unit_of("crs").alias("u")).collect()] == ["meter", "degree"]


@pytest.mark.parametrize("kind", ["uint8", "uint16", "float32", "float64"])
def test_geotiff_round_trip(kind):
    rng = np.random.default_rng(0)
    image = (rng.random((300, 211)) * 200).astype(kind)
    got, gt = geo.decode_geotiff(geo.encode_geotiff(image, [10.0, 30.0, 0.0, 500.0, 0.0, -30.0], nodata=-1, colors=geo.color_table("mask") if kind == "uint8" else None))
    assert (got == image).all() and gt == [10.0, 30.0, 0.0, 500.0, 0.0, -30.0]


def test_raster_and_vector_files(spark, tmp_path):
    image = np.zeros((20, 30), np.uint8)
    image[3:5, 7:20] = 1
    (tmp_path / "a.tif").write_bytes(geo.encode_geotiff(image, [0.0, 2.0, 0.0, 40.0, 0.0, -2.0]))
    got = geo.read_geotiffs(spark, str(tmp_path / "*.tif"))
    assert got.count() == 26 and got.first().gt == [0.0, 2.0, 0.0, 40.0, 0.0, -2.0]
    im = spark.createDataFrame([(1, 4, 5, gt_of(5))], "image_id long, nrows int, ncols int, gt array<double>")
    cells = spark.createDataFrame([(1, 2, 3, 7.5)], "image_id long, r int, c int, v double")
    back, _ = geo.decode_geotiff(bytes(geo.geotiff_bytes(cells, im).first().content))
    assert back.shape == (4, 5) and back[2, 3] == 7.5 and back.sum() == 7.5
    pts = spark.createDataFrame([(4, 1.5, 2.5)], "id long, x double, y double")
    lines = spark.createDataFrame([(1, k, float(k), 0.0) for k in range(3)], "id long, seq int, x double, y double")
    geo.write_features(geo.point_features(pts).unionByName(geo.line_features(lines, "id")), str(tmp_path / "f"))
    read = geo.read_features(spark, str(tmp_path / "f")).persist()
    assert {(r.kind, r.seq, r.x, r.y) for r in read.collect()} == {("Point", 0, 1.5, 2.5)} | {("LineString", k, float(k), 0.0) for k in range(3)}
    assert {(r.x, r.y) for r in geo.centroids(read).collect()} == {(1.5, 2.5), (1.0, 0.0)}
