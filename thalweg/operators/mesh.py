"""Meshes along centerlines: transects across a line, the cells between them, offset lines and their alignment."""

from __future__ import annotations

from math import inf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.operators.series import along


def transects(lines: DataFrame, half: float) -> DataFrame:
    """series_id, seq, x1, y1 (left), x2, y2 (right): across each vertex, at right angles to the way from the vertex before to the one after."""
    before = lambda c: F.coalesce(F.lag(c).over(along()), F.col(c))
    after = lambda c: F.coalesce(F.lead(c).over(along()), F.col(c))
    dx, dy = after("x") - before("x"), after("y") - before("y")
    own = lines.withColumns({"_dx": dx, "_dy": dy})
    size = F.hypot("_dx", "_dy")
    nx, ny = -F.col("_dy") / F.when(size > 0, size) * half, F.col("_dx") / F.when(size > 0, size) * half
    return own.select("series_id", "seq", (F.col("x") + nx).alias("x1"), (F.col("y") + ny).alias("y1"), (F.col("x") - nx).alias("x2"), (F.col("y") - ny).alias("y2")).where("x1 IS NOT NULL")


def cells(across: DataFrame) -> DataFrame:
    """series_id, cell_id, ring: the four corners between each transect and the next."""
    nxt = {c: F.lead(c).over(along()) for c in ("x1", "y1", "x2", "y2")}
    both = across.withColumns({f"n{c}": e for c, e in nxt.items()}).where("nx1 IS NOT NULL")
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return both.select("series_id", F.col("seq").alias("cell_id"), F.array(corner("x1", "y1"), corner("nx1", "ny1"), corner("nx2", "ny2"), corner("x2", "y2")).alias("ring"))


def cell_edges(mesh: DataFrame) -> DataFrame:
    """cell_id, x1, y1, x2, y2 of the rings, for joins by place."""
    at = mesh.select("series_id", "cell_id", "ring", F.posexplode("ring").alias("k", "p"))
    nxt = F.element_at("ring", (F.col("k") + 1) % F.size("ring") + 1)
    return at.select("cell_id", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), nxt["x"].alias("x2"), nxt["y"].alias("y2"))


def offset(lines: DataFrame, distance: float) -> DataFrame:
    """Each line moved sideways (left for positive distances), without vertices that come nearer to the line than that. A task holds one line."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        p = frame[["x", "y"]].to_numpy(float)
        d = np.gradient(p, axis=0) if len(p) > 1 else np.zeros_like(p)
        size = np.hypot(d[:, 0], d[:, 1])
        ok = size > 0
        q = p[ok] + distance * np.stack((-d[ok, 1], d[ok, 0]), axis=1) / size[ok, None]
        a, b = p[:-1], p[1:]
        keep = np.ones(len(q), bool)
        for k, point in enumerate(q):
            ab = b - a
            t = np.clip(((point - a) * ab).sum(axis=1) / np.maximum((ab * ab).sum(axis=1), 1e-300), 0, 1)
            near = np.hypot(*(a + t[:, None] * ab - point).T)
            keep[k] = not len(near) or near.min() >= abs(distance) * (1 - 1e-6)
        return pd.DataFrame({"series_id": frame["series_id"].iloc[0], "seq": frame["seq"].to_numpy()[ok][keep], "x": q[keep, 0], "y": q[keep, 1]})

    kind = lines.schema["series_id"].dataType.simpleString()
    return lines.groupBy("series_id").applyInPandas(work, f"series_id {kind}, seq int, x double, y double")


def warp(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The cheapest alignment of two signals that moves forward in both (dynamic time warping)."""
    before = [0.0] + [inf] * len(b)
    steps = []  # 0: both went on, 1: a did, 2: b did
    others = [float(y) for y in b]
    for x in map(float, a):
        row, step, left, corner = [inf], bytearray(), inf, before[0]
        for y, up in zip(others, before[1:], strict=True):
            best, way = corner, 0
            if up < best:
                best, way = up, 1
            if left < best:
                best, way = left, 2
            left = abs(x - y) + best
            corner = up
            row.append(left)
            step.append(way)
        steps.append(step)
        before = row
    path, i, j = [], len(a), len(b)
    while i and j:
        path.append((i - 1, j - 1))
        way = steps[i - 1][j - 1]
        i, j = i - (way != 2), j - (way != 1)
    return path[::-1]


def aligned(pairs: DataFrame) -> DataFrame:
    """series_id, seq, other of pairs (series_id, side 'a' or 'b', seq, v): the places of b that each place of a is aligned with. A task holds one series."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = (frame[frame["side"] == s].sort_values("seq") for s in ("a", "b"))
        path = warp(a["v"].to_numpy(float), b["v"].to_numpy(float))
        return pd.DataFrame({"series_id": frame["series_id"].iloc[0], "seq": [int(a["seq"].iloc[i]) for i, _ in path], "other": [int(b["seq"].iloc[j]) for _, j in path]}).astype({"seq": "int32", "other": "int32"})

    kind = pairs.schema["series_id"].dataType.simpleString()
    return pairs.groupBy("series_id").applyInPandas(work, f"series_id {kind}, seq int, other int")


def valley_mesh(lines: DataFrame, half: float, step: float) -> DataFrame:
    """Transects (series_id, seq, x1, y1, x2, y2) whose ends are matched step by step: the line is moved outward by step on both
    sides until half, and each moved line is aligned with the one before by its directions, so that transects fan out round bends."""

    def directions(p: np.ndarray) -> np.ndarray:
        d = np.gradient(p, axis=0)
        return np.unwrap(np.arctan2(d[:, 1], d[:, 0]))

    def move(p: np.ndarray, distance: float) -> np.ndarray:
        d = np.gradient(p, axis=0)
        size = np.maximum(np.hypot(d[:, 0], d[:, 1]), 1e-12)
        q = p + distance * np.stack((-d[:, 1], d[:, 0]), axis=1) / size[:, None]
        near = np.hypot(q[:, None, 0] - p[None, :, 0], q[:, None, 1] - p[None, :, 1]).min(axis=1)
        kept = q[near >= abs(distance) * 0.7]
        return kept if len(kept) > 2 else q

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        line = frame[["x", "y"]].to_numpy(float)
        ends = []
        for side in (1, -1):
            now, at = line, np.arange(len(line))
            for _ in range(max(1, round(half / step))):
                moved = move(now, side * step)
                to = dict(warp(directions(now), directions(moved)))  # the last, so the most downstream, of several
                at = np.array([to[k] for k in at])
                now = moved
            ends.append(now[at])
        left, right = ends
        return pd.DataFrame({"series_id": frame["series_id"].iloc[0], "seq": frame["seq"].to_numpy(), "x1": left[:, 0], "y1": left[:, 1], "x2": right[:, 0], "y2": right[:, 1]})

    kind = lines.schema["series_id"].dataType.simpleString()
    return lines.groupBy("series_id").applyInPandas(work, f"series_id {kind}, seq int, x1 double, y1 double, x2 double, y2 double")


