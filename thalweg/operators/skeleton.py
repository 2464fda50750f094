"""Skeletons of rasters and their graphs. What thins or walks is sequential within an image, so a task holds one image; images run beside each other.

A skeleton's nodes are its end pixels and its clusters of pixels with more than two on-neighbours; its links are the
runs of pixels between them. A ring without a node gets one at its first pixel in reading order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Around a pixel, clockwise from above (fixed order of the two-pass thinning).
RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def dense(frame: pd.DataFrame, pad: int = 1) -> tuple[np.ndarray, int, int]:
    """A padded raster of an image's pixels, and the row and column of its corner."""
    r, c = frame["r"].to_numpy(), frame["c"].to_numpy()
    top, left = int(r.min()) - pad, int(c.min()) - pad
    out = np.zeros((int(r.max()) - top + pad + 1, int(c.max()) - left + pad + 1), np.uint8)
    out[r - top, c - left] = 1
    return out, top, left


def around(image: np.ndarray) -> np.ndarray:
    """The eight neighbours of the inner cells, clockwise from above: eight rasters."""
    h, w = image.shape
    return np.stack([image[1 + dr : h - 1 + dr, 1 + dc : w - 1 + dc] for dr, dc in RING])


def thinned(image: np.ndarray) -> np.ndarray:
    """Two-pass thinning (Zhang and Suen): border pixels whose removal keeps the shape whole go until none is left."""
    image = image.copy()
    while True:
        changed = False
        for first in (True, False):
            p = around(image).astype(np.int8)
            n = p.sum(axis=0)
            rises = ((p == 0) & (np.roll(p, -1, axis=0) == 1)).sum(axis=0)
            up, right, down, left = p[0], p[2], p[4], p[6]
            sides = (up * right * down == 0) & (right * down * left == 0) if first else (up * right * left == 0) & (up * down * left == 0)
            gone = (image[1:-1, 1:-1] == 1) & (n >= 2) & (n <= 6) & (rises == 1) & sides
            if gone.any():
                image[1:-1, 1:-1][gone] = 0
                changed = True
        if not changed:
            return image


def pieces(bits: int) -> int:
    """How many parts, touching by side or corner, the on-cells of a ring of eight make; bit k is cell k of RING."""
    on = [k for k in range(8) if bits >> k & 1]
    parts = 0
    while on:
        todo = [on.pop()]
        parts += 1
        while todo:
            a = RING[todo.pop()]
            for k in [k for k in on if max(abs(RING[k][0] - a[0]), abs(RING[k][1] - a[1])) == 1]:
                on.remove(k)
                todo.append(k)
    return parts


PIECES = np.array([pieces(b) for b in range(256)])


def simplified(image: np.ndarray) -> np.ndarray:
    """Without pixels of more than two neighbours that hold nothing together, in reading order, each after the ones before it; with centres of open pluses filled."""
    image = image.copy()
    for r, c in zip(*np.nonzero(image), strict=True):
        bits = sum(int(image[r + dr, c + dc]) << k for k, (dr, dc) in enumerate(RING))
        if bits.bit_count() > 2 and PIECES[bits] == 1:
            image[r, c] = 0
    p = around(image)
    plus = (image[1:-1, 1:-1] == 0) & (p[::2].sum(axis=0) == 4) & (p[1::2].sum(axis=0) == 0)
    image[1:-1, 1:-1][plus] = 1
    return image


def _holes_filled(image: np.ndarray, most: int) -> np.ndarray:
    image = image.copy()
    off = {(int(r), int(c)) for r, c in zip(*np.nonzero(image == 0), strict=True)}
    while off:
        start = off.pop()
        part, todo, edge = [start], [start], False
        while todo:
            r, c = todo.pop()
            edge |= r in (0, image.shape[0] - 1) or c in (0, image.shape[1] - 1)
            for q in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if q in off:
                    off.discard(q)
                    part.append(q)
                    todo.append(q)
        if not edge and len(part) <= most:
            for q in part:
                image[q] = 1
    return image


def skeleton_of(image: np.ndarray) -> np.ndarray:
    out = simplified(thinned(image))
    out = simplified(thinned(_holes_filled(out, 4)))
    return _holes_filled(out, 1)


def _pixels_of(image: np.ndarray, image_id, top: int, left: int) -> pd.DataFrame:
    r, c = np.nonzero(image)
    return pd.DataFrame({"image_id": image_id, "r": (r + top).astype(np.int32), "c": (c + left).astype(np.int32)})


def skeletonize(pixels: DataFrame) -> DataFrame:
    """image_id, r, c of the skeleton of each image."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        image, top, left = dense(frame, 2)
        return _pixels_of(skeleton_of(image), frame["image_id"].iloc[0], top, left)

    return pixels.groupBy("image_id").applyInPandas(work, "image_id long, r int, c int")


def simplify(pixels: DataFrame) -> DataFrame:
    """image_id, r, c: each image as simplified() leaves it."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        image, top, left = dense(frame, 2)
        return _pixels_of(simplified(image), frame["image_id"].iloc[0], top, left)

    return pixels.groupBy("image_id").applyInPandas(work, "image_id long, r int, c int")


def graph_of(image: np.ndarray) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int, list[tuple[int, int]]]]]:
    """Nodes (their pixels, in reading order of the first) and links (node, node, pixels from end to end) of a padded skeleton."""
    on = {(int(r), int(c)) for r, c in zip(*np.nonzero(image), strict=True)}
    near = {p: [q for dr, dc in RING if (q := (p[0] + dr, p[1] + dc)) in on] for p in on}
    node: dict[tuple[int, int], int] = {}
    nodes: list[list[tuple[int, int]]] = []
    for p in sorted(on):
        if p in node or len(near[p]) == 2:
            continue
        part, todo = [p], [p]
        node[p] = len(nodes)
        while len(near[p]) > 2 and todo:
            for q in near[todo.pop()]:
                if q not in node and len(near[q]) > 2:
                    node[q] = len(nodes)
                    part.append(q)
                    todo.append(q)
        nodes.append(sorted(part))
    links, used = [], set()

    def walk(start, step):
        path = [start, step]
        while path[-1] not in node:
            used.add(path[-1])
            path.append(next((q for q in near[path[-1]] if q != path[-2] and q not in path[1:]), start))
            if path[-1] == start and start not in node:
                break
        return path

    for k, part in enumerate(nodes):
        for p in part:
            for q in near[p]:
                if q in used:
                    continue
                if q in node:
                    if node[q] > k:
                        links.append((k, node[q], [p, q]))
                    continue
                path = walk(p, q)
                if node[path[-1]] != k or len(path) > 3:  # else a pixel at the side of its cluster
                    links.append((k, node[path[-1]], path))
    for p in sorted(on):  # rings
        if p not in node and p not in used:
            node[p] = len(nodes)
            nodes.append([p])
            path = walk(p, near[p][0])
            used.add(p)
            links.append((node[p], node[p], path))
    return nodes, links


def skeleton_links(pixels: DataFrame) -> DataFrame:
    """image_id, link_id, u, v, seq, r, c: the pixels of every link of each image's skeleton, from end to end."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        image, top, left = dense(frame)
        _, links = graph_of(image)
        rows = [(k, u, v, s, r + top, c + left) for k, (u, v, path) in enumerate(links) for s, (r, c) in enumerate(path)]
        out = pd.DataFrame(rows, columns=["link_id", "u", "v", "seq", "r", "c"])
        out.insert(0, "image_id", frame["image_id"].iloc[0])
        return out.astype({"link_id": "int64", "u": "int64", "v": "int64", "seq": "int32", "r": "int32", "c": "int32"})

    return pixels.groupBy("image_id").applyInPandas(work, "image_id long, link_id long, u long, v long, seq int, r int, c int")


def skeleton_nodes(pixels: DataFrame) -> DataFrame:
    """image_id, node_id, r, c (of its first pixel), pixels (how many it has)."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        image, top, left = dense(frame)
        nodes, _ = graph_of(image)
        out = pd.DataFrame([(k, p[0][0] + top, p[0][1] + left, len(p)) for k, p in enumerate(nodes)], columns=["node_id", "r", "c", "pixels"])
        out.insert(0, "image_id", frame["image_id"].iloc[0])
        return out.astype({"node_id": "int64", "r": "int32", "c": "int32", "pixels": "int64"})

    return pixels.groupBy("image_id").applyInPandas(work, "image_id long, node_id long, r int, c int, pixels long")


def pixel_turns(link_pixels: DataFrame, walk: int = 4) -> DataFrame:
    """With turn: degrees between the directions to the mean of the `walk` pixels before and after each pixel of a link; null near its ends."""
    from pyspark.sql import Window

    line = Window.partitionBy("image_id", "link_id").orderBy("seq")
    before, after = line.rowsBetween(-walk, -1), line.rowsBetween(1, walk)
    whole = (F.count("*").over(before) == walk) & (F.count("*").over(after) == walk)
    ax, ay = F.col("c") - F.avg("c").over(before), F.col("r") - F.avg("r").over(before)
    bx, by = F.avg("c").over(after) - F.col("c"), F.avg("r").over(after) - F.col("r")
    turn = F.pmod(F.degrees(F.atan2(by, bx) - F.atan2(ay, ax)) + 180, F.lit(360.0)) - 180
    return link_pixels.withColumn("turn", F.when(whole, turn))


def contracted(on: set[tuple[int, int]]) -> tuple[list[tuple[int, int]], dict[tuple[int, int], dict[tuple[int, int], tuple[float, list]]]]:
    """End pixels, and the graph of all pixels without two neighbours: pixel -> pixel -> (length, pixels between) of the shortest run that joins them."""
    near = {p: [q for dr, dc in RING if (q := (p[0] + dr, p[1] + dc)) in on] for p in on}
    graph: dict = {p: {} for p in on if len(near[p]) != 2}
    for p in sorted(graph):
        for q in near[p]:
            run, last, size = [], p, _step(p, q)
            while q not in graph:
                run.append(q)
                last, q = q, near[q][0] if near[q][0] != last else near[q][1]
                size += _step(last, q)
            if q != p and size < graph[p].get(q, (float("inf"),))[0] - 1e-9:
                graph[p][q] = (size, run)
    return sorted(p for p in on if len(near[p]) == 1), graph


def _step(p: tuple[int, int], q: tuple[int, int]) -> float:
    return 1.0 if p[0] == q[0] or p[1] == q[1] else 2**0.5


def longest_path(pixels: DataFrame) -> DataFrame:
    """image_id, seq, r, c: of the shortest paths between a skeleton's end pixels, all of them, the longest; of equal ones that from the first end in reading order."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        import heapq

        on = set(zip(frame["r"].tolist(), frame["c"].tolist(), strict=True))
        ends, graph = contracted(on)
        best: tuple[float, list] = (-1.0, sorted(on)[:1])
        for start in ends:
            dist, back, heap = {start: 0.0}, {}, [(0.0, start)]
            while heap:
                d, p = heapq.heappop(heap)
                if d > dist[p]:
                    continue
                for q, (size, _) in graph[p].items():
                    e = d + size
                    if e < dist.get(q, float("inf")) - 1e-9:
                        dist[q], back[q] = e, p
                        heapq.heappush(heap, (e, q))
            far = max((p for p in ends if p in dist), key=lambda p: (round(dist[p], 6), p))
            if dist[far] > best[0] + 1e-9:
                path = [far]
                while path[-1] != start:
                    before = back[path[-1]]
                    path += [*graph[before][path[-1]][1][::-1], before]
                best = (dist[far], path[::-1])
        path = best[1]
        return pd.DataFrame({"image_id": frame["image_id"].iloc[0], "seq": np.arange(len(path), dtype=np.int32), "r": np.array([p[0] for p in path], np.int32), "c": np.array([p[1] for p in path], np.int32)})

    return pixels.groupBy("image_id").applyInPandas(work, "image_id long, seq int, r int, c int")
