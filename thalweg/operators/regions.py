"""Connected components of sparse rasters, and what is made of them: blobs, holes, islands, distances.

An image is cut into tiles of TILE by TILE cells, and pixels are labelled within their tile by one task. Only pixels at
the seams of tiles, and one row per component of a tile, go on: their labels spread by rounds of least label and of the
label's own label, each a join and a sum with map-side combine, written to the shared folder. So no image has to fit
into a task, and an image of one tile takes no round.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thalweg.operators.raster import EIGHT, FOUR, PIXEL, inside, offset_array, on_edge, scatter

#: Rows and columns of an image that a task labels at once.
TILE = 512

#: Cells of the images that a task sorts, on average.
PART = 1 << 17

#: Rows of an image that the second pass of distances takes at once.
ROWS = 32


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the session's checkpoint folder, or beside the session's tables (in the warehouse) if that is unset: its lineage ends there."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/thalweg-work"
    path = f"{folder}/stages/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join that shuffles both: cells take so little room in a file that Spark would send them all through the driver to every executor; the images' sizes, a row for each, are what is sent."""
    return df.hint("merge")


def least_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (g, n) with label: the least n of each component of edges (g, a, b), given in both directions, within a group g."""
    edges = stored(edges.select("g", "a", "b"))
    labels = nodes.select("g", "n", F.col("n").alias("label"), F.col("n").alias("was"))
    first = True
    while True:
        beside = edges.join(dealt(labels.select("g", F.col("n").alias("b"), "label")), ["g", "b"]).groupBy("g", "a").agg(F.min("label").alias("m"))
        near = labels.join(dealt(beside.withColumnRenamed("a", "n")), ["g", "n"], "left").select("g", "n", F.col("label").alias("was"), F.least("label", F.coalesce("m", "label")).alias("label"))
        near = stored(near)
        up = near.select("g", F.col("n").alias("label"), F.col("label").alias("next"))
        labels = stored(near.join(dealt(up), ["g", "label"]).select("g", "n", F.col("next").alias("label"), "was"))
        if not first and not labels.where("label <> was").limit(1).count():
            return labels.select("g", "n", "label")
        first = False


def spread(df: DataFrame, images: DataFrame, *keys: str) -> DataFrame:
    """df by keys over as many tasks as the images' cells need: pixels take hardly any room in a shuffle, so tasks sized by bytes grow with the input."""
    cells = images.agg(F.sum(F.col("nrows").cast("long") * F.col("ncols"))).first()[0] or 0
    return df.repartition(int(cells // PART) + 1, *keys)


def tile_labels(r: np.ndarray, c: np.ndarray, connectivity: int) -> np.ndarray:
    """For each pixel the place in r and c of its component's first pixel, by row and column."""
    width = int(c.max()) - int(c.min()) + 3
    flat, place, own = np.unique((r.astype("int64") - int(r.min())) * width + (c - int(c.min()) + 1), return_index=True, return_inverse=True)
    n = len(flat)
    pairs = []
    for ahead in (1, width) if connectivity == 1 else (1, width - 1, width, width + 1):
        at = np.searchsorted(flat, flat + ahead)
        found = np.flatnonzero(flat[np.minimum(at, n - 1)] == flat + ahead)
        pairs.append((found, at[found]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    up = np.arange(n)
    while len(a):  # roots are hung under lesser roots until all pairs have one root
        ra, rb = up[a], up[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(up, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while not np.array_equal(up, above := up[up]):
            up = above
    return place[up][own]


def label(pixels: DataFrame, images: DataFrame, connectivity: int = 2, tile: int = TILE) -> DataFrame:
    """image_id, r, c, label: components of on-pixels; a label is its component's least flat index. connectivity 1: sides; 2: corners too."""
    return sized_labels(pixels, images, connectivity, tile).select(*PIXEL, "label")


def sized_labels(pixels: DataFrame, images: DataFrame, connectivity: int, tile: int = TILE) -> DataFrame:
    """As label, with the image's nrows and ncols at every pixel, so that none has to meet its image again."""
    sized = pixels.select(*PIXEL).join(F.broadcast(images.select("image_id", "nrows", "ncols")), "image_id")

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        r, c, nrows, ncols = (frame[x].to_numpy() for x in ("r", "c", "nrows", "ncols"))
        first = tile_labels(r, c, connectivity)
        return pd.DataFrame({"image_id": frame["image_id"], "r": r, "c": c, "nrows": nrows, "ncols": ncols, "label": (r.astype("int64") * ncols + c)[first]})

    kind = dict(pixels.dtypes)
    schema = f"image_id {kind['image_id']}, r int, c int, nrows int, ncols int, label long"
    tiled = sized.withColumns({"tr": F.expr(f"r div {tile}"), "tc": F.expr(f"c div {tile}")})
    own = stored(spread(tiled, images, "image_id", "tr", "tc").groupBy("image_id", "tr", "tc").applyInPandas(work, schema))
    flat = lambda r, c: F.col(r).cast("long") * F.col("ncols") + F.col(c)
    large = images.where((F.col("nrows") > tile) | (F.col("ncols") > tile)).select("image_id")
    if not large.limit(1).count():
        return own
    seam = lambda x: (F.col(x) % tile == 0) | (F.col(x) % tile == tile - 1)
    seams = own.join(large, "image_id", "left_semi").where(seam("r") | seam("c"))
    seen = scatter(seams.select(*PIXEL), EIGHT if connectivity == 2 else FOUR)
    apart = lambda x: F.expr(f"{x} div {tile} <> from_{x} div {tile}")
    at = lambda a, b, name: dealt(seams.select("image_id", F.col("r").alias(a), F.col("c").alias(b), F.col("label").alias(name)))
    both = seen.where(apart("r") | apart("c")).join(at("r", "c", "a"), list(PIXEL)).join(at("from_r", "from_c", "b"), ["image_id", "from_r", "from_c"])
    edges = stored(both.select(F.col("image_id").alias("g"), "a", "b").distinct())
    joined = least_labels(edges.select("g", F.col("a").alias("n")).distinct(), edges)
    least = joined.select(F.col("g").alias("image_id"), F.col("n").alias("label"), F.col("label").alias("least"))
    return own.join(dealt(least), ["image_id", "label"], "left").withColumn("label", F.coalesce("least", "label")).drop("least")


def areas(labels: DataFrame) -> DataFrame:
    return labels.groupBy("image_id", "label").agg(F.count("*").alias("area"))


def remove_blobs(labels: DataFrame, least: int) -> DataFrame:
    """Pixels of blobs of at least `least` pixels."""
    return labels.join(dealt(areas(labels).where(F.col("area") >= least)), ["image_id", "label"], "left_semi").select(*PIXEL)


def largest_blobs(labels: DataFrame, n: int = 1, action: str = "keep") -> DataFrame:
    """Pixels of each image's n largest blobs (of equal areas the least label first), or of the others."""
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("area"), "label"))
    top = areas(labels).withColumn("k", rank).where(F.col("k") <= n)
    return labels.join(dealt(top), ["image_id", "label"], "left_semi" if action == "keep" else "left_anti").select(*PIXEL)


def moments(labels: DataFrame) -> DataFrame:
    """Per blob: area, centroid, axes of the ellipse with its second moments, eccentricity and its square, equivalent diameter, extent.

    Second moments are made of sums of whole numbers, which are the same in any order of the pixels.
    """
    r, c = F.col("r").cast("long"), F.col("c").cast("long")
    whole = lambda x: F.sum(x.cast("decimal(19,0)"))
    g = labels.groupBy("image_id", "label").agg(
        F.count("*").alias("area"), F.avg("r").alias("centroid_r"), F.avg("c").alias("centroid_c"),
        F.sum(r).alias("sr"), F.sum(c).alias("sc"), whole(r * r).alias("srr"), whole(c * c).alias("scc"), whole(r * c).alias("src"),
        F.min("r").alias("min_r"), F.max("r").alias("max_r"), F.min("c").alias("min_c"), F.max("c").alias("max_c"),
    )
    n = lambda x: F.col(x).cast("decimal(19,0)")
    covariance = lambda ab, a, b: (n("area") * F.col(ab) - n(a) * n(b)).cast("double") / F.col("area").cast("double") ** 2
    rr, cc, rc = covariance("srr", "sr", "sr") + 1 / 12, covariance("scc", "sc", "sc") + 1 / 12, covariance("src", "sr", "sc")  # 1 / 12: of a pixel itself
    mid, spread = (rr + cc) / 2, F.sqrt(((rr - cc) / 2) ** 2 + rc**2)
    big, small = mid + spread, F.greatest(mid - spread, F.lit(0.0))
    return g.select(
        "image_id", "label", "area", "centroid_r", "centroid_c", "min_r", "max_r", "min_c", "max_c",
        (4 * F.sqrt(big)).alias("major_axis"), (4 * F.sqrt(small)).alias("minor_axis"),
        F.sqrt(1 - small / big).alias("eccentricity"), (1 - small / big).alias("eccentricity2"), F.sqrt(4 * F.col("area") / F.pi()).alias("equivalent_diameter"),
        (F.col("area") / ((F.col("max_r") - F.col("min_r") + 1) * (F.col("max_c") - F.col("min_c") + 1))).alias("extent"),
    )


def values_of(labels: DataFrame, cells: DataFrame) -> DataFrame:
    """Per blob the mean, least and greatest value of its cells."""
    return labels.join(dealt(cells), list(PIXEL)).groupBy("image_id", "label").agg(F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("greatest"))


def seen_from(labels: DataFrame, offsets: Iterable[Sequence[int]]) -> DataFrame:
    """image_id, r, c of the cells from which a labelled pixel is seen at an offset, with its label, from_r and from_c."""
    many = labels.select(*PIXEL, "label", F.explode(offset_array(offsets)).alias("o"))
    return many.select("image_id", (F.col("r") - F.col("o.dr")).alias("r"), (F.col("c") - F.col("o.dc")).alias("c"), "label", F.col("r").alias("from_r"), F.col("c").alias("from_c"))


def perimeter_pixels(labels: DataFrame) -> DataFrame:
    """Per blob its pixels with a side toward another blob or off, and how many such sides there are."""
    near = labels.select(*PIXEL, F.col("label").alias("there"))
    sides = seen_from(labels, FOUR).join(dealt(near), list(PIXEL), "left").where("there IS NULL OR there <> label")
    per = sides.groupBy("image_id", "label", "from_r", "from_c").agg(F.count("*").alias("n"))
    return per.groupBy("image_id", "label").agg(F.count("*").alias("perimeter_pixels"), F.sum("n").alias("perimeter_sides"))


def complement(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """Off-cells."""
    rows = images.select("image_id", "ncols", F.explode(F.sequence(F.lit(0), F.col("nrows") - 1)).alias("r"))
    every = rows.select("image_id", "r", F.explode(F.sequence(F.lit(0), F.col("ncols") - 1)).alias("c"))
    return every.join(dealt(pixels.select(*PIXEL)), list(PIXEL), "left_anti")


def holes(pixels: DataFrame, images: DataFrame, connectivity: int = 1) -> DataFrame:
    """image_id, r, c, label of the components of off-cells that don't reach the border."""
    off = sized_labels(complement(pixels, images), images, connectivity)
    border = off.where(on_edge()).select("image_id", "label").distinct()
    return off.select(*PIXEL, "label").join(dealt(border), ["image_id", "label"], "left_anti")


def fill_holes(pixels: DataFrame, images: DataFrame, most: int = 0) -> DataFrame:
    """With the holes of up to `most` cells filled; 0 fills all."""
    found = holes(pixels, images)
    if most:
        found = found.join(dealt(areas(found).where(F.col("area") <= most)), ["image_id", "label"], "left_semi")
    return pixels.select(*PIXEL).unionByName(found.select(*PIXEL))


def distances(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, r, c, d: exact Euclidean distance of each on-pixel to the nearest off-cell; null in an image with none.

    Two passes, as distance separates: along each column by window, then along each row the least sum of that and the
    squared way; the second pass takes up to ROWS rows of an image at once.
    """
    rows = images.select("image_id", "nrows", "ncols", F.explode(F.sequence(F.lit(0), F.col("nrows") - 1)).alias("r"))
    every = rows.select("image_id", "ncols", "r", F.explode(F.sequence(F.lit(0), F.col("ncols") - 1)).alias("c"))
    every = spread(every.join(dealt(pixels.select(*PIXEL, F.lit(1).alias("on"))), list(PIXEL), "left"), images, "image_id", "c")
    off_r = F.when(F.col("on").isNull(), F.col("r"))
    down = Window.partitionBy("image_id", "c").orderBy("r")
    up = Window.partitionBy("image_id", "c").orderBy(F.desc("r"))
    far = F.least(F.coalesce(F.col("r") - F.max(off_r).over(down), F.lit(1 << 20)), F.coalesce(F.min(off_r).over(up) - F.col("r"), F.lit(1 << 20)))
    first = spread(every.select(*PIXEL, "on", far.cast("double").alias("far"), F.expr(f"r div {ROWS}").alias("rows")), images, "image_id", "rows")

    def along_rows(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["r", "c"])
        f = frame["far"].to_numpy().reshape(frame["r"].nunique(), -1) ** 2
        d, at = np.empty_like(f), np.arange(f.shape[1])
        if f.shape[1] <= 512:
            for p in range(f.shape[1]):
                d[:, p] = (f + (at - p) ** 2).min(axis=1)
        else:
            for k in range(len(f)):
                d[k] = _envelope(f[k])
        d = d.ravel()
        out = frame[["image_id", "r", "c"]].copy()
        out["d"] = np.where(d >= float(1 << 40), np.nan, np.sqrt(d))
        return out[frame["on"].notna().to_numpy()]

    found = first.groupBy("image_id", "rows").applyInPandas(along_rows, "image_id long, r int, c int, d double")
    return found.withColumn("d", F.nanvl("d", F.lit(None).cast("double")))


def _envelope(f: np.ndarray) -> np.ndarray:
    """min over q of f[q] + (p - q)**2 for each p, by the lower envelope of the parabolas."""
    n = len(f)
    at, bounds = [0], [-np.inf]
    for q in range(1, n):
        while True:
            v = at[-1]
            cross = (f[q] + q * q - f[v] - v * v) / (2 * (q - v))
            if cross > bounds[-1] or len(at) == 1:
                break
            at.pop()
            bounds.pop()
        if cross <= bounds[-1]:
            at[-1] = q
        else:
            at.append(q)
            bounds.append(cross)
    k = np.searchsorted(np.array(bounds), np.arange(n), side="right") - 1
    v = np.array(at)[np.maximum(k, 0)]
    return f[v] + (np.arange(n) - v) ** 2


def islands(pixels: DataFrame, images: DataFrame, pixlen: float = 1.0) -> DataFrame:
    """Components of off-cells away from the border: area, axes, centroid and greatest width (twice the greatest distance to the channel) in units of pixlen."""
    found = stored(holes(pixels, images, connectivity=2))
    shape = moments(found)
    d = distances(found.select(*PIXEL), images)
    wide = found.join(dealt(d), list(PIXEL)).groupBy("image_id", "label").agg((2 * F.max("d") * pixlen).alias("max_width"))
    return shape.join(dealt(wide), ["image_id", "label"]).select(
        "image_id", "label", (F.col("area") * pixlen * pixlen).alias("area"), (F.col("major_axis") * pixlen).alias("major_axis"),
        (F.col("minor_axis") * pixlen).alias("minor_axis"), "max_width", "centroid_r", "centroid_c",
    )


def island_threshold(apex_width: float, area="area", major="major_axis", sur_area="sur_area", sur_wid="sur_avg_wid") -> Column:
    """Whether an island is too small to count: by area, length, share of the area around it, or width beside the channels'."""
    a, m = F.col(area), F.col(major)
    small = (a < (0.1 * apex_width) ** 2) | (m < apex_width / 4) | (a / F.col(sur_area) < 0.01) | (a / m / F.col(sur_wid) < 0.1)
    return F.coalesce(small, F.lit(False)) & ~F.coalesce(m > apex_width, F.lit(False))


def surrounding(pixels: DataFrame, found: DataFrame, images: DataFrame, link_cells: DataFrame) -> DataFrame:
    """Per island (image_id, label of its cells) the links (image_id, r, c, link_id) of the channel that touches it: their ids, and the area of water around it.

    The water around an island is the on-pixels within the ring that reaches its links: here those that touch it.
    """
    ring = seen_from(found, EIGHT).select(*PIXEL, "label").distinct()
    touched = ring.join(dealt(inside(pixels.select(*PIXEL), F.broadcast(images))), list(PIXEL), "left_semi")
    with_links = touched.join(dealt(link_cells.select(*PIXEL, "link_id")), list(PIXEL), "left")
    return with_links.groupBy("image_id", "label").agg(F.countDistinct("r", "c").alias("ring_area"), F.sort_array(F.collect_set("link_id")).alias("link_ids"))


def max_valley_width(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """image_id and twice the greatest distance inside the hole-filled largest blob."""
    big = stored(fill_holes(largest_blobs(label(pixels, images)), images))
    return distances(big, images).groupBy("image_id").agg((2 * F.max("d")).alias("max_valley_width"))


