"""Neighbourhood and morphology operators on sparse rasters: relations (image_id, r, c) of on-pixels.

A neighbourhood is a scatter: every pixel sends itself to the cells around it and each cell sums up
what it gets, one shuffle on (image_id, r, c) with map-side sums, instead of a join per offset. What is
beside the image is off, unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXEL = ("image_id", "r", "c")

#: Neighbours in reading order, and those that share a side.
EIGHT = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))
FOUR = ((-1, 0), (0, -1), (0, 1), (1, 0))
#: Structuring elements; disk has radius 3.
STRELS = {
    "square": ((0, 0), *EIGHT),
    "plus": ((0, 0), *FOUR),
    "disk": tuple((dr, dc) for dr in range(-3, 4) for dc in range(-3, 4) if dr * dr + dc * dc <= 9),
}
#: Weights that make a 3x3 neighbourhood a number, by offset.
CODE = {(-1, -1): 256, (-1, 0): 32, (-1, 1): 4, (0, -1): 128, (0, 0): 16, (0, 1): 2, (1, -1): 64, (1, 0): 8, (1, 1): 1}


def offset_array(offsets: Iterable[Sequence[int]], *values: Sequence) -> Column:
    return F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), *[F.lit(v[k]).alias(f"v{j}") for j, v in enumerate(values)]) for k, (dr, dc) in enumerate(offsets)])


def scatter(pixels: DataFrame, offsets: Iterable[Sequence[int]], *values: Sequence) -> DataFrame:
    """Every pixel at the cells from which it is seen at an offset: image_id, r, c, dr, dc, v0 and so on, and the pixel's own from_r, from_c."""
    many = pixels.select(*PIXEL, F.explode(offset_array(offsets, *values)).alias("o"))
    return many.select("image_id", (F.col("r") - F.col("o.dr")).alias("r"), (F.col("c") - F.col("o.dc")).alias("c"), "o.*", F.col("r").alias("from_r"), F.col("c").alias("from_c"))


def neighbours(pixels: DataFrame) -> DataFrame:
    """image_id, r, c and the row and column nr, nc of each on-neighbour of an on-pixel."""
    seen = scatter(pixels, EIGHT).select(*PIXEL, F.col("from_r").alias("nr"), F.col("from_c").alias("nc"))
    return seen.join(pixels, list(PIXEL), "left_semi")


def neighbour_values(cells: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, r, c, place (0 to 7 in reading order) and v of a cell's eight neighbours; null outside the image."""
    want = cells.select(*PIXEL, F.posexplode(offset_array(EIGHT)).alias("place", "o"))
    want = want.select(*PIXEL, "place", (F.col("r") + F.col("o.dr")).alias("nr"), (F.col("c") + F.col("o.dc")).alias("nc"))
    there = cells.select("image_id", F.col("r").alias("nr"), F.col("c").alias("nc"), "v")
    return want.join(there, ["image_id", "nr", "nc"], "left").select(*PIXEL, "place", "v")


def connectivity(pixels: DataFrame, images: DataFrame | None = None, border: str = "reflect101") -> DataFrame:
    """image_id, r, c, conn: on-neighbours of each on-pixel.

    border "zero": outside is off. "reflect101": the image is mirrored about its border pixels, so a pixel one
    inside the border is seen a second time from the border; this needs images.
    """
    many = scatter(pixels, ((0, 0), *EIGHT), [0] + [1] * 8)
    if border == "reflect101":
        sized = pixels.join(images.select("image_id", "nrows", "ncols"), "image_id")
        back = lambda at, n, d: F.when((F.col(at) == 1) & (F.col("o." + d) == -1), F.lit(0)).when((F.col(at) == F.col(n) - 2) & (F.col("o." + d) == 1), F.col(n) - 1)
        # from a border cell, the offset that leads outside leads to the pixel one inside
        mirrored = sized.select("*", F.explode(offset_array(EIGHT)).alias("o"))
        rr, cc = back("r", "nrows", "dr"), back("c", "ncols", "dc")
        plain_r, plain_c = F.col("r") - F.col("o.dr"), F.col("c") - F.col("o.dc")
        extra = [
            mirrored.where(rr.isNotNull()).select("image_id", rr.alias("r"), plain_c.alias("c"), F.lit(1).alias("v0")),
            mirrored.where(cc.isNotNull()).select("image_id", plain_r.alias("r"), cc.alias("c"), F.lit(1).alias("v0")),
            mirrored.where(rr.isNotNull() & cc.isNotNull()).select("image_id", rr.alias("r"), cc.alias("c"), F.lit(1).alias("v0")),
        ]
        sums = many.select(*PIXEL, "v0", (F.col("dr") == 0) & (F.col("dc") == 0))
        sums = sums.toDF(*PIXEL, "v0", "own")
        for e in extra:
            sums = sums.unionByName(e.withColumn("own", F.lit(False)))
    else:
        sums = many.select(*PIXEL, "v0", ((F.col("dr") == 0) & (F.col("dc") == 0)).alias("own"))
    return sums.groupBy(*PIXEL).agg(F.sum("v0").alias("conn"), F.max("own").alias("own")).where("own").select(*PIXEL, "conn")


def four_connectivity(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, r, c, four: on-pixels' neighbours that share a side; 0 for pixels on the border."""
    sums = scatter(pixels, ((0, 0), *FOUR), [0] + [1] * 4).groupBy(*PIXEL).agg(F.sum("v0").alias("four"), F.max((F.col("v0") == 0).cast("int")).alias("own")).where("own = 1")
    sized = sums.join(images.select("image_id", "nrows", "ncols"), "image_id")
    edge = on_edge()
    return sized.select(*PIXEL, F.when(edge, F.lit(0)).otherwise(F.col("four")).cast("long").alias("four"))


def four_neighbours(pixels: DataFrame) -> DataFrame:
    """image_id, r, c and the on-neighbours that share a side, as an array of (r, c) in reading order."""
    seen = scatter(pixels, ((0, 0), *FOUR), [0] + [1] * 4)
    lists = seen.groupBy(*PIXEL).agg(F.sort_array(F.collect_list(F.when(F.col("v0") == 1, F.struct("from_r", "from_c")))).alias("near"), F.max((F.col("v0") == 0)).alias("own"))
    return lists.where("own").select(*PIXEL, "near")


def axes(pixels: DataFrame) -> DataFrame:
    """image_id, r, c, axes: how many of the four lines through an on-pixel have another on-pixel beside it."""
    line = {(-1, -1): 1, (1, 1): 1, (-1, 0): 2, (1, 0): 2, (-1, 1): 4, (1, -1): 4, (0, -1): 8, (0, 1): 8}
    seen = scatter(pixels, ((0, 0), *EIGHT), [0] + [line[o] for o in EIGHT])
    bits = seen.groupBy(*PIXEL).agg(F.bit_or("v0").alias("bits"), F.max(F.col("v0") == 0).alias("own")).where("own")
    return bits.select(*PIXEL, F.bit_count("bits").cast("long").alias("axes"))


def codes(pixels: DataFrame) -> DataFrame:
    """image_id, r, c, code: the 3x3 neighbourhood of each on-pixel as a number."""
    seen = scatter(pixels, CODE.keys(), list(CODE.values()))
    return seen.groupBy(*PIXEL).agg(F.sum("v0").cast("long").alias("code"), F.max(F.col("v0") == CODE[0, 0]).alias("own")).where("own").select(*PIXEL, "code")


def endpoints(pixels: DataFrame, images: DataFrame) -> DataFrame:
    return connectivity(pixels, images).where("conn = 1").select(*PIXEL)


def on_edge() -> Column:
    return (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == F.col("nrows") - 1) | (F.col("c") == F.col("ncols") - 1)


def edge_cells(images: DataFrame) -> DataFrame:
    """image_id, r, c of every border cell."""
    rows = images.select("image_id", "nrows", "ncols", F.explode(F.sequence(F.lit(0), F.col("nrows") - 1)).alias("r"))
    ends = F.array_distinct(F.array(F.lit(0), F.col("ncols") - 1))
    border = (F.col("r") == 0) | (F.col("r") == F.col("nrows") - 1)
    return rows.select("image_id", "r", F.explode(F.when(border, F.sequence(F.lit(0), F.col("ncols") - 1)).otherwise(ends)).alias("c"))


def inside(cells: DataFrame, images: DataFrame) -> DataFrame:
    """The cells that lie in their image."""
    sized = cells.join(images.select("image_id", "nrows", "ncols"), "image_id")
    return sized.where((F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < F.col("nrows")) & (F.col("c") < F.col("ncols"))).select(*cells.columns)


def dilate(pixels: DataFrame, images: DataFrame, n: int = 1, strel: str = "square") -> DataFrame:
    for _ in range(n):
        pixels = inside(scatter(pixels, STRELS[strel]).select(*PIXEL).distinct(), images)
    return pixels


def erode(pixels: DataFrame, images: DataFrame, n: int = 1, strel: str = "square") -> DataFrame:
    """On-pixels all of whose cells under strel that lie in the image are on."""
    shape = STRELS[strel]
    for _ in range(n):
        own = scatter(pixels, shape, [int(o == (0, 0)) for o in shape]).groupBy(*PIXEL).agg(F.count("*").alias("n"), F.max("v0").alias("own")).where("own = 1")
        sized = own.join(images.select("image_id", "nrows", "ncols"), "image_id")
        there = F.size(F.filter(offset_array(shape), lambda o: (F.col("r") + o["dr"] >= 0) & (F.col("c") + o["dc"] >= 0) & (F.col("r") + o["dr"] < F.col("nrows")) & (F.col("c") + o["dc"] < F.col("ncols"))))
        pixels = sized.where(F.col("n") == there).select(*PIXEL)
    return pixels


def opened(pixels: DataFrame, images: DataFrame, strel: str = "square") -> DataFrame:
    return dilate(erode(pixels, images, 1, strel), images, 1, strel)


def window(cells: DataFrame, r: int, c: int, height: int, width: int) -> DataFrame:
    """The cells of the window around (r, c), with wr, wc counted from its upper left."""
    top, left = r - height // 2, c - width // 2
    own = cells.where(F.col("r").between(top, top + height - 1) & F.col("c").between(left, left + width - 1))
    return own.withColumn("wr", F.col("r") - top).withColumn("wc", F.col("c") - left)


def overlay(a: DataFrame, b: DataFrame) -> DataFrame:
    """image_id, r, c, code: 1 where both are on, 2 where only a is, 3 where only b is."""
    both = a.withColumn("in_a", F.lit(1)).join(b.withColumn("in_b", F.lit(1)), list(PIXEL), "full")
    return both.select(*PIXEL, F.when(F.col("in_b").isNull(), 2).when(F.col("in_a").isNull(), 3).otherwise(1).alias("code"))


def crop(pixels: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pixels counted from their bounding box, and per image the box's size and the pads left, top, right, bottom."""
    box = pixels.groupBy("image_id").agg(*[f(x).alias(f"{n}_{x}") for f, n in ((F.min, "min"), (F.max, "max")) for x in ("r", "c")])
    sized = images.select("image_id", "nrows", "ncols").join(box, "image_id")
    pads = sized.select(
        "image_id", F.col("min_c").alias("pad_left"), F.col("min_r").alias("pad_top"), (F.col("ncols") - 1 - F.col("max_c")).alias("pad_right"), (F.col("nrows") - 1 - F.col("max_r")).alias("pad_bottom"),
        (F.col("max_r") - F.col("min_r") + 1).alias("height"), (F.col("max_c") - F.col("min_c") + 1).alias("width"),
    )
    moved = pixels.join(box.select("image_id", "min_r", "min_c"), "image_id").select("image_id", (F.col("r") - F.col("min_r")).alias("r"), (F.col("c") - F.col("min_c")).alias("c"))
    return moved, pads


def downsample(pixels: DataFrame, images: DataFrame, height: int, width: int, least: float = 0.05) -> DataFrame:
    """On-cells of a coarser grid: those whose share of on-pixels is at least `least`."""
    sized = pixels.join(images.select("image_id", "nrows", "ncols"), "image_id")
    fr, fc = F.lit(float(height)) / F.col("nrows"), F.lit(float(width)) / F.col("ncols")
    coarse = sized.select("image_id", F.floor(F.col("r") * fr).cast("int").alias("r"), F.floor(F.col("c") * fc).cast("int").alias("c"), (fr * fc).alias("share"))
    return coarse.groupBy("image_id", "r", "c").agg((F.count("*") * F.first("share")).alias("share")).where(F.col("share") >= least).select(*PIXEL)


def plus_fill(pixels: DataFrame) -> DataFrame:
    """With the centres of four on-pixels that form a plus with no corner on, which thinning leaves open."""
    kinds = {o: (10 if o in FOUR else 1) for o in EIGHT}
    sums = scatter(pixels, ((0, 0), *EIGHT), [100] + [kinds[o] for o in EIGHT]).groupBy(*PIXEL).agg(F.sum("v0").alias("s")).where("s = 40")
    return pixels.unionByName(sums.select(*PIXEL))


def pad_rows(pixels: DataFrame, images: DataFrame, sides: str, pads: int) -> DataFrame:
    """Pixels continued beyond the exit sides (of n, e, s, w) by repeating the border row or column pads times; coordinates may be outside."""
    sized = pixels.join(images.select("image_id", "nrows", "ncols"), "image_id")
    out = pixels
    for side in sides:
        at, last, sign = {"n": ("r", F.lit(0), -1), "w": ("c", F.lit(0), -1), "s": ("r", F.col("nrows") - 1, 1), "e": ("c", F.col("ncols") - 1, 1)}[side]
        own = sized.where(F.col(at) == last).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(pads))))
        out = out.unionByName(own.withColumn(at, F.col(at) + sign * F.col("k")).select(*PIXEL))
    return out


def points_in_polygons(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """image_id, r, c of the cells whose centre is in a polygon, by the parity of the edges (image_id, r1, c1, r2, c2) to its right.

    Cells and edges meet in rows.
    """
    rows = F.sequence(F.ceil(F.least("r1", "r2")).cast("int"), F.greatest(F.ceil(F.least("r1", "r2")), F.floor(F.greatest("r1", "r2"))).cast("int"))
    hits = cells.join(edges.withColumn("r", F.explode(rows)), ["image_id", "r"]).where((F.col("r1") <= F.col("r")) != (F.col("r2") <= F.col("r")))
    run = F.col("r2") - F.col("r1")
    hits = hits.where(F.col("c") < F.col("c1") + (F.col("r") - F.col("r1")) * (F.col("c2") - F.col("c1")) / F.when(run != 0, run))
    return hits.groupBy(*PIXEL).agg(F.count("*").alias("n")).where("n % 2 = 1").select(*PIXEL)
