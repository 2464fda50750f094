"""Sources and sinks: networks as tables, vectors as GeoJSON text, rasters as GeoTIFF bytes.

Files are read with Spark's own readers (binaryFile, text) and written with its writers, so any store Spark
opens will do; raster bytes are coded here, for single-band images in strips, plain, Deflate or LZW.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Networks


def write_network(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_network(spark: SparkSession, path: str, names: tuple[str, ...] = ("links", "nodes")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def manual_directions(spark: SparkSession, path: str) -> DataFrame:
    """link_id, usnode from a csv file with that header."""
    return spark.read.csv(path, header=True, schema="link_id long, usnode long")


def write_manual_template(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], "link_id long, usnode long").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


# Vectors


def _feature(geometry, columns: list[str]):
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*columns).alias("properties")))


def point_features(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """value: a GeoJSON feature per row, all other columns its properties."""
    rest = [c for c in df.columns if c not in (x, y)]
    return df.select(_feature(F.struct(F.lit("Point").alias("type"), F.array(F.col(x), F.col(y)).alias("coordinates")), rest).alias("value"))


def line_features(vertices: DataFrame, key: str, properties: DataFrame | None = None) -> DataFrame:
    """value: a GeoJSON LineString per key of vertices (key, seq, x, y), with the properties table's columns."""
    lines = vertices.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.array(p["x"], p["y"])).alias("_xy"))
    lines = lines.join(properties, key, "left") if properties is not None else lines
    rest = [c for c in lines.columns if c != "_xy"]
    return lines.select(_feature(F.struct(F.lit("LineString").alias("type"), F.col("_xy").alias("coordinates")), rest).alias("value"))


def polygon_features(cells: DataFrame, ring: str = "ring") -> DataFrame:
    """value: a GeoJSON Polygon per row, from its ring (structs of x and y, not closed)."""
    closed = F.concat(F.col(ring), F.slice(ring, 1, 1))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(closed, lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))
    return cells.select(_feature(geometry, [c for c in cells.columns if c != ring]).alias("value"))


def write_features(features: DataFrame, path: str) -> None:
    """One feature a line (GeoJSON text sequences without the separator)."""
    features.select("value").write.mode("overwrite").text(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """feature_id, kind, part, seq, x, y, properties (JSON) of features, one a line or in a collection, for points, lines and polygons."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.regexp_replace("value", r"\r", ""), r"\n(?=\s*\{\s*\"type\"\s*:\s*\"Feature)")).alias("value"))
    shape = "struct<type: string, geometry: struct<type: string, coordinates: string>, properties: string, features: array<struct<geometry: struct<type: string, coordinates: string>, properties: string>>>"
    parsed = text.where("trim(value) <> ''").select(F.from_json("value", shape).alias("f"))
    one = F.array(F.struct(F.col("f.geometry").alias("geometry"), F.col("f.properties").alias("properties")))
    each = parsed.select(F.explode(F.when(F.col("f.type") == "FeatureCollection", F.col("f.features")).otherwise(one)).alias("f"))
    each = each.withColumn("feature_id", F.monotonically_increasing_id())
    kind = F.col("f.geometry.type")
    xy = F.col("f.geometry.coordinates")
    parts = (
        F.when(kind == "Point", F.array(F.array(F.from_json(xy, "array<double>"))))
        .when(kind.isin("LineString", "MultiPoint"), F.array(F.from_json(xy, "array<array<double>>")))
        .when(kind.isin("Polygon", "MultiLineString"), F.from_json(xy, "array<array<array<double>>>"))
        .otherwise(F.flatten(F.from_json(xy, "array<array<array<array<double>>>>")))
    )
    out = each.select("feature_id", kind.alias("kind"), F.col("f.properties").alias("properties"), F.posexplode(parts).alias("part", "line"))
    return out.select("feature_id", "kind", "part", F.posexplode("line").alias("seq", "p"), "properties").select("feature_id", "kind", "part", "seq", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), "properties")


def centroids(features: DataFrame) -> DataFrame:
    """feature_id, x, y: of points their mean, of lines and rings the mean of segments' middles by length."""
    from pyspark.sql import Window

    w = Window.partitionBy("feature_id", "part").orderBy("seq")
    size = F.hypot(F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y"))
    mid = lambda c: (F.lead(c).over(w) + F.col(c)) / 2
    seg = features.withColumns({"_l": size, "_x": mid("x"), "_y": mid("y")})
    g = seg.groupBy("feature_id").agg(F.sum("_l").alias("l"), F.sum(F.col("_l") * F.col("_x")).alias("sx"), F.sum(F.col("_l") * F.col("_y")).alias("sy"), F.avg("x").alias("ax"), F.avg("y").alias("ay"))
    long = F.coalesce(F.col("l"), F.lit(0.0)) > 0
    return g.select("feature_id", F.when(long, F.col("sx") / F.when(long, F.col("l"))).otherwise(F.col("ax")).alias("x"), F.when(long, F.col("sy") / F.when(long, F.col("l"))).otherwise(F.col("ay")).alias("y"))


# Rasters

#: TIFF tags, and types of their values with formats.
_TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "offsets": 273, "samples": 277, "rows": 278, "counts": 279, "predictor": 317, "colors": 320, "format": 339, "scale": 33550, "tie": 33922, "nodata": 42113}
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}


def _lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, the highest first."""
    out, table = bytearray(), []
    bits = size = at = 0
    previous = b""
    width = 9
    while True:
        while size < width:
            if at >= len(data):
                return bytes(out)
            bits, size, at = (bits << 8 | data[at]) & 0xFFFFFF, size + 8, at + 1
        size -= width
        code = bits >> size & ((1 << width) - 1)
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, previous = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else previous + previous[:1]
        out += entry
        if previous:
            table.append(previous + entry[:1])
        previous = entry
        width = 9 + sum(len(table) >= n - 1 for n in (512, 1024, 2048))


def decode_geotiff(data: bytes) -> tuple[np.ndarray, list[float]]:
    """The first band and the geotransform."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    tags: dict[int, tuple] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in _TYPES:
            continue
        code = f"{count}{_TYPES[kind]}"
        size = struct.calcsize(order + code)
        place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        tags[tag] = struct.unpack_from(order + code, data, place)
    get = lambda name, default=None: tags.get(_TAGS[name], default)
    height, width = get("height")[0], get("width")[0]
    bits, form = get("bits", (1,))[0], get("format", (1,))[0]
    raw = b"".join({1: lambda x: x, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress}[get("compression", (1,))[0]](data[o : o + c]) for o, c in zip(get("offsets"), get("counts"), strict=True))
    if bits == 1:
        image = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(height, -1), axis=1)[:, :width]
    else:
        kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[form]}{bits // 8}")
        image = np.frombuffer(raw, kind)[: height * width * get("samples", (1,))[0]].reshape(height, width, -1)[:, :, 0].astype(kind.newbyteorder("="))
        if get("predictor", (1,))[0] == 2:
            image = np.cumsum(image, axis=1, dtype=image.dtype)
    scale, tie = get("scale"), get("tie")
    gt = [tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] + tie[1] * scale[1], 0.0, -scale[1]] if scale and tie else [0.0, 1.0, 0.0, float(width), 0.0, -1.0]
    return image, gt


def encode_geotiff(image: np.ndarray, gt: list[float], nodata: float | None = None, colors: np.ndarray | None = None) -> bytes:
    """One band in Deflate strips; colors: for 8-bit images a table of 256 rows of red, green, blue (0 to 255)."""
    image = np.ascontiguousarray(image)
    height, width = image.shape
    rows = max(1, (1 << 16) // max(1, width * image.itemsize))
    strips = [zlib.compress(image[r : r + rows].astype(image.dtype.newbyteorder("<")).tobytes()) for r in range(0, height, rows)]
    form = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    begin, offsets = 8, []
    for s in strips:
        offsets.append(begin)
        begin += len(s)
    values: dict[str, tuple[int, tuple]] = {
        "width": (4, (width,)), "height": (4, (height,)), "bits": (3, (8 * image.itemsize,)), "compression": (3, (8,)), "photometric": (3, (1 if colors is None else 3,)), "offsets": (4, tuple(offsets)),
        "samples": (3, (1,)), "rows": (4, (rows,)), "counts": (4, tuple(map(len, strips))), "format": (3, (form,)), "scale": (12, (gt[1], -gt[5], 0.0)), "tie": (12, (0.0, 0.0, 0.0, gt[0], gt[3], 0.0)),
    }
    if colors is not None:
        values["colors"] = (3, tuple((np.asarray(colors, int).T * 257).ravel().tolist()))
    if nodata is not None:
        values["nodata"] = (2, (f"{nodata:g}\0".encode(),))
    entries = sorted((_TAGS[k], v) for k, v in values.items())
    extra_at = begin + 2 + 12 * len(entries) + 4
    directory, extra = struct.pack("<H", len(entries)), b""
    for tag, (kind, v) in entries:
        packed = v[0] if kind == 2 else struct.pack(f"<{len(v)}{_TYPES[kind]}", *v)
        count = len(v[0]) if kind == 2 else len(v)
        if len(packed) > 4:
            place, extra = struct.pack("<I", extra_at + len(extra)), extra + packed + b"\0" * (len(packed) % 2)
        else:
            place = packed.ljust(4, b"\0")
        directory += struct.pack("<HHI", tag, kind, count) + place
    return struct.pack("<2sHI", b"II", 42, begin) + b"".join(strips) + directory + struct.pack("<I", 0) + extra


def read_geotiffs(spark: SparkSession, path: str) -> DataFrame:
    """image_id (the path), nrows, ncols, gt, r, c, v of the cells that aren't 0; a row with null r for an image without any."""

    def decode(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                image, gt = decode_geotiff(bytes(content))
                r, c = np.nonzero(image)
                out = pd.DataFrame({"r": pd.array(r, "Int32"), "c": pd.array(c, "Int32"), "v": image[r, c].astype(float)}) if len(r) else pd.DataFrame({"r": pd.array([None], "Int32"), "c": pd.array([None], "Int32"), "v": [None]})
                for at in range(0, len(out), 500_000):
                    part = out.iloc[at : at + 500_000].copy()
                    part.insert(0, "gt", [gt] * len(part))
                    part.insert(0, "ncols", image.shape[1])
                    part.insert(0, "nrows", image.shape[0])
                    part.insert(0, "image_id", name)
                    yield part

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, "image_id string, nrows int, ncols int, gt array<double>, r int, c int, v double")


def geotiff_bytes(cells: DataFrame, images: DataFrame, kind: str = "float32", nodata: float | None = None) -> DataFrame:
    """image_id, content: each image's cells (r, c, v) as a file's bytes. A task holds one image."""
    both = images.select("image_id", "nrows", "ncols", "gt").join(cells.select("image_id", "r", "c", "v"), "image_id", "left")

    def encode(frame: pd.DataFrame) -> pd.DataFrame:
        image = np.full((int(frame["nrows"].iloc[0]), int(frame["ncols"].iloc[0])), 0 if nodata is None else nodata, kind)
        own = frame[frame["r"].notna()]
        image[own["r"].astype(int), own["c"].astype(int)] = own["v"]
        return pd.DataFrame({"image_id": [frame["image_id"].iloc[0]], "content": [encode_geotiff(image, list(frame["gt"].iloc[0]), nodata)]})

    return both.groupBy("image_id").applyInPandas(encode, f"image_id {images.schema['image_id'].dataType.simpleString()}, content binary")


def color_table(kind: str) -> np.ndarray:
    """256 colours for 'binary' and 'mask' (white on black), 'skel' (red on black) and 'GSW' (shades of blue)."""
    out = np.zeros((256, 3), int)
    if kind == "GSW":
        out[:, 2] = np.arange(256)
    elif kind == "skel":
        out[1] = (255, 0, 0)
    elif kind in ("binary", "mask", "tile"):
        out[1] = 255
    else:
        raise ValueError(f"no such colour table: {kind}")
    return out


def feature_collection(features: DataFrame) -> str:
    """The whole as one GeoJSON text, for small results."""
    return json.dumps({"type": "FeatureCollection", "features": [json.loads(r.value) for r in features.collect()]})
