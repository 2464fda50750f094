"""Ordered vertices: relations (series_id, seq, x, y) of lines, with windows along them."""

from __future__ import annotations

from functools import lru_cache
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def along():
    """The window along a line, its vertices in order."""
    return Window.partitionBy("series_id").orderBy("seq")


def steps(lines: DataFrame) -> DataFrame:
    """With ds: distance from the vertex before (0 at the first), and s: distance along the line."""
    dx, dy = F.col("x") - F.lag("x").over(along()), F.col("y") - F.lag("y").over(along())
    out = lines.withColumn("ds", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    return out.withColumn("s", F.sum("ds").over(along().rowsBetween(Window.unboundedPreceding, 0)))


def curvature(lines: DataFrame, unwrap: bool = True) -> DataFrame:
    """series_id, seq, angle, s, curv: one row per segment (n - 1 for n vertices).

    A segment's angle is its direction (unwrapped unless unwrap is false); curv is the negated central difference of the unwrapped
    angles over distance, where the first and last look at the third value from their end; null where vertices coincide.
    """
    dx, dy = F.lead("x").over(along()) - F.col("x"), F.lead("y").over(along()) - F.col("y")
    seg = steps(lines).withColumn("raw", F.atan2(dy, dx)).withColumn("end_s", F.lead("s").over(along())).where("raw IS NOT NULL")
    seg = seg.withColumn("jump", F.col("raw") - F.lag("raw").over(along()))
    turned = F.pmod(F.col("jump") + F.lit(pi), F.lit(2 * pi)) - F.lit(pi)
    turned = F.when((turned == -pi) & (F.col("jump") > 0), F.lit(pi)).otherwise(turned)
    fix = F.when(F.abs("jump") <= pi, F.lit(0.0)).otherwise(turned - F.col("jump"))
    seg = seg.withColumn("fix", F.coalesce(fix, F.lit(0.0)))
    seg = seg.withColumn("angle", F.col("raw") + F.sum("fix").over(along().rowsBetween(Window.unboundedPreceding, 0)))
    last = Window.partitionBy("series_id").orderBy(F.desc("seq"))
    third = lambda c: (F.lead(c, 2).over(along()), F.lead(c, 2).over(last))
    (a_head, a_tail), (s_head, s_tail) = third("angle"), third("end_s")
    down = lambda c, head: F.coalesce(F.lag(c).over(along()), head)
    up = lambda c, tail: F.coalesce(F.lead(c).over(along()), tail)
    ddown = F.col("angle") - down("angle", a_head)
    dup = up("angle", a_tail) - F.col("angle")
    sdown, sup = F.col("end_s") - down("end_s", s_head), up("end_s", s_tail) - F.col("end_s")
    zero = lambda x: F.when(x != 0, x)
    curv = -(dup / zero(sup) * sdown + ddown / zero(sdown) * sup) / zero(sup + sdown)
    return seg.select("series_id", "seq", (F.col("angle") if unwrap else F.col("raw")).alias("angle"), F.col("end_s").alias("s"), curv.alias("curv"))


def inflections(curves: DataFrame, value: str = "curv") -> DataFrame:
    """Rows right after the sign of value changes."""
    before = F.lag(value).over(along())
    return curves.withColumn("_before", before).where((F.col(value) * F.col("_before")) < 0).drop("_before")


def mirror_ends(lines: DataFrame, n: int) -> DataFrame:
    """With n vertices before the first and after the last, reflected through them; seq goes from -n on."""
    of = Window.partitionBy("series_id")
    sized = lines.withColumns({"m": F.max("seq").over(of), "x0": F.min_by("x", "seq").over(of), "y0": F.min_by("y", "seq").over(of), "x1": F.max_by("x", "seq").over(of), "y1": F.max_by("y", "seq").over(of)})
    head = sized.where((F.col("seq") >= 1) & (F.col("seq") <= n)).select("series_id", (-F.col("seq")).alias("seq"), (2 * F.col("x0") - F.col("x")).alias("x"), (2 * F.col("y0") - F.col("y")).alias("y"))
    tail = sized.where((F.col("seq") < F.col("m")) & (F.col("seq") >= F.col("m") - n)).select("series_id", (2 * F.col("m") - F.col("seq")).alias("seq"), (2 * F.col("x1") - F.col("x")).alias("x"), (2 * F.col("y1") - F.col("y")).alias("y"))
    return lines.select("series_id", "seq", "x", "y").unionByName(head).unionByName(tail)


def resample(lines: DataFrame, n: int) -> DataFrame:
    """n vertices per line at equal distances along it, by linear interpolation between the vertices beside each."""
    seg = steps(lines).withColumns({"s1": F.lead("s").over(along()), "x1": F.lead("x").over(along()), "y1": F.lead("y").over(along())})
    total = F.max("s").over(Window.partitionBy("series_id"))
    seg = seg.withColumn("step", total / (n - 1)).where("s1 > s")
    low, high = F.ceil(F.col("s") / F.col("step") - 1e-9), F.ceil(F.col("s1") / F.col("step") - 1e-9) - 1
    last = F.max("seq").over(Window.partitionBy("series_id"))
    seg = seg.withColumn("low", low).withColumn("high", F.when(F.col("seq") == last, F.lit(n - 1).cast("long")).otherwise(high))
    seg = seg.where("high >= low").withColumn("k", F.explode(F.sequence("low", "high")))
    at = F.least(F.greatest((F.col("k") * F.col("step") - F.col("s")) / (F.col("s1") - F.col("s")), F.lit(0.0)), F.lit(1.0))
    return seg.select("series_id", F.col("k").cast("int").alias("seq"), (F.col("x") + at * (F.col("x1") - F.col("x"))).alias("x"), (F.col("y") + at * (F.col("y1") - F.col("y"))).alias("y"))


@lru_cache(maxsize=1024)
def savgol_weights(window: int, order: int) -> np.ndarray:
    """Weights, by place of the smoothed value within the window, of a least-squares polynomial: a window x window matrix."""
    half = window // 2
    a = np.vander(np.arange(-half, half + 1, dtype=float), order + 1, increasing=True)
    return a @ np.linalg.pinv(a)


def savgol(values: np.ndarray, window: int, order: int) -> np.ndarray:
    """One line's values smoothed as smooth() does."""
    w, half = savgol_weights(window, order), window // 2
    return np.concatenate((w[:half] @ values[:window], np.convolve(values, w[half][::-1], "valid"), w[half + 1 :] @ values[-window:]))


def smooth(lines: DataFrame, columns: tuple[str, ...] = ("x", "y"), window: int = 5, order: int = 3, passes: int = 1) -> DataFrame:
    """Savitzky-Golay smoothing: a moving polynomial, and at the ends the polynomial of the first and last window; lines shorter than the window stay."""
    weights, half = savgol_weights(window, order), window // 2
    for _ in range(passes):
        n = F.count("*").over(Window.partitionBy("series_id"))
        k = F.row_number().over(along()) - 1
        sized = lines.withColumns({"_n": n, "_k": k})
        place = F.when(F.col("_k") < half, F.col("_k")).when(F.col("_k") >= F.col("_n") - half, F.col("_k") - F.col("_n") + window).otherwise(F.lit(half)).cast("int")
        sized = sized.withColumn("_p", place)
        table = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in weights])
        around = along().rowsBetween(-(window - 1), window - 1)
        out = {}
        for c in columns:
            values = F.collect_list(c).over(around)
            first = F.least(F.col("_k"), F.lit(window - 1)).cast("int")  # place of the row itself in values
            own = F.slice(values, first - F.col("_p") + 1, window)
            dot = F.aggregate(F.zip_with(own, F.element_at(table, F.col("_p") + 1), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
            out[c] = F.when(F.col("_n") >= window, dot).otherwise(F.col(c))
        lines = sized.withColumns(out).drop("_n", "_k", "_p")
    return lines


def curvature_variation(curves: DataFrame, value: str = "curv") -> DataFrame:
    """series_id and cv: standard deviation over mean of the value's size."""
    return curves.groupBy("series_id").agg((F.stddev_pop(F.abs(value)) / F.avg(F.abs(value))).alias("cv"))


def inflections_oversmooth(lines: DataFrame, most: int, order: int = 3) -> DataFrame:
    """series_id, window and inflections (places on the line): from the least smoothing window whose line has fewer than `most` sign changes.

    A line is smoothed as a whole, so a task holds one line.
    """

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        xy = frame[["x", "y"]].to_numpy()
        n = len(xy)
        for window in range(order + 2 + (order + 1) % 2, n + 1, 2):
            sm = np.stack([savgol(c, window, order) for c in xy.T], axis=1)
            d = np.diff(sm, axis=0)
            turn = d[:-1, 0] * d[1:, 1] - d[:-1, 1] * d[1:, 0]
            at = np.flatnonzero(turn[:-1] * turn[1:] < 0) + 1
            if len(at) < most:
                return pd.DataFrame({"series_id": [frame["series_id"].iloc[0]], "window": [window], "places": [[int(x) for x in frame["seq"].to_numpy()[at]]]})
        return pd.DataFrame({"series_id": [frame["series_id"].iloc[0]], "window": pd.array([None], "Int64"), "places": [[]]})

    kind = lines.schema["series_id"].dataType.simpleString()
    return lines.groupBy("series_id").applyInPandas(search, f"series_id {kind}, window int, places array<int>")


def smooth_to_variation(curves: DataFrame, target: float, tolerance: float = 10.0, value: str = "curv", order: int = 3) -> DataFrame:
    """series_id, seq, the smoothed value, window, cv, found: each line under the first window whose differences vary as wanted.

    cv is the standard deviation over the mean of the differences between neighbours, and is near enough when it and target are no more
    than tolerance percent of it apart. Windows grow by a hundredth of the line up to half of it; where none is near enough (found is
    false) the last one holds, and lines too short for any keep their values (window and cv null). Null values count as 0.
    A line is smoothed as a whole, so a task holds one line.
    """

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        raw = frame[value].fillna(0.0).to_numpy(float)
        step = max(len(raw) // 100, 2)
        window = max(step, order + 1) | 1
        out, used, cv, found = raw, None, None, False
        while window <= len(raw) / 2 and not found:
            out, used = savgol(raw, window, order), window
            d = np.diff(out)
            cv = float(d.std() / d.mean()) if d.mean() else float("inf")
            found = np.isfinite(cv) and cv != 0 and abs((cv - target) / cv) * 100 <= tolerance
            window = (window + step) | 1
        return pd.DataFrame({"series_id": frame["series_id"], "seq": frame["seq"], value: out, "window": pd.array([used] * len(raw), "Int32"), "cv": pd.array([cv] * len(raw), "Float64"), "found": bool(found)})

    kind = curves.schema["series_id"].dataType.simpleString()
    return curves.select("series_id", "seq", F.col(value).cast("double")).groupBy("series_id").applyInPandas(search, f"series_id {kind}, seq int, {value} double, window int, cv double, found boolean")
