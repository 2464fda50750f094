"""Registered queries on ordered vertices, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from thalweg import fixtures as fx
from thalweg.operators import series as op

QUERIES: dict = {}


def register(name, sql=None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


def _rounded(df, n=6):
    return df.withColumns({c: F.round(c, n) for c, t in df.dtypes if t == "double"})


_S = fx.with_("series") + """, st AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS ds FROM series WINDOW w AS (PARTITION BY series_id ORDER BY seq)),
ss AS (SELECT *, sum(ds) OVER (PARTITION BY series_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM st)"""


@register("series_s_ds", _S + " SELECT series_id, seq, x, y, round(ds, 6) AS ds, round(s, 6) AS s FROM ss")
def series_s_ds(spark, sf):
    return op.steps(fx.series(spark, sf)).withColumns({c: F.round(c, 6) for c in ("ds", "s")})


@register("series_length", _S + " SELECT series_id, count(*) AS n, round(max(s), 5) AS length FROM ss GROUP BY series_id")
def series_length(spark, sf):
    return op.steps(fx.series(spark, sf)).groupBy("series_id").agg(F.count("*").alias("n"), F.round(F.max("s"), 5).alias("length"))


_CURV = _S + """, g AS (SELECT series_id, seq, atan2(lead(y) OVER w - y, lead(x) OVER w - x) AS raw, lead(s) OVER w AS es FROM ss WINDOW w AS (PARTITION BY series_id ORDER BY seq)),
j AS (SELECT *, raw - lag(raw) OVER (PARTITION BY series_id ORDER BY seq) AS jump FROM g WHERE raw IS NOT NULL),
a AS (SELECT *, raw + sum(coalesce(CASE WHEN jump > pi() THEN -2 * pi() WHEN jump < -pi() THEN 2 * pi() ELSE 0 END, 0)) OVER (PARTITION BY series_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS a FROM j),
n AS (SELECT *, coalesce(lag(a) OVER w, nth_value(a, 3) OVER f) AS ad, coalesce(lead(a) OVER w, lag(a, 2) OVER w) AS au, coalesce(lag(es) OVER w, nth_value(es, 3) OVER f) AS sd, coalesce(lead(es) OVER w, lag(es, 2) OVER w) AS su
  FROM a WINDOW w AS (PARTITION BY series_id ORDER BY seq), f AS (PARTITION BY series_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
curve AS (SELECT series_id, seq, a AS angle, es AS s, -((au - a) / nullif(su - es, 0) * (es - sd) + (a - ad) / nullif(es - sd, 0) * (su - es)) / nullif(su - sd, 0) AS curv FROM n)"""


@register("series_curvature", _CURV + " SELECT series_id, seq, round(angle, 6) AS angle, round(s, 6) AS s, round(curv, 6) AS curv FROM curve")
def series_curvature(spark, sf):
    return _rounded(op.curvature(fx.series(spark, sf)))


@register("series_inflections", _CURV + ", z AS (SELECT *, lag(curv) OVER (PARTITION BY series_id ORDER BY seq) AS nxt FROM curve) SELECT series_id, seq FROM z WHERE curv * nxt < 0")
def series_inflections(spark, sf):
    return op.inflections(op.curvature(fx.series(spark, sf))).select("series_id", "seq")


@register("series_curvature_cv", _CURV + " SELECT series_id, round(stddev_pop(abs(curv)) / avg(abs(curv)), 6) AS cv FROM curve GROUP BY series_id")
def series_curvature_cv(spark, sf):
    return _rounded(op.curvature_variation(op.curvature(fx.series(spark, sf))))


@register("series_mirror", _S + """, e AS (SELECT series_id, max(seq) AS m, min_by(x, seq) AS x0, min_by(y, seq) AS y0, max_by(x, seq) AS x1, max_by(y, seq) AS y1 FROM series GROUP BY series_id)
SELECT series_id, seq, x, y FROM series UNION ALL SELECT series_id, -seq, round(2 * x0 - x, 6), round(2 * y0 - y, 6) FROM series JOIN e USING (series_id) WHERE seq BETWEEN 1 AND 4
UNION ALL SELECT series_id, 2 * m - seq, round(2 * x1 - x, 6), round(2 * y1 - y, 6) FROM series JOIN e USING (series_id) WHERE seq BETWEEN m - 4 AND m - 1""")
def series_mirror(spark, sf):
    return op.mirror_ends(fx.series(spark, sf), 4).withColumns({c: F.when((F.col("seq") < 0), F.round(c, 6)).otherwise(F.round(c, 6)) for c in ("x", "y")})


@register("series_resample", _S + """, t AS (SELECT series_id, max(s) / 19 AS step FROM ss GROUP BY series_id), k AS (SELECT series_id, CAST(k AS INTEGER) AS k, k * step AS at FROM t, range(20) r(k)),
g AS (SELECT *, lead(s) OVER w AS s1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM ss WINDOW w AS (PARTITION BY series_id ORDER BY seq)),
h AS (SELECT k.series_id, k.k, k.at, max(g.seq) FILTER (WHERE g.s <= k.at + 1e-9 AND g.s1 > g.s) AS seq FROM k JOIN g USING (series_id) GROUP BY ALL)
SELECT h.series_id, h.k AS seq, round(g.x + least((h.at - g.s) / (g.s1 - g.s), 1) * (g.x1 - g.x), 5) AS x, round(g.y + least((h.at - g.s) / (g.s1 - g.s), 1) * (g.y1 - g.y), 5) AS y FROM h JOIN g USING (series_id, seq)""")
def series_resample(spark, sf):
    return _rounded(op.resample(fx.series(spark, sf), 20), 5)


_SMOOTH = """CASE seq WHEN 0 THEN (69 * {0} + 4 * lead({0}) OVER w - 6 * lead({0}, 2) OVER w + 4 * lead({0}, 3) OVER w - lead({0}, 4) OVER w) / 70
  WHEN 1 THEN (2 * lag({0}) OVER w + 27 * {0} + 12 * lead({0}) OVER w - 8 * lead({0}, 2) OVER w + 2 * lead({0}, 3) OVER w) / 35
  WHEN n - 1 THEN (69 * {0} + 4 * lag({0}) OVER w - 6 * lag({0}, 2) OVER w + 4 * lag({0}, 3) OVER w - lag({0}, 4) OVER w) / 70
  WHEN n - 2 THEN (2 * lead({0}) OVER w + 27 * {0} + 12 * lag({0}) OVER w - 8 * lag({0}, 2) OVER w + 2 * lag({0}, 3) OVER w) / 35
  ELSE (-3 * lag({0}, 2) OVER w + 12 * lag({0}) OVER w + 17 * {0} + 12 * lead({0}) OVER w - 3 * lead({0}, 2) OVER w) / 35 END"""


@register("series_smooth", _S + ", n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM series) SELECT series_id, seq, round(" + _SMOOTH.format("x") + ", 6) AS x, round(" + _SMOOTH.format("y") + ", 6) AS y FROM n WINDOW w AS (PARTITION BY series_id ORDER BY seq)")
def series_smooth(spark, sf):
    return op.smooth(fx.series(spark, sf)).select("series_id", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register("series_inflections_oversmooth")
def series_inflections_oversmooth(spark, sf):
    found = op.inflections_oversmooth(fx.series(spark, sf), 6)
    return found.withColumn("places", F.array_join("places", ","))


@register("series_curvature_to_variation")
def series_curvature_to_variation(spark, sf):
    return op.smooth_to_variation(op.curvature(fx.series(spark, sf)), 3.0).withColumns({c: F.round(c, 6) for c in ("curv", "cv")})
