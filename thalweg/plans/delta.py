"""Registered queries on flow networks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from thalweg import fixtures as fx
from thalweg.operators import delta_metrics as op
from thalweg.operators.regions import stored

QUERIES: dict = {}


def register(name, sql=None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


_E = (
    fx.with_("flow")
    + """, p AS (SELECT u, v, w, w / sum(w) OVER (PARTITION BY u) AS p, 1.0::DOUBLE / count(*) OVER (PARTITION BY u) AS q FROM e),
fp AS (SELECT 0::BIGINT AS node, 1.0::DOUBLE AS x, 1.0::DOUBLE AS y, 1::BIGINT AS n, 0 AS d UNION ALL SELECT p.v, fp.x * p.p, fp.y * p.q, fp.n, fp.d + 1 FROM fp JOIN p ON fp.node = p.u WHERE fp.d < 3),
f AS (SELECT node, sum(x) AS f, sum(y) AS fe, count(*) AS n FROM fp GROUP BY node),
sp AS (SELECT DISTINCT v AS node, v AS outlet, 1.0::DOUBLE AS x, 1.0::DOUBLE AS y, 0 AS d FROM e WHERE v >= 10000 UNION ALL SELECT p.u, sp.outlet, sp.x * p.p, sp.y * p.q, sp.d + 1 FROM sp JOIN p ON sp.node = p.v WHERE sp.d < 3),
s AS (SELECT node, outlet, sum(x) AS s, sum(y) AS se FROM sp GROUP BY node, outlet),
l AS (SELECT p.u, p.v, a.outlet, p.p * f.f AS lf, p.q * f.fe AS le, b.s, b.se FROM p JOIN f ON f.node = p.u JOIN s a ON a.node = p.u JOIN s b ON b.node = p.v AND b.outlet = a.outlet)
"""
)


def _edges(spark, sf):
    return stored(fx.flow_edges(spark, sf).withColumn("net_id", F.lit(0).cast("long")))


def _rounded(df, n=6):
    return df.drop("net_id").withColumns({c: F.round(c, n) for c, t in df.dtypes if t == "double"})


@register("adj_normalized", _E + " SELECT u, v, w, round(p, 6) AS p FROM p")
def adj_normalized(spark, sf):
    return _rounded(op.normalize(_edges(spark, sf)))


# a column per node, so there is no SQL
@register("adj_pivot")
def adj_pivot(spark, sf):
    return op.adjacency(_edges(spark, sf)).drop("net_id")


@register("dag_flux", _E + " SELECT node, round(f, 6) AS f FROM f")
def dag_flux(spark, sf):
    return _rounded(op.flux(op.normalize(_edges(spark, sf))))


@register("dag_link_flux", _E + " SELECT p.u, p.v, round(p.p * f.f, 6) AS f FROM p JOIN f ON f.node = p.u")
def dag_link_flux(spark, sf):
    p = stored(op.normalize(_edges(spark, sf)))
    return _rounded(op.link_flux(p, op.flux(p)).select("net_id", "u", "v", "f"))


@register("dag_membership", _E + " SELECT node, outlet, round(s, 6) AS s FROM s")
def dag_membership(spark, sf):
    return _rounded(op.membership(op.normalize(_edges(spark, sf))))


@register("dag_paths", _E + " SELECT node AS outlet, n AS paths FROM f WHERE node >= 10000")
def dag_paths(spark, sf):
    return _rounded(op.path_counts(_edges(spark, sf)))


def _parts(spark, sf, even):
    p = stored((op.equal_split if even else op.normalize)(_edges(spark, sf)))
    f, s = stored(op.flux(p)), stored(op.membership(p))
    return f, s, stored(op.subnetwork_links(op.link_flux(p, f), s))


@register("dag_entropy", _E + ", h AS (SELECT node, count(*) AS k, -sum(s * log2(s)) AS h FROM s GROUP BY node) SELECT round(sum(f.f * CASE WHEN k > 1 THEN h / log2(k) ELSE h END) / sum(f.f), 6) AS ner FROM f JOIN h USING (node)")
def dag_entropy(spark, sf):
    f, s, _ = _parts(spark, sf, False)
    return _rounded(op.entropy_rate(f, s))


@register("dag_lsi", _E + ", b AS (SELECT *, count(*) OVER (PARTITION BY u, v) AS b FROM l) SELECT outlet, round(1 - avg(1.0::DOUBLE / b), 6) AS lsi FROM b GROUP BY outlet")
def dag_lsi(spark, sf):
    return _rounded(op.sharing_indices(_parts(spark, sf, True)[2]).drop("fsi"))


@register("dag_fsi", _E + " SELECT outlet, round(1 - avg(s), 6) AS fsi FROM l GROUP BY outlet")
def dag_fsi(spark, sf):
    return _rounded(op.sharing_indices(_parts(spark, sf, False)[2]).drop("lsi"))


@register("dag_leakage", _E + ", n AS (SELECT outlet, sum(f.f) AS n FROM s JOIN f USING (node) WHERE node <> outlet GROUP BY outlet), k AS (SELECT outlet, sum(lf) AS k FROM l GROUP BY outlet) SELECT outlet, round((n - k) / n, 6) AS li FROM n JOIN k USING (outlet)")
def dag_leakage(spark, sf):
    return _rounded(op.leakage(*_parts(spark, sf, False)))


_PAIRS = ", x AS (SELECT a.outlet AS k, b.outlet AS i, count(*) AS n, sum(a.{f}) AS f FROM l a JOIN l b ON a.u = b.u AND a.v = b.v GROUP BY ALL)"


@register("dag_tpd", _E + _PAIRS.format(f="le") + " SELECT x.i, x.k, round(x.n / t.n, 6) AS tpd FROM x JOIN x t ON t.k = x.k AND t.i = x.k")
def dag_tpd(spark, sf):
    return _rounded(op.pairwise_dependence(_parts(spark, sf, True)[2]).drop("dpd"))


@register("dag_dpd", _E + _PAIRS.format(f="lf") + " SELECT x.i, x.k, round(x.f / t.f, 6) AS dpd FROM x JOIN x t ON t.k = x.k AND t.i = x.k")
def dag_dpd(spark, sf):
    return _rounded(op.pairwise_dependence(_parts(spark, sf, False)[2]).drop("tpd"))


_INFO = ", g AS (SELECT outlet, u, v, {f} / sum({f}) OVER (PARTITION BY outlet) AS g FROM l), h AS (SELECT *, sum(g) OVER (PARTITION BY outlet, v) AS dn, sum(g) OVER (PARTITION BY outlet, u) AS up FROM g) SELECT outlet, round(sum(g * log2(g / (dn * up))), 6) AS mi, round(sum(-g * log2(g * g / dn / up)), 6) AS ce FROM h GROUP BY outlet"


@register("dag_tmi", _E + _INFO.format(f="le"))
def dag_tmi(spark, sf):
    return _rounded(op.information(_parts(spark, sf, True)[2]))


@register("dag_dmi", _E + _INFO.format(f="lf"))
def dag_dmi(spark, sf):
    return _rounded(op.information(_parts(spark, sf, False)[2]))


@register("dag_ner_exceedance")
def dag_ner_exceedance(spark, sf):
    return _rounded(op.entropy_exceedance(_edges(spark, sf), trials=200))


@register("dag_resistance")
def dag_resistance(spark, sf):
    e = _edges(spark, sf)
    return _rounded(op.resistance_distance(e, op.membership(op.equal_split(e))))


@register("dag_inlets_outlets", _E + " SELECT u AS node, 'inlet' AS role FROM e ANTI JOIN (SELECT v AS u FROM e) x USING (u) GROUP BY u UNION ALL SELECT v, 'outlet' FROM e ANTI JOIN (SELECT u AS v FROM e) x USING (v) GROUP BY v")
def dag_inlets_outlets(spark, sf):
    return _rounded(op.inlets_and_outlets(_edges(spark, sf)))


@register("dag_hops", _E + " SELECT node, min(d) AS hops FROM fp GROUP BY node")
def dag_hops(spark, sf):
    e = _edges(spark, sf)
    return _rounded(op.hops(e, op.inlets_and_outlets(e).where("role = 'inlet'")))
