"""Registered queries on ordered sets, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from thalweg import fixtures as fx
from thalweg.operators import ordered_sets as op

QUERIES: dict = {}


def register(name, sql=None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep


_S = fx.with_("sets") + """, a0 AS (SELECT * FROM sets WHERE item < 30), b0 AS (SELECT * FROM sets WHERE item >= 20 AND item % 3 > 0), c0 AS (SELECT * FROM sets WHERE item % 2 = 0),
a AS (SELECT set_id, min(ord) AS ord, item FROM a0 GROUP BY set_id, item), b AS (SELECT set_id, min(ord) AS ord, item FROM b0 GROUP BY set_id, item), c AS (SELECT set_id, min(ord) AS ord, item FROM c0 GROUP BY set_id, item)"""


def _abc(spark, sf):
    s = fx.ordered_sets(spark, sf)
    return s.where("item < 30"), s.where("item >= 20 AND item % 3 > 0"), s.where("item % 2 = 0")


@register("set_unique", _S + " SELECT set_id, item, CAST(row_number() OVER (PARTITION BY set_id ORDER BY ord) - 1 AS INTEGER) AS idx FROM a")
def set_unique(spark, sf):
    return op.indexed(_abc(spark, sf)[0]).select("set_id", "item", F.col("idx").cast("int").alias("idx"))


@register("set_slice", _S + ", i AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY ord) - 1 AS k, count(*) OVER (PARTITION BY set_id) AS n FROM a) SELECT set_id, ord, item FROM i WHERE k >= 1 AND k < n - 2")
def set_slice(spark, sf):
    return op.item_at(_abc(spark, sf)[0], 1, -2)


_UNION = ", u AS (SELECT set_id, item, min(o) AS o FROM (SELECT set_id, item, ord AS o FROM {0} UNION ALL SELECT set_id, item, ord + 1000000000000 AS o FROM {1}) GROUP BY ALL) SELECT set_id, item, CAST(row_number() OVER (PARTITION BY set_id ORDER BY o) - 1 AS INTEGER) AS idx FROM u"


@register("set_union", _S + _UNION.format("a", "b"))
def set_union(spark, sf):
    a, b, _ = _abc(spark, sf)
    return op.indexed(op.union(a, b)).select("set_id", "item", F.col("idx").cast("int").alias("idx"))


@register("set_intersect", _S + " SELECT * FROM a SEMI JOIN b USING (set_id, item) SEMI JOIN c USING (set_id, item)".replace("SELECT *", "SELECT set_id, ord, item"))
def set_intersect(spark, sf):
    return op.keep(*_abc(spark, sf))


@register("set_except_any", _S + " SELECT set_id, ord, item FROM a ANTI JOIN b USING (set_id, item) ANTI JOIN c USING (set_id, item)")
def set_except_any(spark, sf):
    return op.except_any(*_abc(spark, sf))


@register("set_except_all", _S + ", k AS (SELECT set_id, item FROM b SEMI JOIN c USING (set_id, item)) SELECT set_id, ord, item FROM a ANTI JOIN k USING (set_id, item)")
def set_except_all(spark, sf):
    return op.except_all(*_abc(spark, sf))


@register("set_symdiff", _S + ", x AS (SELECT * FROM a ANTI JOIN b USING (set_id, item)), y AS (SELECT * FROM b ANTI JOIN a USING (set_id, item))" + _UNION.format("x", "y"))
def set_symdiff(spark, sf):
    a, b, _ = _abc(spark, sf)
    return op.indexed(op.symmetric_difference(a, b)).select("set_id", "item", F.col("idx").cast("int").alias("idx"))


@register("set_pop", _S + " SELECT set_id, max_by(item, ord) AS item FROM a GROUP BY set_id")
def set_pop(spark, sf):
    return op.last(op.unique(_abc(spark, sf)[0]))


@register("set_popped", _S + " SELECT set_id, ord, item FROM a QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY ord DESC) > 1")
def set_popped(spark, sf):
    return op.popped(_abc(spark, sf)[0])


@register("set_size", _S + " SELECT set_id, count(*) AS n FROM a GROUP BY set_id")
def set_size(spark, sf):
    return op.size(_abc(spark, sf)[0])


@register("set_contains", _S + " SELECT set_id, c.item, a.item IS NOT NULL AS inside FROM c LEFT JOIN a USING (set_id, item)")
def set_contains(spark, sf):
    a, _, c = _abc(spark, sf)
    return op.contains(a, op.unique(c))


@register("set_backwards", _S + " SELECT set_id, item, CAST(row_number() OVER (PARTITION BY set_id ORDER BY ord DESC) - 1 AS INTEGER) AS idx FROM a")
def set_backwards(spark, sf):
    return op.backwards(_abc(spark, sf)[0]).select("set_id", "item", F.col("idx").cast("int").alias("idx"))


@register("set_superset", _S + ", d AS (SELECT * FROM a SEMI JOIN b USING (set_id, item)) SELECT d.set_id, bool_and(b.item IS NOT NULL) AS superset FROM d LEFT JOIN b USING (set_id, item) GROUP BY d.set_id")
def set_superset(spark, sf):
    """Each set against what it shares with another."""
    a, b, _ = _abc(spark, sf)
    return op.is_superset(b, op.keep(a, b))


@register("set_subset", _S + " SELECT a.set_id, bool_and(c.item IS NOT NULL) AS subset FROM a LEFT JOIN c USING (set_id, item) GROUP BY a.set_id")
def set_subset(spark, sf):
    a, _, c = _abc(spark, sf)
    return op.is_subset(a, c)


@register("set_equal", _S + ", x AS (SELECT set_id, string_agg(item, ',' ORDER BY ord) AS l FROM a GROUP BY 1), y AS (SELECT set_id, string_agg(item, ',' ORDER BY ord) AS l FROM c GROUP BY 1) SELECT set_id, x.l IS NOT DISTINCT FROM y.l AS equal FROM x FULL JOIN y USING (set_id)")
def set_equal(spark, sf):
    a, _, c = _abc(spark, sf)
    return op.equals(a, c)
