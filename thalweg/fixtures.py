"""Rasters, series, graphs, points and sets made from the star-schema tables, in Spark and as DuckDB text.

Each binding has a function that gives the relation in Spark and, in SQL, the common table expression with
the same rows, so that an operator's query and its check start from the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one image of the raster binding, and its threshold.
TILE, THRESHOLD = 50, 0.1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, r, c, v: every vector is a row of an image, TILE rows to an image."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.expr(f"vec_id div {TILE}").alias("image_id"), (F.col("vec_id") % TILE).cast("int").alias("r"), F.posexplode("embedding").alias("c", "v"))


def pixels(spark: SparkSession, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    """image_id, r, c of the pixels that are on."""
    return cells(spark, sf_dir).where(F.col("v") > F.lit(threshold).cast("float")).select("image_id", "r", "c")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, nrows, ncols, and the geotransform of a grid of 30 m pixels."""
    e = table(spark, sf_dir, "embeddings")
    size = e.groupBy(F.expr(f"vec_id div {TILE}").alias("image_id")).agg((F.max(F.col("vec_id") % TILE) + 1).cast("int").alias("nrows"), F.max(F.size("embedding")).alias("ncols"))
    gt = F.array(F.lit(336885.0) + F.col("image_id") * 3000, F.lit(30.0), F.lit(0.0), F.lit(7826415.0), F.lit(0.0), F.lit(-30.0))
    return size.withColumn("gt", gt).withColumn("pixlen", F.lit(30.0))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, seq (from 0), x, y: each user's events in order, by day of the month and value."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("series_id"), seq.cast("int").alias("seq"), F.dayofmonth("ts").cast("double").alias("x"), F.col("value").alias("y"))


def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, w of a layered flow graph of all line items: 0 to supplier nations to brands to customer regions."""
    t = lambda n: table(spark, sf_dir, n)
    base = (
        t("lineitem")
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("s_nationkey").cast("long").alias("sn"), F.substring("p_brand", 7, 9).cast("long").alias("b"), F.col("n_regionkey").cast("long").alias("cr"))
        .agg(F.sum("l_quantity").alias("q"))
    )
    edge = lambda df, u, v: df.groupBy(u.alias("u"), v.alias("v")).agg(F.sum("q").alias("w"))
    first = edge(base, F.lit(0).cast("long"), F.col("sn") + 100)
    second = edge(base, F.col("sn") + 100, F.col("b") + 1000)
    third = edge(base, F.col("b") + 1000, F.col("cr") + 10000)
    return first.unionByName(second).unionByName(third)


def multigraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """link_id, u, v, wid, len: a sparse network with a link per customer, between two nodes made of its key."""
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        c.cast("long").alias("link_id"), (c % 1009).cast("long").alias("u"), F.expr("(c_custkey % 1009 + c_custkey div 1300) * 31 % 1009").cast("long").alias("v"),
        (1 + F.abs("c_acctbal") / 100).alias("wid"), (F.col("c_nationkey") + 10).cast("double").alias("len"),
    )


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """net_id, link_id, u, v: every six customers are the links of a ring that flows in a circle, with a link into node 0 and one out of node 1 to 5."""
    c = table(spark, sf_dir, "customer").select(F.expr("c_custkey div 6").alias("net_id"), (F.col("c_custkey") % 6).alias("k"))
    a, b, ahead = F.col("k"), (F.col("k") + 1) % 6, F.col("net_id") % 2 == 0
    ring = c.select("net_id", F.col("k").alias("link_id"), F.when(ahead, a).otherwise(b).alias("u"), F.when(ahead, b).otherwise(a).alias("v"))
    net = c.select("net_id").distinct()
    into = net.select("net_id", F.lit(6).alias("link_id"), F.lit(6).alias("u"), F.lit(0).alias("v"))
    out = net.select("net_id", F.lit(7).alias("link_id"), (1 + F.col("net_id") % 5).alias("u"), F.lit(7).alias("v"))
    return ring.unionByName(into).unionByName(out).select(*[F.col(c).cast("long").alias(c) for c in ("net_id", "link_id", "u", "v")])


def inlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, x, y of suppliers as points."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point_id"), (F.col("s_suppkey") % 97).cast("double").alias("x"), F.col("s_acctbal").alias("y"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, x, y of customers as points."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), (F.col("c_custkey") % 97).cast("double").alias("x"), F.col("c_acctbal").alias("y"))


def ordered_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set_id, ord, item: the parts of each customer's orders, in order."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(F.col("o_custkey").alias("set_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 64 + F.col("l_partkey") % 50).cast("long").alias("ord"), (F.col("l_partkey") % 50).alias("item"))


#: The same relations for DuckDB, by name; each needs the ones before it that it names.
SQL = {
    "cells": f"cells AS (SELECT image_id, r, c, embedding[c + 1] AS v FROM (SELECT vec_id // {TILE} AS image_id, CAST(vec_id % {TILE} AS INTEGER) AS r, CAST(unnest(range(len(embedding))) AS INTEGER) AS c, embedding FROM embeddings))",
    "pixels": f"pixels AS (SELECT image_id, r, c FROM cells WHERE v > CAST({THRESHOLD} AS FLOAT))",
    "images": f"images AS (SELECT vec_id // {TILE} AS image_id, CAST(max(vec_id % {TILE}) + 1 AS INTEGER) AS nrows, CAST(max(len(embedding)) AS INTEGER) AS ncols FROM embeddings GROUP BY 1)",
    "offsets": "offsets AS (SELECT CAST(a AS INTEGER) AS dr, CAST(b AS INTEGER) AS dc FROM range(-1, 2) x(a), range(-1, 2) y(b) WHERE a <> 0 OR b <> 0)",
    "series": "series AS (SELECT user_id AS series_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS seq, CAST(day(ts) AS DOUBLE) AS x, value AS y FROM events)",
    "flow": """base AS (SELECT CAST(s_nationkey AS BIGINT) sn, CAST(substr(p_brand, 7) AS BIGINT) b, CAST(n_regionkey AS BIGINT) cr, sum(l_quantity) q
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
e AS (SELECT CAST(0 AS BIGINT) AS u, 100 + sn AS v, sum(q) AS w FROM base GROUP BY sn
  UNION ALL SELECT 100 + sn, 1000 + b, sum(q) FROM base GROUP BY sn, b
  UNION ALL SELECT 1000 + b, 10000 + cr, sum(q) FROM base GROUP BY b, cr)""",
    "links": "links AS (SELECT CAST(c_custkey AS BIGINT) AS link_id, CAST(c_custkey % 1009 AS BIGINT) AS u, CAST((c_custkey % 1009 + c_custkey // 1300) * 31 % 1009 AS BIGINT) AS v, 1 + abs(c_acctbal) / 100 AS wid, CAST(c_nationkey + 10 AS DOUBLE) AS len FROM customer)",
    "rings": """ring AS (SELECT c_custkey // 6 AS net_id, c_custkey % 6 AS k FROM customer), ringed AS (SELECT net_id, 1 + net_id % 5 AS b, count(*) = 6 AS whole FROM ring GROUP BY 1),
rings AS (SELECT net_id, k AS link_id, CASE WHEN net_id % 2 = 0 THEN k ELSE (k + 1) % 6 END AS u, CASE WHEN net_id % 2 = 0 THEN (k + 1) % 6 ELSE k END AS v FROM ring
  UNION ALL SELECT net_id, 6, 6, 0 FROM ringed UNION ALL SELECT net_id, 7, b, 7 FROM ringed)""",
    "inlets": "inlets AS (SELECT s_suppkey AS point_id, CAST(s_suppkey % 97 AS DOUBLE) AS x, s_acctbal AS y FROM supplier)",
    "points": "points AS (SELECT c_custkey AS node_id, CAST(c_custkey % 97 AS DOUBLE) AS x, c_acctbal AS y FROM customer)",
    "sets": "sets AS (SELECT o_custkey AS set_id, CAST((l_orderkey * 10 + l_linenumber) * 64 + l_partkey % 50 AS BIGINT) AS ord, l_partkey % 50 AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
}


def with_(*names: str) -> str:
    """WITH clause of the named relations, to be followed by more of them or a SELECT."""
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names)
