"""Places on edges and at vertices, ties of rounding, and lines with equal vertices."""

import duckdb
import pytest
from pyspark.sql import functions as F

from thalweg.operators import regions, series, spatial
from thalweg.plans import directions as plan
from thalweg.plans import regions as regions_plan


def test_points_on_edges_are_in_no_cell(spark):
    corners = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    edges = [(1, *a, *b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]
    points = [(0, 5.0, 5.0), (1, 5.0, 0.0), (2, 0.0, 5.0), (3, 10.0, 5.0), (4, 5.0, 10.0), (5, 0.0, 0.0), (6, 12.0, 5.0), (7, -2.0, 0.0)]
    got = spatial.in_cells(spark.createDataFrame(points, "point_id int, x double, y double"), spark.createDataFrame(edges, "cell_id int, x1 double, y1 double, x2 double, y2 double"), 4.0)
    assert [tuple(r) for r in got.collect()] == [(0, 1)]


@pytest.fixture(scope="module")
def touching(tmp_path_factory):
    """Events whose lines have vertices on the transects, and so crossings at their very ends: (15, 0.25) is on transect 14."""
    folder = tmp_path_factory.mktemp("touching")
    at = [(u, d, round(((7 * u + 13 * d) % 400) / 4, 2)) for u in range(40) for d in range(1, 31)]
    at = [(u, d, 0.25 if d == 15 else v) for u, d, v in at]
    rows = ", ".join(f"({u * 100 + d}, TIMESTAMP '2024-01-{d:02d}', {u}, 'view', {v}::DOUBLE)" for u, d, v in at)
    duckdb.sql(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value FROM (VALUES {rows}) AS t(event_id, ts, user_id, event_type, value)) TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["transect_crossings", "transect_bi", "clip_shoreline"])
def test_crossings_at_vertices(spark, touching, name):
    query, sql = plan.QUERIES[name]
    df = query(spark, touching)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{touching}/events.parquet'")
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)


def test_equal_vertices_have_no_curvature(spark):
    """However long the line before them: at equal vertices nothing turns over no way at all."""
    rows = [(0, k, float(k), (k * k * 37 % 101) / 7.0) for k in range(72)]
    rows = spark.createDataFrame([*rows, (0, 72, *rows[-1][2:]), *((0, 73 + k, 72.0 + k, float(k)) for k in range(5))], "series_id int, seq int, x double, y double")
    got = {r.seq: r.curv for r in series.curvature(rows).where(F.col("curv").isNull()).collect()}
    assert sorted(got) == [70, 71]


def test_entropy_of_many_links(spark):
    """Of very many links of few widths the entropy is right to its 12th digit."""
    from math import fsum, log2

    n = 60_000
    lines = spark.range(n).selectExpr("id", "0 AS seg", "id * 1e-3 AS x1", "-1.0D AS y1", "id * 1e-3 AS x2", "1.0D AS y2")
    across = spark.createDataFrame([(1, 0, -1.0, 0.0, 61.0, 0.0)], "id int, seg int, x1 double, y1 double, x2 double, y2 double")
    got = spatial.braiding(across, lines, spark.range(n).selectExpr("id", "10.1D + id % 7 AS wid"), 2.0).collect()
    wid = [10.1 + k % 7 for k in range(n)]
    total = fsum(wid)
    want = 2 ** -fsum(w / total * log2(w / total) for w in wid)
    assert got[0].bi == n and got[0].ebi == pytest.approx(want, rel=2e-14)


def test_moments_at_ties_of_rounding(spark, tmp_path):
    """Blobs whose squared eccentricity is 87/128 and 51/128, a tie at its sixth digit: rounded as the SQL does."""
    on = {(36, 1), (38, 0), (38, 1), (36, 0), (38, 2), (37, 0), (35, 0), (37, 1)} | {(46, 19), (46, 20), (46, 18), (44, 20), (46, 21), (44, 18), (45, 18), (44, 19)}
    rows = ", ".join(f"({r}, {[float((r, c) in on) for c in range(64)]}::FLOAT[])" for r in range(50))
    duckdb.sql(f"COPY (SELECT vec_id::BIGINT AS vec_id, embedding FROM (VALUES {rows}) AS t(vec_id, embedding)) TO '{tmp_path}/embeddings.parquet'")
    query, sql = regions_plan.QUERIES["blob_moments"]
    df = query(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall())
    assert [r[df.columns.index("eccentricity2")] for r in got] == [0.679688, 0.398438]


def test_moments_far_from_the_origin(spark):
    """Second moments are those of the same blob at the origin, at places whose squares fill a long."""
    far = 2_000_000_000
    labels = spark.createDataFrame([(0, r + d, c + d, d) for d in (0, far) for r, c in ((0, 0), (0, 1), (0, 2), (1, 1), (2, 1))], "image_id long, r int, c int, label long")
    axes = [(r.major_axis, r.minor_axis, r.eccentricity) for r in regions.moments(labels).collect()]
    assert len(axes) == 2 and axes[0] == axes[1]
