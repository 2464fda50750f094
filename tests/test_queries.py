"""The registered queries against their SQL in DuckDB, a sample of each family; the driver runs them all."""

import duckdb
import pytest

from thalweg.plans import registered

SF = "/root/testdata/sf0.001"
SAMPLE = ["px_conn8_reflect", "px_erode_plus", "px_downsample", "geo_inverse", "blob_moments", "edt", "series_curvature", "series_resample", "set_symdiff", "dag_flux", "dag_membership", "dag_entropy", "dag_leakage", "dag_paths", "dag_dpd", "dag_fsi", "dag_tmi", "dag_dmi", "dir_shortest_dag", "link_len_wid", "junction_angles", "nearest_inlet", "dir_check_sources", "dir_cycle_flips", "transect_bi", "interpolate", "mesh_transects"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(round(x, 5) + 0.0 if isinstance(x, float) else x for x in r) for r in rows) if rows else []


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, duck, name):
    query, sql = registered()[name]
    df = query(spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert plain([tuple(r) for r in df.select(*columns).collect()]) == plain([tuple(r) for r in want])


def test_whole_flow_graph(spark, duck):
    rows = lambda name: {tuple(r) for r in registered()[name][0](spark, SF).select("u", "v", "w").collect()}
    whole = rows("adj_normalized")
    lines = duck.sql("SELECT sum(l_quantity) FROM lineitem").fetchall()[0][0]
    for low, high in ((0, 1), (100, 200), (1000, 2000)):  # every layer carries all of it
        assert sum(w for u, _, w in whole if low <= u < high) == pytest.approx(lines)
    pivot = registered()["adj_pivot"][0](spark, SF).collect()
    assert {(r.u, int(c[1:]), w) for r in pivot for c, w in r.asDict().items() if c != "u" and w} == whole


def test_migration_of_all_pairs(spark):
    from math import hypot

    from thalweg import fixtures as fx

    got = {(r.line1, r.line2, r.matcher): (r.s, r.rate) for r in registered()["migration_rates"][0](spark, SF).collect()}
    lines, first = {}, {}
    for p in fx.series(spark, SF).orderBy("series_id", "seq").collect():
        lines.setdefault(p.series_id, []).append((p.x, p.y))
    for line, path in lines.items():
        for k in range(30):
            (ax, ay), (bx, by), s = (2.37 + k * 0.9, -3.0), (2.11 + k, 120.5), 0.0
            for (x, y), (x2, y2) in zip(path, path[1:], strict=False):
                det = (x2 - x) * (by - ay) - (y2 - y) * (bx - ax)
                if det:
                    t = ((ax - x) * (by - ay) - (ay - y) * (bx - ax)) / det
                    u = ((ax - x) * (y2 - y) - (ay - y) * (x2 - x)) / det
                    if 0 <= t <= 1 and 0 <= u <= 1:
                        first[line, k] = (s + t * hypot(x2 - x, y2 - y), x + t * (x2 - x), y + t * (y2 - y))
                        break
                s += hypot(x2 - x, y2 - y)
    ids, want = sorted(lines), {}
    for a, b in zip(ids, ids[1:], strict=False):
        for k in range(30):
            if (a, k) in first and (b, k) in first:
                (s, x, y), (_, x2, y2) = first[a, k], first[b, k]
                want[a, b, k] = (s, hypot(x - x2, y - y2) / 5)
    assert len({p[:2] for p in want}) > 1 and set(got) == set(want)
    for key, (s, rate) in want.items():
        assert got[key] == pytest.approx((s, rate), abs=2e-5)


def test_following_lines(spark):
    from thalweg.operators import spatial

    ids = [-3, 0, 1, 5, 999, 1000, 4000, 9001]
    got = spatial.following(spark.createDataFrame([(i,) for i in ids * 2], "id long")).collect()
    assert sorted(map(tuple, got)) == list(zip(ids, ids[1:], strict=False))
