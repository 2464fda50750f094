from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.llm.ann import best_in_block, cosines, fit, hilbert_keys, nearest


@pytest.mark.parametrize(("n", "bits"), [(1, 4), (2, 3), (3, 2), (4, 2)])
def test_hilbert_is_a_curve(n, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), axis=-1).reshape(-1, n)
    keys = hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def brute(rows, k=5):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 3 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in sorted(good):
        if i % 50 == 0:
            others = [(j, w) for j, w in good if j != i]
            scores = cosines(np.array([v] * len(others), float), np.array([w for _, w in others], float)) if others else []
            out[i] = [(j, s) for s, j in sorted(((-s, j) for s, (j, _) in zip(scores, others, strict=True)))[:k]]
    return out


def test_ties_copies_and_unusable_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.integers(-2, 3, 3))]) for i in range(300)]
    rows += [(i, [1.0, 2.0, 2.0]) for i in range(300, 700)]
    rows += [(1000, None), (1050, [0.0, 0.0, 0.0]), (1100, [1.0, None, 2.0]), (1150, [float("nan"), 1.0, 1.0]), (1200, [float("inf"), 1.0, 1.0]), (1250, []), (None, [1.0, 1.0, 1.0]), (1300, [1.0, 2.0]), (350, [1.0, 2.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, -r.score))
    want = brute(rows)
    assert set(want) == set(got) and not {1000, 1050, 1100, 1150, 1200, 1250, 1300} & set(got)
    for q in want:
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12), q
    assert {i for i, _ in got[350]} == {i for i, _ in want[350]}
    assert nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = nearest(df.where("vec_id in (300, 301)"), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(300, 301)]


@pytest.mark.parametrize("distinct", [2, 5, 20, 24, 47, 60])
def test_small_tables_are_searched_whole(spark, distinct):
    rng = np.random.default_rng(distinct)
    x = rng.normal(size=(distinct, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in nearest(df, F.col("vec_id") % 7 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q in range(0, distinct, 7):
        s = cosines(np.repeat(x[q : q + 1].astype(float), distinct, 0), x.astype(float))
        s[q] = -2
        assert got[q] == np.argsort(-s)[: min(5, distinct - 1)].tolist(), q


def test_each_length_is_searched_among_its_own(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.1]), (5, [1.0] * 7)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.lit(True)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 1), (2, 2, 0), (3, 1, 4), (4, 1, 3)]


def test_rows_before_a_hot_key_see_it(spark):
    # half of the rows on few keys, queries beside them
    width = 6.5 / 32
    near, hot = 1.0 * np.ones(1500), -1.0 * np.ones(1500)
    rng = np.random.default_rng(3)
    near_copies = np.stack([near, rng.uniform(0, 1e-3, 1500)], axis=1)
    others = np.stack([hot, rng.uniform(-1, 1, 1500)], axis=1)
    queries = np.stack([np.ones(12), np.tan(width * np.arange(-6, 6) / 2 + 0.05)], axis=1)
    x = np.float32(np.concatenate([queries, near_copies, others]))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in nearest(df, F.col("vec_id") < 12).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.score)
    for q in range(12):
        s = cosines(np.repeat(x[q : q + 1].astype(float), len(x), 0), x.astype(float))
        s[q] = -2
        assert len(got[q]) == 5, q
        assert got[q][0] >= np.cos(0.7), q  # the cluster or a query at its side, not the rows across


def test_best_in_block():
    rng = np.random.default_rng(2)
    q, c, ids = rng.normal(size=(70, 8)), rng.normal(size=(500, 8)), rng.permutation(500)
    got = best_in_block(q, c, ids, 4)
    for i in range(70):
        s = cosines(np.repeat(q[i][None], 500, 0), c)
        assert got[1][got[0] == i].tolist() == np.lexsort((ids, -s))[:4].tolist()


def recall(spark, df, every=50):
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(set)
    for r in nearest(df, F.col("vec_id") % every == 0).collect():
        got[r.query_id].add(r.vec_id)
    found = total = 0
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q]
        s[q] = -2
        last = np.sort(s)[-5]
        found, total = found + sum(s[ids == j][0] >= last - 1e-9 for j in got[ids[q]]), total + 5
    return found / total


def test_recall(spark):
    assert recall(spark, spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")) >= 0.9


def clustered(n=8000, each=40):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(n // each, 64))
    return np.float32(np.repeat(centres, each, 0) + rng.normal(size=(n, 64)) * 0.3)


def test_recall_of_clustered_vectors(spark):
    x = clustered()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert recall(spark, df) >= 0.9


def test_clustered_vectors_need_little_work():
    x = clustered().astype(float)
    rng = np.random.default_rng(5)
    asked = x[rng.choice(len(x), 256, replace=False)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argsort(-(asked / np.linalg.norm(asked, axis=1, keepdims=True)) @ unit.T, axis=1)[:, 1:6]
    index = fit(x, asked, x[near.ravel()], np.repeat(np.arange(256), 5), len(x), 10_000, 0.95, 64, 7)
    assert index.recall >= 0.95 and index.work < 0.2
    blocks, own = index.blocks(x), index.blocks(asked)
    seen = (np.abs(own[:, None, :] - blocks[None, :, :]) <= 1).any(axis=2)
    assert seen.mean() < 0.2 and np.take_along_axis(seen, near, axis=1).mean() >= 0.9


def test_random_vectors_are_never_scored_more_than_once_over(spark):
    x = np.random.default_rng(6).normal(size=(3000, 64))
    asked = x[:100]
    near = np.argsort(-(asked / np.linalg.norm(asked, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, axis=1)[:, 1:6]
    assert fit(x, asked, x[near.ravel()], np.repeat(np.arange(100), 5), len(x), 10_000, 0.95, 64, 7).work <= 1
