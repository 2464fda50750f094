import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from thalweg.llm.near_dedup import components, darts, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, threshold=0.8):
    """Class of each id, and the pairs whose similarity is too near the threshold's edge to matter."""
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = [(i, WORD.findall(t or ""), sets(t)) for i, t in rows]
    by = {}
    for i, w, s in own:
        by.setdefault(tuple(w), []).append((i, s))
    for w, group in by.items():
        if w:
            for i, _ in group:
                parent[max(root(i), root(group[0][0]))] = min(root(i), root(group[0][0]))
    where = {}
    for w, group in by.items():
        for x in group[0][1]:
            where.setdefault(x, []).append(group[0])
    seen = set()
    for group in where.values():
        for (i, s), (j, t) in combinations(group, 2):
            if (i, j) not in seen:
                seen.add((i, j))
                if len(s & t) >= threshold * len(s | t):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    for _ in range(6):
        n = int(rng.integers(3, 400))
        h = rng.integers(0, 2**63, n).astype(np.uint64)
        wx, wy = rng.integers(0, 4, n) * rng.choice([1.0, 0.5]), rng.integers(0, 4, n) * 1.0
        wx[0] = wy[0] = 1
        rows = np.repeat([0, 1], n)
        w = np.concatenate((wx, wy))
        s = darts(rows[w > 0], np.concatenate((h, h))[w > 0], w[w > 0], 2, 2000)
        want = np.minimum(wx, wy).sum() / np.maximum(wx, wy).sum()
        assert abs((s[0] == s[1]).mean() - want) < 0.06
        alone = darts(rows[w > 0][rows[w > 0] == 1] - 1, np.concatenate((h, h))[w > 0][rows[w > 0] == 1], w[w > 0][rows[w > 0] == 1], 1, 2000)
        assert (alone[0] == s[1]).all()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1080)]
    edges = [e for e in edges if e[0] != e[1]]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def planted():
    rng = random.Random(7)
    word = lambda: "w" + str(rng.randrange(5000))
    rows, line = [], " ".join(word() for _ in range(40))
    for g in range(12):
        base = [word() for _ in range(rng.randint(30, 400))]
        for c in range(rng.randint(1, 9)):
            copy = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    base = [word() for _ in range(300)]  # a large group whose members differ from each other
    for _ in range(60):
        copy = base[:]
        for _ in range(4):
            copy[rng.randrange(300)] = word()
        rows.append(" ".join(copy))
    rows += [line + "\n" + " ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(60)]  # a common line
    chain = [word() for _ in range(200)]
    for _ in range(12):
        chain = chain[6:] + [word() for _ in range(6)]
        rows.append(" ".join(chain))
    rows += ["a b c", "a  b\tc", "a b c d", "a b c d e", "A b c d e", "x " * 50, "x " * 60, "é è " * 40]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    texts = planted()
    rows = list(enumerate(texts)) + [(2000, None), (2001, None), (2002, ""), (2003, " \n"), (2004, ""), (0, texts[0])]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, class_id string").repartition(3)
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = brute([r for r in rows if r[0] < 2000])
    assert {r.doc_id: r.class_id for r in got if r.doc_id < 2000} == want
    assert all(r.class_id == r.doc_id for r in got if r.doc_id >= 2000)
    assert near_duplicates(df.limit(0)).count() == 0


def test_null_ids_and_counts(spark):
    df = spark.createDataFrame([(None, "a b"), (5, "a b"), (None, "q r s t u v"), (7, "p " * 9)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id) for r in near_duplicates(df, weighting="count").collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (None, None), (7, 7)], key=str)


def test_real_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.length("text") < 6000).limit(500)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert {r.doc_id: r.class_id for r in near_duplicates(df).collect()} == brute(rows)


def test_one_id_on_several_texts(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(120)) for _ in range(6)]
    rows = [(1, t) for t in texts] + [(10 + i, t + " more") for i, t in enumerate(texts)] + [(30, "one of a kind and like no other text at all")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(1, 1)] * 6 + [(10 + i, 1) for i in range(6)] + [(30, 30)]


def test_very_long_texts(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(90_000)}" for _ in range(220_000)]
    other = base[:]
    for k in range(0, len(other), 2000):
        other[k] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base[:100_000])), (4, "a few words that are not in any other")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_buckets_cut_by_ranges(spark):
    # many near copies over many partitions: every bucket's members are dealt over several tasks
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(700):
        copy = base[:]
        copy[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(base)) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert {r.class_id for r in near_duplicates(df).collect()} == {0}
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before["spark.sql.execution.arrow.maxRecordsPerBatch"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_tables_in_between_are_removed(spark):
    import pathlib

    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir"), "tables")
    df = spark.createDataFrame([(i, "the same few words of a text " * (1 + i % 2)) for i in range(9)], "doc_id long, text string")
    before = set(folder.iterdir()) if folder.exists() else set()
    near_duplicates(df).collect()
    assert len(set(folder.iterdir()) - before) <= 2  # the classes, and the rows of a table that is in no file


def test_runs():
    import pyarrow as pa

    from thalweg.llm.near_dedup import _runs

    rng = np.random.default_rng(0)
    for _ in range(500):
        n = int(rng.integers(0, 30))
        b, r, d = np.sort(rng.integers(0, rng.integers(1, 12), n)), rng.permutation(n) + 100, np.arange(n)
        cuts = [0, *sorted(rng.integers(0, n + 1, rng.integers(0, 5)).tolist()), n]
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in (b[i:j], d[i:j], b[i:j].astype(np.int32), r[i:j])], list("abcd")) for i, j in zip(cuts, cuts[1:], strict=False)]
        got = [x for o in _runs(iter(batches)) for x in zip(*(c.to_pylist() for c in o.columns), strict=True)]
        want, keys = [], sorted(set(b.tolist()))
        for k in keys:
            m, edge = r[b == k].tolist(), k in (keys[0], keys[-1])
            want += [(k, k, z, m[0], len(m) if edge and z == m[0] else 0) for z in m if edge or len(m) > 1]
        assert sorted(got) == sorted(want)
