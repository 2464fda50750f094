import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from thalweg.llm.mixing import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(rows):
    size = Counter()
    for _, s, t in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        rest = [s for s in order if s not in capped]
        share = {s: Fraction(left * weight[s], sum(weight[x] for x in rest)) for s in rest}
        over = {s for s in rest if share[s] > 3 * size[s]}
        if not over:
            return size, {s: float(3 * size[s]) if s in capped else float(share[s]) for s in order}
        capped |= over


def check(df, rows, near=None):
    size, target = brute_targets(rows)
    got = mix(df).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, _, t in rows)
    taken, longest = Counter(), Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        if size[r.source]:
            assert abs(r.copies - r.target / r.source_size) < 1 or not r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - target[s]) <= longest[s] + 1e-6, (s, taken[s], target[s])
    assert sorted(map(str, got)) == sorted(map(str, mix(df).collect()))
    return got


def test_real_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(df, [(r.doc_id, r.source, r.text) for r in df.collect()])


def test_small_blocks_make_a_tree(spark):
    rows = [(k, "ab"[k % 3 == 0], "w " * (k % 37)) for k in range(2500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    size, target = brute_targets(rows)
    got = mix(df, block=4).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    assert len(got) == 2500 and all(abs(taken[s] - target[s]) <= 37 for s in size)


def test_expectation(spark):
    rows = [(k, "x" if k < 400 else "y", "w " * (1 + k % 5)) for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").persist()
    small, runs = defaultdict(int), 4
    for seed in range(runs):
        for r in mix(df, seed=100 * seed, block=30).collect():
            small[r.source] += r.copies * (r.size == 1)
    size, target = brute_targets(rows)
    for s in size:
        assert small[s] / runs / 80 == pytest.approx(target[s] / size[s], abs=0.12)  # the same for documents of any size


def test_edges(spark):
    rows = [(1, None, "a b c"), (1, None, "a b c"), (2, None, None), (3, "é", ""), (4, "z", "one"), (4, "z", "one"), (5, "Z", "x\x0by\x85z\x1c " * 40), (None, "Z", "q q")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("s")).withColumn("p", F.lit(0)).withColumn("n", F.lit(1))
    check(df, rows)
    assert mix(df.limit(0)).count() == 0
    assert [r.taken for r in mix(df.where("text is null")).collect()] == [0]


def test_many_sources_and_a_long_text(spark):
    rows = [(k, f"s{k % 1500:04d}", "w " * (k % 37)) for k in range(4000)] + [(9000, "s0003", "long words " * 200_000)]
    check(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6), rows)


def test_kept_columns_come_along(spark):
    rows = [(k % 7, "ab"[k % 2], "w " * (1 + k % 3), k, f"n{k}") for k in range(60)]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string, text string, copies int, name string"), keep=("name",)).collect()
    assert sorted(r.name for r in got) == sorted(r[4] for r in rows)
