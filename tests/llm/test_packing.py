import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from thalweg.llm.packing import combinations, nnls, pack, plan

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(df, window):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    got = pack(df, PATH, window=window).withColumn("crc", F.crc32("ids")).collect()
    want = defaultdict(list)
    for r in df.collect():
        want[r.doc_id].append([*t.encode(r.text or "", add_special_tokens=False).ids, 1])
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and r.crc == zlib.crc32(ids.astype("<u4").tobytes())
        docs[r.doc_id].append((r.start, ids.tolist(), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert docs.keys() == want.keys()
    for k, texts in want.items():
        assert sum(len(p[1]) for p in docs[k]) == sum(map(len, texts))
        if len(texts) == 1:
            own = sorted(docs[k])
            assert [i for p in own for i in p[1]] == texts[0] and {p[2] for p in own} == {len(texts[0])}
            at = 0
            for start, ids, _ in own:
                assert start == at
                at += len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, len(sequences), got


@pytest.mark.parametrize("window", [64, 2048])
def test_real_rows(spark, window):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(5)
    padding, _, _ = check(df, window)
    assert padding == 0


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "word " * 500), (5, "x"), (None, "nine")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(3)).withColumn("rank", F.lit("q"))
    assert check(df, 16)[0] == 0
    assert pack(df.limit(0), PATH).count() == 0
    same = spark.createDataFrame([(k, "the same text") for k in range(300)], "doc_id long, text string")
    assert check(same, 16)[0] == 0


def test_plan_uses_every_document_once():
    rng = np.random.default_rng(2)
    for _ in range(20):
        window = int(rng.choice([8, 32, 64]))
        counts = rng.integers(0, 50, window) * (rng.random(window) < rng.random())
        p = plan(counts)
        first = {x: lo for x, lo, _ in p.stream}
        for x in range(1, window):
            own = sorted((lo, hi) for y, lo, hi, _, _ in p.slots if y == x)
            at = 0
            for lo, hi in own:
                assert lo == at
                at = hi
            assert at == counts[x] if x not in first else at == first[x] < counts[x]


def test_nnls_fits_what_can_be_fitted():
    rng = np.random.default_rng(4)
    counts = np.zeros(64)
    for a in range(1, 32):
        n = int(rng.integers(5, 200))
        counts[a] += n
        counts[64 - a] += n
    combos = combinations(counts.astype(np.int64))
    x = nnls(combos, counts)
    fit = np.zeros(64)
    for c, n in zip(combos, x, strict=True):
        for length in c[c > 0]:
            fit[length] += n
    assert (x >= 0).all() and np.abs(fit - counts).sum() < 0.01 * counts.sum()


def test_a_very_long_text(spark):
    rows = [(1, "many words, and more of them, " * 60_000), (2, "short"), (3, "x\u2003y " * 3000)]
    assert check(spark.createDataFrame(rows, "doc_id long, text string"), 2048)[0] == 0
