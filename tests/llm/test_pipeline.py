from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm import test_mixing, test_near_dedup, test_quality
from thalweg.llm.shared import written


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(9001, None, "en", "src0", 0), (9002, "123 456", "en", None, 7), (9003, "tiny text.", None, "src1", 10)]
    docs = written(docs.unionByName(spark.createDataFrame(extra, docs.schema)), "docs")
    columns, rows = docs.columns, docs.collect()

    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        out[name] = docs.collect()
        assert name == "packing" or docs.columns == columns

    assert {r.doc_id for r in out["language_id"]} == {r.doc_id for r in rows} - {9001, 9002}

    judged = {r.doc_id: test_quality.brute(r.text) for r in out["language_id"]}
    assert {r.doc_id: r.text for r in out["quality_rules"]} == {i: j["cleaned_text"] for i, j in judged.items() if j["kept"]}
    assert all(r.n_chars == len(r.text) for r in out["quality_rules"])

    classes = test_near_dedup.brute([(r.doc_id, r.text) for r in out["quality_rules"]])
    assert sorted(r.doc_id for r in out["near_dedup"]) == sorted(i for i, c in classes.items() if i == c)

    size, target = test_mixing.brute_targets([(r.doc_id, r.source, r.text) for r in out["near_dedup"]])
    taken, longest = Counter(), Counter()
    for r in out["mixing"]:
        n = len(test_mixing.WORD.findall(r.text))
        taken[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    times = Counter(r.doc_id for r in out["mixing"])
    assert max(times.values()) <= 3 and times.keys() <= {r.doc_id for r in out["near_dedup"]}
    most = max(len(test_mixing.WORD.findall(r.text)) for r in out["near_dedup"])
    assert all(abs(taken[s] - target[s]) <= most for s in size)

    pieces, sequences = defaultdict(int), defaultdict(list)
    for p in out["packing"]:
        pieces[p.doc_id] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
        assert 0 <= p.start and p.start + p.length <= p.doc_tokens
    tokens = {p.doc_id: p.doc_tokens for p in out["packing"]}
    assert {i: n * tokens[i] for i, n in times.items()} == dict(pieces)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0


def test_run_on_no_documents(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_repeated_rows_and_nulls(spark):
    names = ["copies", "copy", "score", "kept", "lang_pred", "class_id", "_file", "_row", "place", "c0", "cleaned_text"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    rows = [tuple(r) for r in docs.collect()]
    long = "A sentence of plain words that goes on for a while, so that it is kept. " * 20
    rows += [rows[5]] * 3 + [(None, long, "en", "src0", len(long)), (None, None, None, None, None), (7000, "", "en", "src1", 0), (7001, (long + "\n") * 900, "en", "src1", 1_300_000)]
    made = [r + tuple(f"{n} of {k}" for n in names) for k, r in enumerate(rows)]
    kind = docs.schema.simpleString()[7:-1].replace(":", " ") + "".join(f", `{n}` string" for n in names)
    docs = written(spark.createDataFrame(made, kind), "docs")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        docs = written(out, name)
        for r in docs.collect():  # each row's own columns stay together
            k = int(r["copies"].split()[-1])
            assert r.doc_id == rows[k][0] and all(r[n] == f"{n} of {k}" for n in names)
    ids = Counter(r.doc_id for r in docs.collect())
    assert ids[rows[5][0]] <= 3


def test_mixing_of_repeated_rows(spark):
    text = "some words in a row " * 3
    docs = spark.createDataFrame([(1, text, "en", "a", 9)] * 3 + [(2, text, "en", "b", 9)] * 5, "doc_id long, text string, lang string, source string, n_chars long")
    size, target = test_mixing.brute_targets([(r.doc_id, r.source, r.text) for r in docs.collect()])
    got = Counter(r.source for r in corpus_pipeline.mixed(spark, docs, "").collect())
    assert all(abs(got[s] * 15 - target[s]) <= 15 for s in size)
