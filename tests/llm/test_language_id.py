from collections import Counter

from pyspark.sql import functions as F

from thalweg.llm.language_id import fit, grams, predict


def slow_grams(text):
    text = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    if not text.strip():
        return Counter()
    text = " " + " ".join(text.split()) + " "
    return Counter(text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1) if text[i : i + n] != " ")


def pack(s):
    out = 0
    for c in s:
        out = out << 21 | ord(c)
    return out


def top(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], pack(x[0])))[:size]]


def test_grams():
    for text in ("", "12 !", "a", "Ab c", "  É, été ", "x9y", "🙂 ß日本"):
        assert Counter(grams(text).tolist()) == Counter({pack(g): n for g, n in slow_grams(text).items()}), text


def test_against_brute_force_and_held_out(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400).persist()
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit(rows.where(part != 2))
    texts = rows.collect()
    learned = {r.doc_id for r in rows.where(part != 2).select("doc_id").collect()}
    for lang in model.languages:
        total = Counter()
        for r in texts:
            if r.doc_id in learned and r.lang == lang:
                total.update(slow_grams(r.text))
        assert model.grams[lang] == [pack(g) for g in top(total, 300)]
    got = {r.doc_id: r for r in predict(rows, model).collect()}
    for r in texts[:60]:
        own = [pack(g) for g in top(slow_grams(r.text), 300)]
        far = {}
        for lang, profile in model.grams.items():
            at = {g: k for k, g in enumerate(profile)}
            far[lang] = sum(abs(at[g] - k) if g in at else 300 for k, g in enumerate(own))
        best = min(far, key=lambda x: (far[x], x))
        assert got[r.doc_id].lang_pred == best and abs(got[r.doc_id].score - (1 - far[best] / 300 / len(own))) < 1e-12
    held = [r for r in texts if r.doc_id not in learned]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) > 0.97 * len(held)


def test_edges(spark):
    rows = spark.createDataFrame([(1, "le la", "fr", 1.0), (2, None, "fr", 1.0), (3, "12", None, 1.0), (4, "", "en", 1.0), (5, "the", "en", 1.0), (5, "the", "en", 1.0)], "doc_id long, text string, lang string, score double")
    model = fit(rows)
    got = [(r.doc_id, r.lang_pred) for r in predict(rows, model).orderBy("doc_id").collect()]
    assert got == [(1, "fr"), (2, "und"), (3, "und"), (4, "und"), (5, "en"), (5, "en")]
    empty = fit(rows.limit(0))
    assert {r.lang_pred for r in predict(rows, empty).collect()} == {"und"}


def test_ties_and_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "abc abc", "two"), (2, "abc abc", "one"), (3, "xyz " * 9, "z")], "doc_id long, text string, lang string")
    model = fit(df)
    asked = spark.createDataFrame([(1, "abc abc"), (2, "abc " * 400_000), (3, "xyz\n" * 300_000)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in predict(asked, model).collect()} == {1: "one", 2: "one", 3: "z"}  # the first by name
