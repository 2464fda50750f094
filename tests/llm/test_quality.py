import re

import pytest
from pyspark.sql import functions as F

from thalweg.llm.quality import BOILERPLATE, SYMBOLS, Rules, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    r = Rules()
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    chars = sum(map(len, words))
    removed = removed_chars = 0
    kept_lines = []
    for line in text.split("\n"):
        w = WORD.findall(line)
        c = sum(map(len, w))
        bars, shout = line.count("|"), line.count("!") + line.count("?")
        bad = bars >= r.nav_bars and bars * r.nav_words_per_bar >= len(w)
        bad |= 100 * sum(x in SYMBOLS for x in line) > r.symbol_percent * c
        bad |= shout >= r.shout_marks and shout * r.shout_words_per_mark >= len(w)
        bad |= len(w) >= r.unpunctuated_words and not any(x in ".,;:!?" for x in line)
        low = re.sub("[A-Z]", lambda m: m[0].lower(), line)
        bad |= len(w) <= r.boilerplate_words and any(p in low for p in BOILERPLATE)
        if bad and w:
            removed, removed_chars = removed + 1, removed_chars + c
        else:
            kept_lines.append(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return {
        "n_words": len(words),
        "word_chars": chars,
        "n_symbols": sum(x in SYMBOLS for x in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_removed_lines": removed,
        "removed_chars": removed_chars,
        "base_failed": failed,
        "kept": not failed and 100 * removed_chars <= r.lost_percent * chars,
        "cleaned_text": "\n".join(kept_lines),
    }


TEXTS = [
    None,
    "",
    " \n\n\t ",
    "a",
    "a a a a",
    "é é\x1c x",
    "\n".join(["home | about | news | more"] * 3 + ["word " * 60 + "."]),
    "Licensed under the MIT License.\n" + " ".join(f"w{i}," for i in range(80)),
    " ".join(f"w{i}" for i in range(70)),
    "BUY!! NOW!! BUY!! NOW!!\nfine line here.",
    "x ### *** y\nplain",
    "same line here\nsame line here\nother\nsame line here",
    "\n".join(" ".join(f"é{i}{j}" for j in range(9)) + "." for i in range(4000)),
    "z" * 300_000,
]


@pytest.mark.parametrize("extra", [False, True])
def test_against_brute_force(spark, extra):
    texts = [t for t in TEXTS if t is None or len(t) < 5000]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(99, "a a a a")], "doc_id long, text string")
    rows = rows.withColumn("kept", F.lit(1)) if extra else rows
    got = {r.doc_id: r.asDict() for r in quality(rows).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        if t is None:
            want["cleaned_text"] = None
        assert {k: got[i][k] for k in want} == want, t
    assert got[99]["n_repeat_words"] == 4


def test_long_texts(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality(rows, cleaned=False).collect()}
    assert got[len(TEXTS) - 1].word_chars == 300_000
    assert got[len(TEXTS) - 2].n_words == 36_000 and got[len(TEXTS) - 2].kept
    assert quality(rows.limit(0)).count() == 0


def test_real_rows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.asDict() for r in quality(rows).collect()}
    for r in rows.collect():
        if len(r.text or "") < 6000:
            want = brute(r.text)
            assert {k: got[r.doc_id][k] for k in want} == want
    assert sum(r["kept"] for r in got.values()) > 0.5 * len(got)
