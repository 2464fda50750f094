"""Language ID by rank order: the most frequent n-grams of a text against each language's profile.

A text becomes runs of lower-cased letters with one space between and around them; its n-grams are of
one to three characters. A language's profile is its most frequent n-grams in rank order, learned from
labelled rows. A text's own most frequent n-grams, also in rank order, are held against each profile:
each counts the difference of its two ranks, or the profile's size where the profile lacks it, and
the language with the smallest sum is predicted; of equal sums the first by name.

Defined results: a null text, and one without a letter, is ``und`` with score 0, as is every text if
nothing was learned. Repeated rows are predicted alike. Columns named lang_pred or score are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thalweg.llm.shared import discard, written

UNDETERMINED = "und"
_letters: list[np.ndarray] = []


def _table() -> np.ndarray:
    """Each code point's letter: itself in lower case, or a space for what is no letter."""
    if not _letters:
        table = np.full(0x110000, 32, np.int64)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low[0])
        _letters.append(table)
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """The n-grams of a text, packed by 21 bits a character; empty if it has no letter."""
    codes = _table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    full = codes != 32
    if not full.any():
        return np.zeros(0, np.int64)
    start = np.append(True, full[:-1])  # a space right after a letter stays
    a = codes[full | start]
    a = np.concatenate(([32] if a[0] != 32 else [], a, [32] if a[-1] != 32 else [])).astype(np.int64)
    two = (a[:-1] << 21) | a[1:]
    return np.concatenate((a[a != 32], two, (two[:-1] << 21) | a[2:]))


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, the most frequent first; of equal counts the smaller code."""
    unique, counts = np.unique(codes, return_counts=True)
    return unique[np.argsort(-counts, kind="stable")[:size]]


@dataclass
class Profiles:
    """Languages in order of name, with their n-grams in rank order."""

    grams: dict[str, list[int]]
    size: int

    def __post_init__(self) -> None:
        self.languages = sorted(self.grams)
        self.codes = np.unique(np.array([c for g in self.grams.values() for c in g], np.int64))
        self.ranks = np.full((len(self.languages), len(self.codes) + 1), self.size, np.int64)
        for k, language in enumerate(self.languages):
            own = np.array(self.grams[language], np.int64)
            self.ranks[k, np.searchsorted(self.codes, own)] = np.arange(len(own))
        self.missing = np.ones(len(self.codes) + 1, bool)
        self.missing[:-1] = False

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = grams(text) if text else np.zeros(0, np.int64)
        if not len(codes) or not self.languages:
            return UNDETERMINED, 0.0
        top = ranked(codes, self.size)
        at = np.searchsorted(self.codes, top)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == top
        own, all_ranks = np.arange(len(top))[known], self.ranks[:, at[known]]
        far = np.where(all_ranks == self.size, self.size, np.abs(all_ranks - own)).sum(axis=1) + self.size * int((~known).sum())
        best = int(np.argmin(far))
        return self.languages[best], float(1 - far[best] / (self.size * len(top)))


def fit(df: DataFrame, text: str = "text", lang: str = "lang", by: Column | None = None, size: int = 300, rows_per_language: int = 3000) -> Profiles:
    """Profiles of every non-null value of lang.

    A language with more than rows_per_language rows is learned from about that many: those with the
    smallest hash of by (by default of the text). Only profiles and row counts come to the driver.
    """
    rows = df.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), (F.xxhash64(F.col(f"`{text}`")) if by is None else F.xxhash64(by)).alias("by"))
    rows = rows.where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Profiles({}, size)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, rows_per_language / n))])
    sample = rows.where(F.pmod("by", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def count(frames):
        for frame in frames:
            for language, own in frame.groupby("lang"):
                for at in range(0, len(own), 100):
                    codes = [grams(t) for t in own["text"].iloc[at : at + 100]]
                    unique, n = np.unique(np.concatenate(codes), return_counts=True)
                    yield pd.DataFrame({"lang": language, "gram": unique, "n": n})

    found = written(sample.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect()
    discard(found)
    out: dict[str, list[int]] = {k: [] for k in counts}
    for r in best:
        out[r.lang].append(r.gram)
    return Profiles({k: v for k, v in out.items() if v}, size)


def predict(df: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """df with lang_pred and score, 0 for the farthest to 1 for equal rank orders."""
    learned, size = profiles.grams, profiles.size

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predicted(texts: pa.Array) -> pa.Array:
        p = Profiles(learned, size)
        found = [p.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"])

    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("lang_pred", "score")]
    predicted = predicted.asNondeterministic()  # or a filter on the language would predict a second time
    return df.select(*rest, predicted(F.col(f"`{text}`")).alias("_predicted")).select(*rest, "_predicted.lang_pred", "_predicted.score")
