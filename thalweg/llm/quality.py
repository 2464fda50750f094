"""Quality rules: lines are judged first, and a document goes when too little of it is left.

Each line of a text (split at \\n) is held against the line rules; failing lines are removed. The
document's verdict then rests on a base of whole-text counts and on the share of its word characters
that stood on removed lines.

Defined results: a null text counts as empty, and a text without words fails the base. Repeated rows
are judged alike. Columns of the input that have a name of a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.shared import Spans, mix64, text_blocks, window_hashes, word_spans

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Phrases (ASCII lower case) that mark a line as boilerplate if it is short.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "licensed under",
    "privacy policy",
    "released under the",
    "terms of service",
    "terms of use",
)


@dataclass(frozen=True)
class Rules:
    """Bounds of the rules; the base's are the last two."""

    #: A navigation line has this many bars at least, and one to every so many words at least.
    nav_bars: int = 3
    nav_words_per_bar: int = 4
    #: A line fails if more than this percentage of its word characters are symbols.
    symbol_percent: int = 20
    #: A shouting line has this many ! and ? at least, and one to every so many words at least.
    shout_marks: int = 4
    shout_words_per_mark: int = 2
    #: A line with this many words must have some punctuation.
    unpunctuated_words: int = 60
    #: Only lines up to this many words can be boilerplate.
    boilerplate_words: int = 30
    #: A document goes if removed lines held more than this percentage of its word characters.
    lost_percent: int = 50
    least_words: int = 50
    repeat_percent: int = 50


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_removed_lines", "removed_chars")
_TYPE = f"struct<{', '.join(f'{c}: bigint' for c in _COUNTS)}, base_failed: boolean, kept: boolean"


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _BAR, _SHOUT, _POINT = _mask(SYMBOLS), _mask("|"), _mask("!?"), _mask(".,;:!?")
_START = np.ones(256, bool)
_START[0x80:0xC0] = False  # bytes that continue a code point


def _running(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def judge_block(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The counts and verdicts of a block's rows; start and end of its lines, and which of these are removed."""
    n = len(offsets) - 1
    starts, ends, rows = word_spans(data, offsets)
    spans = Spans(data)
    words = spans.hashes(starts, ends)

    breaks = np.flatnonzero(data == 0x0A)
    line_from = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], breaks + 1)))
    line_from = line_from[line_from < len(data)]
    line_to = np.append(line_from[1:], len(data))
    line_row = np.searchsorted(offsets, line_from, side="right") - 1
    line_to = np.where((line_to > line_from) & (data[np.maximum(line_to - 1, 0)] == 0x0A), line_to - 1, line_to) if len(line_from) else line_to

    in_word = np.zeros(len(data) + 1, np.int8)
    in_word[starts] = 1
    in_word[ends] -= 1
    chars = _running((np.cumsum(in_word[:-1], dtype=np.int8) > 0) & _START[data])
    symbols, bars, shouts, points = (_running(x[data]) for x in (_SYMBOL, _BAR, _SHOUT, _POINT))
    word_at = _running(in_word[:-1] > 0)
    word_at[1:] = np.searchsorted(starts, np.arange(1, len(data) + 1))  # words that start before a byte

    of = lambda sums: sums[line_to] - sums[line_from]
    line_words, line_chars, line_bars, line_shouts = of(word_at), of(chars), of(bars), of(shouts)
    removed = (line_bars >= rules.nav_bars) & (line_bars * rules.nav_words_per_bar >= line_words)
    removed |= 100 * of(symbols) > rules.symbol_percent * line_chars
    removed |= (line_shouts >= rules.shout_marks) & (line_shouts * rules.shout_words_per_mark >= line_words)
    removed |= (line_words >= rules.unpunctuated_words) & (of(points) == 0)
    lower = data.tobytes().lower()
    for phrase in BOILERPLATE:
        at = lower.find(phrase.encode())
        while at >= 0:
            line = int(np.searchsorted(line_from, at, side="right")) - 1
            if at + len(phrase) <= line_to[line] and line_words[line] <= rules.boilerplate_words:
                removed[line] = True
            at = lower.find(phrase.encode(), at + 1)
    removed &= line_words > 0

    by_row = lambda r, w=None: np.bincount(r, weights=w, minlength=n).astype(np.int64)
    own = line_words > 0
    key = mix64(spans.hashes(line_from[own], line_to[own]) ^ mix64(line_row[own].astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    dup_lines = by_row(line_row[own]) - by_row(line_row[own][first])

    triples, at = window_hashes(words, rows, 3)
    key = triples ^ mix64(rows[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words) + 3, bool)
    for k in range(3):
        covered[at[twice] + k] = True

    span = lambda sums: sums[offsets[1:]] - sums[offsets[:-1]]
    out = {
        "n_words": by_row(rows),
        "word_chars": span(chars),
        "n_symbols": span(symbols),
        "n_dup_lines": dup_lines,
        "n_repeat_words": by_row(rows[covered[: len(words)]]),
        "n_lines": by_row(line_row[own]),
        "n_removed_lines": by_row(line_row[removed]),
        "removed_chars": by_row(line_row[removed], line_chars[removed]),
    }
    out["base_failed"] = (out["n_words"] < rules.least_words) | (100 * out["n_repeat_words"] > rules.repeat_percent * out["n_words"])
    out["kept"] = ~out["base_failed"] & (100 * out["removed_chars"] <= rules.lost_percent * out["word_chars"])
    return out, line_from, line_to, removed


def _judge(texts: pa.Array, rules: Rules, clean: bool) -> pa.StructArray:
    parts: list[dict[str, np.ndarray]] = []
    texts_out: list[pa.Array] = []
    for row, n, data, offsets in text_blocks(texts, 1 << 19):
        out, line_from, line_to, removed = judge_block(data, offsets, rules)
        parts.append(out)
        if clean:
            cleaned: list[str | None] = []
            touched = np.zeros(n, bool)
            touched[np.searchsorted(offsets, line_from[removed], side="right") - 1] = True
            gone = {(a, b) for a, b in zip(line_from[removed].tolist(), line_to[removed].tolist(), strict=True)}
            for k in range(n):
                if not touched[k]:
                    cleaned.append(texts[row + k].as_py())
                    continue
                at, kept = int(offsets[k]), []
                for line in data[offsets[k] : offsets[k + 1]].tobytes().split(b"\n"):
                    if (at, at + len(line)) not in gone:
                        kept.append(line)
                    at += len(line) + 1
                cleaned.append(b"\n".join(kept).decode("utf-8", "replace"))
            texts_out.append(pa.array(cleaned, pa.string()))
    columns = [pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, bool if c in ("base_failed", "kept") else np.int64)) for c in (*_COUNTS, "base_failed", "kept")]
    names = [*_COUNTS, "base_failed", "kept"]
    return pa.StructArray.from_arrays(columns + [pa.concat_arrays(texts_out) if texts_out else pa.array([], pa.string())] * clean, names + ["cleaned_text"] * clean)


def quality(df: DataFrame, text: str = "text", rules: Rules = Rules(), cleaned: bool = True) -> DataFrame:
    """df with the columns of the judgement, and with cleaned also cleaned_text: the text without removed lines."""
    values = {f.name: getattr(rules, f.name) for f in fields(rules)}

    @F.arrow_udf(_TYPE + (", cleaned_text: string>" if cleaned else ">"))
    def judged(texts: pa.Array) -> pa.Array:
        return _judge(texts, Rules(**values), cleaned)

    new = [*_COUNTS, "base_failed", "kept", *["cleaned_text"] * cleaned]
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in new]
    judged = judged.asNondeterministic()  # or a filter on the verdict would judge every text a second time
    return df.select(*rest, judged(F.col(f"`{text}`")).alias("_judged")).select(*rest, *[F.col(f"_judged.{c}").alias(c) for c in new])
