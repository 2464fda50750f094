"""URL filters: all wildcard rules at once, as a bit-parallel automaton over each canonical URL.

A URL's subject is its host (A-Z lower-cased) followed by its path. Every rule becomes one or two
globs over subjects, and all globs' positions lie side by side in 64-bit words (Shift-And): one byte
of input shifts every pattern's set of reached positions, masks it with the byte's positions, and
keeps those on which a wildcard loops. A batch of URLs advances together, a byte at a time.

Glob syntax: ``?`` is one byte other than /, ``*`` any run without /, ``**`` any run; the rest is literal.

Defined results: a null URL, or one without ``://``, has an empty host and path, which no rule with a
host fits; it gets the verdict of the globs, else the default.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.llm.shared import text_blocks

#: Java and RE2 pattern of a URL: its host is group 1, its path group 2.
URL_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """verdict for a host with all its subdomains, where the path starts with path."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def _literal(text: str) -> list:
    return list(text.encode())


_ANY = np.ones(256, bool)
_IN_PART = _ANY.copy()
_IN_PART[ord("/")] = False


def parse_glob(glob: str) -> list:
    """Bytes, and (class, loops) pairs for wildcards."""
    out: list = []
    data, k = glob.encode(), 0
    while k < len(data):
        if data[k : k + 2] == b"**":
            out.append((_ANY, True))
            k += 2
        elif data[k] in b"*?":
            out.append((_IN_PART, data[k] == ord("*")))
            k += 1
        else:
            out.append(data[k])
            k += 1
    return out


class GlobSet:
    """Patterns (as of parse_glob) that are run together; a match is of the whole subject."""

    def __init__(self, patterns: Sequence[list]) -> None:
        positions = sum(1 + sum(not (isinstance(t, tuple) and t[1]) for t in p) for p in patterns)
        words = max(1, -(-positions // 64))
        self.enter, self.loop = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        self.begin, self.final = np.zeros(words, np.uint64), []
        at = 0
        for p in patterns:
            self._set(self.begin, at)
            for t in p:
                if isinstance(t, tuple) and t[1]:
                    self._set(self.loop, at, t[0])
                    continue
                at += 1
                own = t[0] if isinstance(t, tuple) else np.arange(256) == t
                self._set(self.enter, at, own)
            self.final.append((at // 64, np.uint64(at % 64)))
            at += 1

    @staticmethod
    def _set(masks: np.ndarray, at: int, own: np.ndarray | None = None) -> None:
        bit = np.uint64(1) << np.uint64(at % 64)
        if own is None:
            masks[at // 64] |= bit
        else:
            masks[own, at // 64] |= bit

    def first_match(self, subjects: pa.Array, order: Sequence[int]) -> np.ndarray:
        """For each subject the first pattern of order that matches it, else -1."""
        out = np.full(len(subjects), -1, np.int32)
        for row, n, data, offsets in text_blocks(subjects):
            sizes = np.diff(offsets)
            by_size = np.argsort(-sizes, kind="stable")
            froms, ordered = offsets[:-1][by_size], -sizes[by_size]
            reached = np.repeat(self.begin[None, :], n, axis=0)
            for k in range(int(sizes.max(initial=0))):
                m = int(np.searchsorted(ordered, -k, side="left"))
                byte, now = data[froms[:m] + k], reached[:m]
                moved = now << np.uint64(1)
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
                reached[:m] = (moved & self.enter[byte]) | (now & self.loop[byte])
            found = np.full(n, -1, np.int32)
            for p in reversed(order):
                word, bit = self.final[p]
                found[(reached[:, word] >> bit) & np.uint64(1) > 0] = p
            out[row + by_size] = found
        return out


class UrlFilter:
    """Rules (the longest that fits wins; of equal texts the first) and, where none fits, blocking globs."""

    def __init__(self, rules: Sequence[Rule], blocked_globs: Sequence[str] = (), default: str = "allow") -> None:
        self.rules, self.blocked_globs, self.default = list(rules), list(blocked_globs), default
        patterns: list[list] = []
        for r in self.rules:
            rest = [*_literal(r.host + r.path), (_ANY, True)]
            patterns += [rest, [(_IN_PART, True), ord("."), *rest]]  # the host itself, and below it
        patterns += [parse_glob(g) for g in self.blocked_globs]
        self.globs = GlobSet(patterns)
        n = 2 * len(self.rules)
        by_length = sorted(range(n), key=lambda p: -len(self.rules[p // 2].text))
        self.order = [*by_length, *range(n, len(patterns))]

    def __call__(self, subjects: pa.Array) -> np.ndarray:
        """The place of the rule that decides, or len(rules) for a blocking glob, else -1."""
        p = self.globs.first_match(subjects, self.order)
        return np.where(p < 0, -1, np.minimum(p // 2, len(self.rules)))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL_PATTERN, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PATTERN, 2), F.lit(""))


def filter_urls(df: DataFrame, rules: Sequence[Rule], blocked_globs: Sequence[str] = (), default: str = "allow", url: str = "url") -> DataFrame:
    """df with host, path, rule (its text, or null) and verdict; columns of these names are replaced."""
    rules, blocked_globs = [Rule(*r) for r in rules], list(blocked_globs)
    made = UrlFilter(rules, blocked_globs, default)

    @F.arrow_udf("int")
    def decided(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array(made(pc.binary_join_element_wise(hosts, paths, "")).astype(np.int32))

    new = ("host", "path", "rule", "verdict")
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in new]
    at = F.col("_rule")
    named = [(F.lit(k), F.lit(r.text), F.lit(r.verdict)) for k, r in enumerate(rules)]
    rule, verdict = F.lit(None).cast("string"), F.when(at == len(rules), F.lit("block")).otherwise(F.lit(default))
    if named:
        rule = F.element_at(F.create_map(*[x for k, t, _ in named for x in (k, t)]), at)
        verdict = F.coalesce(F.element_at(F.create_map(*[x for k, _, v in named for x in (k, v)]), at), verdict)
    split = df.select(*rest, host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    return split.withColumn("_rule", decided("host", "path")).select(*rest, "host", "path", rule.alias("rule"), verdict.alias("verdict"))
