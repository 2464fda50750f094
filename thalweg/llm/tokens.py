"""Token ids of texts under a byte-level BPE file, with ids equal to the tokenizers library's.

Whole texts are cut where the file's own splitting always cuts: at a single space, or a single \\n,
between two characters that aren't white space. The ids of such chunks are remembered per worker in a
bounded store, as most words repeat. A text with any other white space beside a space or \\n goes to the
library whole. New chunks of Latin letters and ASCII are encoded by tiktoken from the same vocabulary, if
the file's merges are in order of id, as that gives the same ids sooner. Strings of special tokens inside
a text are ordinary text.
"""

from __future__ import annotations

import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Chunks whose ids a worker keeps.
REMEMBERED = 100_000


#: Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LATIN = "\u0250"


class _Whole(Exception):
    """The text can't be cut here."""


class _Store(dict):
    def __init__(self, of, size: int, longest: int = 64) -> None:
        self.of, self.half, self.longest, self.old = of, max(1, size // 2), longest, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.of(key)
        if len(key) <= self.longest:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def _quick(path: str):
    """tiktoken's encoder for the file, or None if the file isn't byte-level BPE of the usual kind with merges in order of id."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    split, model = told.get("pre_tokenizer") or {}, told["model"]
    if told.get("normalizer") or model.get("type", "BPE") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others follow from U+0100 on
    byte = {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    vocabulary = model["vocab"]
    pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    order = [vocabulary["".join(x)] for x in pairs]
    if order != sorted(order) or len(set(order)) != len(order):
        return None
    merged = set(order)
    ranks = {bytes(byte[c] for c in piece): k for piece, k in vocabulary.items() if all(c in byte for c in piece) and (len(piece) == 1 or k in merged)}
    return tiktoken.Encoding("quick", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """encode() gives a text's ids as little-endian integers of width bytes."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = {2: "H", 4: "I"}[self.kind.itemsize]
        self.quick = _quick(path) if sys.byteorder == "little" else None
        self.line = self._ids("\n")
        self.first = _Store(self._chunk, max(2, remembered // 8))
        self.later = _Store(lambda x: self._chunk(" " + x, 1), remembered)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _chunk(self, chunk: str, skip: int = 0) -> bytes:
        if len(chunk) == skip or chunk[skip].isspace() or chunk[-1].isspace():
            raise _Whole
        if self.quick is not None and (chunk.isascii() or max(chunk) < _LATIN):
            return array(self.code, self.quick(chunk)).tobytes()
        return self._ids(chunk)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        later, first = self.later.__getitem__, self.first
        try:
            out = []
            for line in text.split("\n"):
                head, *rest = line.split(" ")
                out.append(b"".join([first[head], *map(later, rest)]))
            return self.line.join(out)
        except _Whole:
            return self._ids(text)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for the tokenizers file at path."""
    if (path, REMEMBERED) not in _encoders:
        _encoders[path, REMEMBERED] = Encoder(path)
    return _encoders[path, REMEMBERED]


def token_numbers(path: str):
    """A column function: the number of a text's tokens (null: 0)."""

    @F.arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        e = encoder(path)
        return pa.array([len(e.encode(t.as_py())) // e.kind.itemsize for t in texts], pa.int64())

    return counted
