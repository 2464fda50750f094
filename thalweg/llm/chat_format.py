r"""Chat formatting: conversations as windows of whole turns within a token budget.

Each conversation's turns are taken in order. Prefix sums of their tokens choose the windows: a window
holds the conversation's leading system turn, a limited run of earlier turns repeated as history, and
as many new turns as the budget allows, one at least (a turn is never cut, so a turn over the budget
makes a window over it). Every turn is new in exactly one window. The loss mask covers the texts of new
turns of the target role and nothing of repeated ones.

Template, one per turn: ``<turn ROLE>\nTEXT\n</turn>\n``, and ``<turn ROLE again>`` for repeated turns.
Inside texts a backslash is put after the < of ``<turn`` and ``</turn``, and of what already has
backslashes there, so that no text holds a mark and the text can be read back; roles are escaped by %.

Defined results: a null text or role counts as empty; rows with equal turn are taken in order of role
and text, null turns first; rows whose conversation is null form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.tokens import token_numbers

_MARK = re.compile(r"<(\\*)(/?turn)")
_MARKED = re.compile(r"<\\(\\*)(/?turn)")
_HEAD = re.compile(r"<turn ([^ >]*)( again)?>\n")
_END = "\n</turn>\n"

WINDOW_TYPE = "window int, first_turn long, new_turns long, n_tokens long, text string, loss array<struct<start: int, end: int>>"


@dataclass(frozen=True)
class Budget:
    """Tokens of a window, and of the history that is repeated in it."""

    window: int = 1024
    history: int = 256


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1\2", text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"<\1\2", text)


def _role(role: str) -> str:
    return "".join(c if c.isalnum() else f"%{ord(c):x}." for c in role)


def _unrole(name: str) -> str:
    return re.sub(r"%([0-9a-f]+)\.", lambda m: chr(int(m[1], 16)), name)


def format_turn(role: str, text: str, again: bool) -> tuple[str, int]:
    """The formatted turn, and where its text begins in it."""
    head = f"<turn {_role(role)}{' again' * again}>\n"
    return head + escape(text) + _END, len(head)


def read_window(text: str) -> Iterator[tuple[str, str, bool, int, int]]:
    """Role, text, whether it is repeated, and the span of the escaped text, of each turn of a window."""
    at = 0
    while at < len(text):
        head = _HEAD.match(text, at)
        if not head:
            raise ValueError("not a formatted window")
        end = text.index(_END, head.end())
        yield _unrole(head[1]), unescape(text[head.end() : end]), bool(head[2]), head.end(), end
        at = end + len(_END)


def windows(turns: Iterator[tuple[str, str, int]], budget: Budget, target: str) -> Iterator[dict]:
    """The windows of one conversation from its (role, text, tokens); holds one window's turns at a time."""
    system: tuple[str, str, int] | None = None
    history: list[tuple[str, str, int]] = []
    new: list[tuple[str, str, int]] = []
    spent = number = first = place = 0

    def close() -> dict:
        nonlocal history, new, number, first
        parts, loss, at = [], [], 0
        repeated = ([system] if system and number else []) + history
        for again, own in ((True, repeated), (False, new)):
            for role, text, _ in own:
                part, start = format_turn(role, text, again)
                if role == target and not again:
                    loss.append({"start": at + start, "end": at + len(part) - len(_END)})
                parts.append(part)
                at += len(part)
        out = {"window": number, "first_turn": first, "new_turns": len(new), "n_tokens": spent, "text": "".join(parts), "loss": loss}
        seen = history + [t for k, t in enumerate(new) if not (system and first + k == 0)]
        total, history = 0, []
        for t in reversed(seen):
            total += t[2]
            if total > budget.history:
                break
            history.insert(0, t)
        number, first, new = number + 1, first + len(new), []
        return out

    for turn in turns:
        if place == 0 and turn[0] == "system":
            system = turn
        if new and spent + turn[2] > budget.window:
            yield close()
            kept = sum(t[2] for t in history)
            base = system[2] if system else 0
            while history and base + kept + turn[2] > budget.window:
                kept -= history.pop(0)[2]  # what is new comes before history
            spent = base + kept
        new.append(turn)
        spent += turn[2]
        place += 1
    if new:
        yield close()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True)


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Conversations in a run of sorted rows, as (id, its rows), without holding one whole."""
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def own(key=key):
            nonlocal row
            while row is not None and row[0] == key:
                yield row
                row = next(rows, None)

        run = own()
        yield key, run
        for _ in run:  # whatever wasn't taken
            pass


def _known(batches: Iterator[pa.RecordBatch]) -> tuple[pa.DataType, Iterator[pa.RecordBatch]]:
    """The type of the first column, and the batches."""
    first = next(batches, None)
    return (pa.null(), iter(())) if first is None else (first.schema.types[0], chain([first], batches))


def _batch(found: list[tuple], kind: pa.DataType, types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, *types.values()), strict=True)], ["conv_id", *types])


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_WINDOW = {"window": pa.int32(), "first_turn": pa.int64(), "new_turns": pa.int64(), "n_tokens": pa.int64(), "text": pa.string(), "loss": _SPANS}
_DIGESTS = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}


def format_conversations(df: DataFrame, tokenizer: str, budget: Budget = Budget(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """One row per window: the conversation's id, number, turns, tokens, text, and spans (in characters) of its loss mask.

    The windows of a conversation are in one partition, in order. tokenizer: path, on every executor, of a tokenizers file
    that counts a turn's tokens.
    """
    rows = df.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", token_numbers(tokenizer)("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text", "tokens")

    def formatted(batches):
        kind, batches = _known(batches)
        found, size = [], 0
        for key, turns in _conversations(_rows(batches)):
            for w in windows(((t[1], t[2], t[3]) for t in turns), budget, target):
                found.append((key, *(w[c] for c in _WINDOW)))
                size += len(w["text"])
                if size > 1 << 22:
                    yield _batch(found, kind, _WINDOW)
                    found, size = [], 0
        if found:
            yield _batch(found, kind, _WINDOW)

    return rows.mapInArrow(formatted, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {WINDOW_TYPE}")


def read_back(formatted: DataFrame, ordered: bool = False) -> DataFrame:
    """Of each conversation, from its windows alone: counts and digests of its turns and of what the loss mask covers.

    ordered: formatted is what format_conversations returned, so that each conversation's windows are together and in order;
    otherwise (if they were written and read again, say) they are brought together first.
    """

    def read(batches):
        kind, batches = _known(batches)
        found = []
        for key, own in _conversations(_rows(batches)):
            turns, masked, n, covered, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, text, loss in own:
                chars += len(text)
                for role, content, again, _, _ in read_window(text):
                    if not again:
                        n += 1
                        turns.update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    plain = unescape(text[span["start"] : span["end"]])
                    covered += len(plain)
                    masked.update(plain.encode("utf-8", "surrogatepass"))
            found.append((key, n, turns.hexdigest(), covered, masked.hexdigest(), chars))
            if len(found) == 5000:
                yield _batch(found, kind, _DIGESTS)
                found = []
        if found:
            yield _batch(found, kind, _DIGESTS)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    if not ordered:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return formatted.select("conv_id", "text", "loss").mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
