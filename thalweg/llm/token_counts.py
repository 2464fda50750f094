"""Token counts under a unigram vocabulary, without making the tokens.

The tokenizer whose counts this gives is a Unigram model (a score per piece, byte fallback for what no
piece covers) behind a Metaspace step: a space is U+2581, one is put in front, and the text is cut
before each of them. An Aho-Corasick automaton lists every vocabulary piece inside a chunk, and a
dynamic program over the end positions carries the best score and its number of pieces. Its tie rule
is the tokenizer's: of equal scores the piece that starts first stays, and an unknown character is
tried last.

Counts of chunks are remembered per worker in a bounded store, as most words repeat.

Defined results: null and empty texts count 0; a text of any length is counted whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.shared import Spans, text_blocks

#: The character for a space, and what an unknown character scores below the least piece.
SPACE = "▁"
UNKNOWN_PENALTY = 10.0

#: Chunks of at most so many characters advance together, so many at once.
LONGEST, TOGETHER = 48, 4096

_WORST = float("-inf")


@dataclass
class Vocabulary:
    """Pieces with their scores, by id; unknown characters become byte pieces if all 256 are there."""

    pieces: list[tuple[str, float]]
    unknown: int = 0
    automaton: ahocorasick.Automaton = field(init=False, repr=False)

    def __post_init__(self) -> None:
        best: dict[str, float] = {}
        for piece, score in self.pieces:
            best[piece] = float(score)
        self.automaton = ahocorasick.Automaton()
        for piece, score in best.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.links = Links(best)
        self.unknown_score = min(s for _, s in self.pieces) - UNKNOWN_PENALTY
        self.known = best.keys()
        self.bytes = all(f"<0x{b:02X}>" in best for b in range(256))
        self.breaks = self.bytes and not any("\n" in p for p in best)  # then no best path crosses \n, and it counts 1

    @classmethod
    def from_sentencepiece(cls, path: str) -> Vocabulary:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls([(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())], p.unk_id())

    def count(self, chunk: str) -> int:
        """Pieces of the best path over chunk."""
        n = len(chunk)
        best, pieces = [0.0], [0]  # of each position reached so far
        unknown = -1  # the last position whose best path ends in an unknown character
        top, count, single = _WORST, 0, False  # of the position that is being reached

        def close(upto: int) -> None:
            nonlocal top, count, single, unknown
            while True:
                at = len(best) - 1  # the character whose end is being reached
                if not single and best[at] + self.unknown_score > top:
                    top = best[at] + self.unknown_score
                    if self.bytes:
                        count = pieces[at] + len(chunk[at].encode())
                    else:
                        count = pieces[at] + (unknown != at)  # a run of them is one token
                    unknown = at + 1
                best.append(top)
                pieces.append(count)
                top, count, single = _WORST, 0, False
                if len(best) > upto:
                    return

        done = 0
        for last, (length, score) in self.automaton.iter(chunk):  # by end; for one end the longest, so the first start, comes first
            if last != done:
                if single and last == done + 1:
                    best.append(top)
                    pieces.append(count)
                    top, single = _WORST, False
                else:
                    close(last)
                done = last
            start = last + 1 - length
            score += best[start]
            if score > top:
                top, count = score, pieces[start] + 1
            if length == 1:
                single = True
        if n:
            close(n)
        return pieces[n]


    def count_many(self, chunks: list[str]) -> np.ndarray:
        """count() of each chunk; the chunks up to LONGEST characters advance together, a position at a time."""
        out = np.zeros(len(chunks), np.int64)
        short = [k for k, c in enumerate(chunks) if 0 < len(c) <= LONGEST]
        for k, c in enumerate(chunks):
            if len(c) > LONGEST:
                out[k] = self.count(c)
        for at in range(0, len(short), TOGETHER):
            own = short[at : at + TOGETHER]
            out[own] = self._together([chunks[k] for k in own])
        return out

    def _together(self, chunks: list[str]) -> np.ndarray:
        n = len(chunks)
        sizes = np.fromiter(map(len, chunks), np.int64, n)
        order = np.argsort(-sizes, kind="stable")  # so that the chunks with a k-th character come first
        text = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        froms, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        longest = int(sizes[0])
        best, pieces = np.full((longest + 1, n), _WORST), np.zeros((longest + 1, n), np.int32)
        best[0] = 0
        unknown = np.full(n, -1)  # the last position whose best path ends in an unknown character
        state = np.zeros(n, np.int64)
        for k in range(longest):
            m = int(np.searchsorted(-sizes, -k, side="left"))
            state = self.links.step(state[:m], text[froms[:m] + k])
            top, count, single = np.full(m, _WORST), np.zeros(m, np.int32), np.zeros(m, bool)
            row, left = np.arange(m), self.links.count[state]
            at = self.links.first[state]
            while True:  # of the pieces that end here, the longest of each chunk first
                on = np.flatnonzero(left > 0)
                if not len(on):
                    break
                row, left, at = row[on], left[on] - 1, at[on]
                length, start = self.links.lengths[at], k + 1 - self.links.lengths[at]
                total = best[start, row] + self.links.scores[at]
                better = total > top[row]
                r = row[better]
                top[r] = total[better]
                count[r] = pieces[start[better], r] + 1
                single[row[length == 1]] = True
                at = at + 1
            for c in np.flatnonzero(~single).tolist():
                if best[k, c] + self.unknown_score > top[c]:
                    top[c] = best[k, c] + self.unknown_score
                    count[c] = pieces[k, c] + (len(chunks[order[c]][k].encode()) if self.bytes else int(unknown[c] != k))
                    unknown[c] = k + 1
            best[k + 1, :m], pieces[k + 1, :m] = top, count
        out = np.zeros(n, np.int64)
        out[order] = pieces[sizes, np.arange(n)]
        return out


class Links:
    """The Aho-Corasick automaton as arrays, to step many chunks at a time."""

    def __init__(self, best: dict[str, float]) -> None:
        children: list[dict[int, int]] = [{}]
        ends: list[str | None] = [None]
        for piece in best:
            at = 0
            for c in map(ord, piece):
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    ends.append(None)
                at = children[at][c]
            if piece:
                ends[at] = piece
        fail = [0] * len(children)
        outputs: list[list[str]] = [[] for _ in children]
        queue = list(children[0].values())
        for state in queue:  # grows as it goes: breadth first
            outputs[state] = ([ends[state]] if ends[state] else []) + outputs[fail[state]]
            for c, child in children[state].items():
                back = fail[state]
                while back and c not in children[back]:
                    back = fail[back]
                fail[child] = children[back].get(c, 0)
                queue.append(child)
        keys = np.array([(s << 21) | c for s, own in enumerate(children) for c in own], np.int64)
        goes = np.array([t for own in children for t in own.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.goes, self.fail = np.append(keys[order], np.int64(2**62)), np.append(goes[order], 0), np.array(fail)
        self.count = np.array([len(o) for o in outputs])
        self.first = np.cumsum(self.count) - self.count
        flat = [p for o in outputs for p in o]
        self.lengths, self.scores = np.array([len(p) for p in flat], np.int64), np.array([best[p] for p in flat])

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The state after each one's next character."""
        out = np.zeros(len(state), np.int64)
        own, state, char = np.arange(len(state)), state, char.astype(np.int64)
        while len(own):
            key = (state << 21) | char
            at = np.searchsorted(self.keys, key)
            hit = self.keys[at] == key
            out[own[hit]] = self.goes[at[hit]]
            on = ~hit & (state > 0)
            own, state, char = own[on], self.fail[state[on]], char[on]
        return out


class Store:
    """Counts by 64-bit key in sorted arrays, in two generations: when the new one is full it becomes the old one."""

    def __init__(self, size: int) -> None:
        self.half = max(1, size // 2)
        self.new = self.old = (np.zeros(0, np.uint64), np.zeros(0, np.int32))

    @staticmethod
    def _find(kept: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(kept[0]):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int32)
        at = np.minimum(np.searchsorted(kept[0], keys), len(kept[0]) - 1)
        return kept[0][at] == keys, kept[1][at]

    def get(self, keys: np.ndarray, of) -> np.ndarray:
        """Values of the sorted distinct keys; of gives those of the places that aren't kept."""
        known, values = self._find(self.new, keys)
        add = np.flatnonzero(~known)
        in_old, old = self._find(self.old, keys[add])
        values[add[in_old]] = old[in_old]
        todo = add[~in_old]
        if len(todo):
            values[todo] = of(todo)
        if len(add):
            at = np.searchsorted(self.new[0], keys[add])
            self.new = np.insert(self.new[0], at, keys[add]), np.insert(self.new[1], at, values[add])
            if len(self.new[0]) > self.half:
                self.old, self.new = self.new, (np.zeros(0, np.uint64), np.zeros(0, np.int32))
        return values


class Counter:
    """Counts of whole texts; remembered bounds the chunks whose counts are kept, by a 64-bit hash."""

    def __init__(self, vocabulary: Vocabulary, remembered: int) -> None:
        self.vocabulary, self.store = vocabulary, Store(remembered)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        texts = pc.replace_substring(texts, SPACE, " ")
        out = np.zeros(len(texts), np.int64)
        for row, n, data, offsets in text_blocks(texts):
            out[row : row + n] = self._block(data, offsets)
        return out

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        full = np.flatnonzero(np.diff(offsets))
        if not len(full):
            return np.zeros(n, np.int64)
        line = (data == 0x0A) if self.vocabulary.breaks else np.zeros(len(data), bool)
        cut = np.flatnonzero((data == 0x20) | line)
        starts = np.concatenate((offsets[full], cut + 1))
        of_cut = np.concatenate((np.zeros(len(full), bool), np.ones(len(cut), bool)))
        bare = np.concatenate((np.zeros(len(full), bool), line[cut]))
        rows = np.concatenate((full, np.searchsorted(offsets, cut, side="right") - 1))
        order = np.lexsort((of_cut, starts, rows))
        starts, of_cut, bare, rows = starts[order], of_cut[order], bare[order], rows[order]
        ends = np.append(starts[1:] - of_cut[1:], offsets[-1])
        ends = np.where(np.append(rows[1:] != rows[:-1], True), offsets[rows + 1], ends)
        empty = starts == ends
        drop = empty & (bare | (~of_cut & (data[np.minimum(starts, len(data) - 1)] == 0x20)))
        starts, ends, bare, rows = (x[~drop] for x in (starts, ends, bare, rows))
        key = Spans(data).hashes(starts, ends) + bare.astype(np.uint64)
        unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        text = data.tobytes()

        def count(which: np.ndarray) -> np.ndarray:
            return self.vocabulary.count_many([("" if bare[i] else SPACE) + text[starts[i] : ends[i]].decode() for i in first[which].tolist()])

        counts = self.store.get(unique, count)[inverse]
        total = np.bincount(rows, weights=counts, minlength=n).astype(np.int64)
        if self.vocabulary.breaks:
            lines = np.concatenate(([0], np.cumsum(line)))
            total += lines[offsets[1:]] - lines[offsets[:-1]]
        return total


_counters: dict[tuple[str, int], Counter] = {}


def counter(path: str, remembered: int) -> Counter:
    """The worker's counter for the vocabulary file at path."""
    if (path, remembered) not in _counters:
        _counters[path, remembered] = Counter(Vocabulary.from_sentencepiece(path), remembered)
    return _counters[path, remembered]


def token_counts(df: DataFrame, vocabulary: str, text: str = "text", into: str = "n_tokens", remembered: int = 4_000_000) -> DataFrame:
    """df with the column into: the number of tokens of the column text (replacing a column of that name).

    vocabulary: path of a sentencepiece model file, on every executor, whose pieces and scores are the unigram vocabulary.
    remembered: chunk counts kept per worker; the results don't depend on it.
    """

    @F.arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array(counter(vocabulary, remembered)(texts))

    return df.withColumn(into, counted(F.col(f"`{text}`")))
