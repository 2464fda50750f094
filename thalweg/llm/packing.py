"""Packing documents into windows of a fixed number of tokens, with hardly any padding.

Documents are tokenized once; each is whole windows and a rest. Only the histogram of the rests'
lengths comes to the driver (one number per length, so at most as many as a window has tokens). There:

1. Shallow combinations of lengths that fill a window exactly (pairs and triples) are enumerated.
2. Non-negative least squares over the histogram gives how often each combination is repeated; the
   solutions are rounded down to what the histogram can pay.
3. What is left over is packed greedily, longest first, each window filled until a piece is cut at
   its end. The last, partial window is cut into windows whose sizes are powers of two, which need
   no padding.

The plan says which ranks among the documents with a rest of one length go where. A document's rank
is its number within its own partition plus the count in partitions before, so that no task sees more
than its partition, however many documents share a length.

Defined results: a null text counts as empty; every document ends in one end token, so an empty one has
one token. Rows with the same id are separate documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thalweg.llm.shared import discard, look_up, marks, written
from thalweg.llm.tokens import encoder

#: Triples that are considered at most, those first whose scarcest length is most frequent. Pairs are all considered.
TRIPLES = 6000


def combinations(counts: np.ndarray, triples: int = TRIPLES) -> np.ndarray:
    """Rows of three lengths (0 for none, in descending order) that fill the window len(counts), from lengths that occur."""
    window = len(counts)
    have = np.flatnonzero(counts[1:]) + 1
    pairs = [(window - a, a, 0) for a in have.tolist() if 2 * a <= window and counts[window - a]]
    a, b = np.meshgrid(have, have, indexing="ij")
    c = window - a - b
    ok = (a >= b) & (b >= c) & (c > 0)
    a, b, c = a[ok], b[ok], c[ok]
    ok = counts[c] > 0
    a, b, c = a[ok], b[ok], c[ok]
    if len(a) > triples:
        scarce = np.minimum(np.minimum(counts[a], counts[b]), counts[c])
        best = np.argsort(-scarce, kind="stable")[:triples]
        a, b, c = a[best], b[best], c[best]
    return np.concatenate((np.array(pairs, np.int64).reshape(-1, 3), np.stack((a, b, c), axis=1)))


def nnls(combos: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeats x >= 0 that nearly minimise |A x - counts|, where A has a combination's lengths in a column (accelerated projected gradient)."""
    n = len(combos)
    if not n:
        return np.zeros(0)
    rows, used = combos.ravel(), combos.ravel() > 0
    columns = np.repeat(np.arange(n), combos.shape[1])
    rows, columns = rows[used], columns[used]
    forward = lambda x: np.bincount(rows, weights=x[columns], minlength=len(counts))
    back = lambda y: np.bincount(columns, weights=y[rows], minlength=n)
    v = np.ones(n)
    for _ in range(30):  # the largest eigenvalue of A'A
        v = back(forward(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * float(v @ back(forward(v))))
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(forward(y) - counts))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


@dataclass
class Plan:
    """Where the ranks of each length go: slots (length, from rank, to rank, first sequence, offset), then the stream of the others."""

    window: int
    slots: list[tuple[int, int, int, int, int]]
    #: (length, first rank, place of its first token in the stream) of the lengths that are streamed.
    stream: list[tuple[int, int, int]]
    stream_tokens: int
    sequences: int  # of the combinations


def plan(counts: np.ndarray, triples: int = TRIPLES, rounds: int = 3) -> Plan:
    """counts[k]: the documents whose rest has k tokens, for k below the window, which is len(counts)."""
    window = len(counts)
    counts = counts.astype(np.int64)
    counts[0] = 0
    left, slots, sequences = counts.copy(), [], 0
    taken = np.zeros(window, np.int64)
    for _ in range(rounds):
        combos = combinations(left, triples)
        repeats = np.floor(nnls(combos, left.astype(float)) + 0.5).astype(np.int64)
        used = 0
        for k in np.argsort(-repeats, kind="stable").tolist():
            n = int(repeats[k])
            if n <= 0:
                break
            own = [x for x in combos[k].tolist() if x]
            n = min(n, *(int(left[x]) // own.count(x) for x in own))
            if n <= 0:
                continue
            offset = 0
            for x in own:
                slots.append((x, int(taken[x]), int(taken[x]) + n, sequences, offset))
                taken[x] += n
                left[x] -= n
                offset += x
            sequences += n
            used += n
        if not used:
            break
    stream, place = [], 0
    for x in range(window - 1, 0, -1):
        if left[x]:
            stream.append((x, int(taken[x]), place))
            place += x * int(left[x])
    return Plan(window, slots, stream, place, sequences)


def tokenized(df: DataFrame, tokenizer: str, window: int, end_token: int, doc_id: str, text: str) -> DataFrame:
    """A written table: doc_id, n_tokens, ids (little-endian), part, rest length and its rank in the part, whole windows before in the part."""
    kind = df.schema[doc_id].dataType.simpleString()

    def encode(batches):
        e = encoder(tokenizer)
        end = np.array([end_token], "<u4").tobytes()
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ranks, before = np.zeros(window, np.int64).tolist(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = [np.frombuffer(e.encode(t.as_py()), e.kind).astype("<u4").tobytes() + end for t in some.column(1)]
                sizes = [len(x) // 4 for x in ids]
                rest, rank, whole = [], [], []
                for n in sizes:
                    r = n % window
                    rest.append(r)
                    rank.append(ranks[r])
                    ranks[r] += 1
                    whole.append(before)
                    before += n // window
                columns = [some.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array([part] * len(ids), pa.int32()), pa.array(rest, pa.int32()), pa.array(rank, pa.int64()), pa.array(whole, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "part", "rest", "rank", "whole"])

    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return written(rows.mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids binary, part int, rest int, rank long, whole long"), "tokens", compression="zstd")


def _before(counts: DataFrame, key: str, n: str) -> DataFrame:
    """With the running sum of n over earlier parts, per key: rows are one per part and key."""
    w = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("base", F.coalesce(F.sum(n).over(w), F.lit(0)))


def pack(df: DataFrame, tokenizer: str, window: int = 2048, end_token: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian, 4 bytes each), doc_tokens, sequence_id, offset.

    A sequence is its pieces in order of offset, padded to the window unless it has a power of two tokens.
    """
    spark: SparkSession = df.sparkSession
    table = tokenized(df, tokenizer, window, end_token, doc_id, text)

    per_part = written(table.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.expr(f"n_tokens div {window}")).alias("whole_n")), "lengths")
    counts = np.zeros(window, np.int64)
    for r in per_part.groupBy("rest").agg(F.sum("n").alias("n")).collect():
        counts[r.rest] = r.n
    p = plan(counts)
    body = p.stream_tokens // window * window
    tail = [body]
    for k in range(window.bit_length() - 1, -1, -1):
        if (p.stream_tokens - body) >> k & 1:
            tail.append(tail[-1] + (1 << k))
    whole_from = p.sequences + body // window + len(tail) - 1

    # What comes before a part, by length (and, as one more length, whole windows), where its tasks find it: no token is shuffled.
    ranks = _before(per_part.select("part", "rest", "n"), "rest", "n").select("part", "rest", "base")
    wholes = _before(per_part.groupBy("part").agg(F.sum("whole_n").alias("n")).withColumn("rest", F.lit(window)), "rest", "n").select("part", "rest", "base")
    before = marks(ranks.unionByName(wholes).select(F.col("part").cast("long").alias("_file"), F.col("rest").cast("long").alias("_row"), F.col("base").alias("value")), "bases")
    discard(per_part)
    part, base = F.col("part").cast("long"), look_up(before)
    rows = table.withColumn("rank", F.col("rank") + base(part, F.col("rest").cast("long"))).withColumn("whole", F.col("whole") + base(part, F.lit(window).cast("long")))
    rows = rows.select("doc_id", "n_tokens", "ids", "rest", "rank", "whole")

    # Per length its slots by first rank, and where its stream begins: at most one row per length, and no more slots than plan() makes.
    slots: dict[int, list] = {}
    for x, lo, hi, sequence, offset in p.slots:
        slots.setdefault(x, []).append((lo, hi, sequence, offset))
    stream = {x: (lo, place) for x, lo, place in p.stream}
    where = spark.createDataFrame(
        [(x, sorted(slots.get(x, [])), *stream.get(x, (None, 0))) for x in sorted(slots.keys() | stream.keys())],
        "rest int, slots array<struct<lo: long, hi: long, seq: long, off: long>>, lo long, place long",
    )
    rows = rows.join(F.broadcast(where), "rest", "left")
    rows = rows.withColumn("head", F.expr(f"n_tokens - rest")).withColumn("at", F.expr("place + (rank - lo) * rest"))
    whole = F.expr(f"transform(if(head > 0, sequence(0L, head div {window} - 1), cast(array() AS array<long>)), k -> struct(k * {window} AS start, {window}L AS length, {whole_from}L + whole + k AS sequence_id, 0L AS offset))")
    slot = F.expr("transform(filter(slots, s -> s.lo <= rank AND rank < s.hi), s -> struct(head AS start, cast(rest AS long) AS length, s.seq + rank - s.lo AS sequence_id, s.off AS offset))")
    streamed = F.expr(
        f"""transform(if(at < {body}, sequence(at div {window}, (least(at + rest, {body}L) - 1) div {window}), cast(array() AS array<long>)),
            k -> struct(head + greatest(at, k * {window}) - at AS start, least(at + rest, (k + 1) * {window}) - greatest(at, k * {window}) AS length,
                        {p.sequences}L + k AS sequence_id, greatest(at, k * {window}) - k * {window} AS offset))"""
    )
    parts = [whole, F.when(F.col("rank") >= F.col("lo"), streamed).otherwise(slot)]
    if len(tail) > 1:
        ends = ", ".join(f"struct({a}L AS a, {b}L AS b, {p.sequences + body // window + k}L AS seq)" for k, (a, b) in enumerate(pairwise(tail)))
        last = F.expr(
            f"""transform(filter(array({ends}), s -> s.a < at + rest AND at < s.b),
                s -> struct(head + greatest(at, s.a) - at AS start, least(at + rest, s.b) - greatest(at, s.a) AS length, s.seq AS sequence_id, greatest(at, s.a) - s.a AS offset))"""
        )
        parts.append(F.when(F.col("rank") >= F.col("lo"), last))
    pieces = F.filter(F.concat(*[F.coalesce(x, F.expr("cast(array() AS array<struct<start: long, length: long, sequence_id: long, offset: long>>)")) for x in parts]), lambda s: s["length"] > 0)
    out = rows.select("doc_id", "n_tokens", "ids", F.explode(pieces).alias("p"))
    cut = F.expr(f"substring(ids, cast(p.start * 4 + 1 AS int), cast(p.length * 4 AS int))")
    return out.select("doc_id", "p.start", "p.length", cut.alias("ids"), F.col("n_tokens").alias("doc_tokens"), "p.sequence_id", "p.offset")
