"""Approximate nearest neighbours by cosine: shifted Hilbert curves over projected vectors.

Each of several curves projects the unit vectors at random to a few dimensions, shifts and quantises them,
and orders them by Hilbert key. Keys are range-partitioned into the same number of blocks per curve, by
quantiles of a sample's keys. A query looks into its own block and the two beside it on
every curve, where all candidates are scored exactly; the best of all curves are merged.

How many curves and blocks there are is fitted to the table: some queries are answered by one pass over all
rows, and the blocks are as small as still leaves the wanted share of their neighbours beside them.
Curves are searched a few at a time, so that the vectors are never dealt many times at once.

Equal vectors are one candidate that keeps its k + 1 smallest ids, which is all that can be among k
nearest, so a vector that is very common costs no more than another; queries with equal vectors
are searched once. Blocks are numbered by distinct cuts, so many rows with one key make one large block. A block of
more rows than a task should hold is dealt over several tasks by hash, and each sees the block's queries. Small
tables have one block, where every candidate is scored.

On vectors with near neighbours a few curves and small blocks find them. On nearly random vectors in many dimensions
no ordering keeps neighbours together, so large blocks are fitted; a query is never scored against more rows than
the table has.

Defined results: rows with a null id, and vectors that are null, empty, zero, or with a null or non-finite component,
take no part. Vectors of each length are searched among their own. Ties go to the smaller id. Rows with equal id
and vector count once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thalweg.llm.shared import discard, written

#: Rows of a block that one task scores against the block's queries.
TASK_ROWS = 20_000
#: Rows a block has on average at least, or four times k + 1; smaller tables have fewer blocks.
BLOCK_ROWS = 64
#: Numbers of curves that are tried. Dealing a vector on one more curve costs about as much as scoring it against so many queries.
CURVES, DEAL = (4, 8, 16, 24, 32), 150
#: Queries that the fit answers exactly, about; and curves that are searched at once.
SAMPLED, TOGETHER = 256, 2


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of cells (rows of coordinates below 2**bits; bits times dimensions at most 62)."""
    x = np.ascontiguousarray(cells.T, dtype=np.int64)
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of each level, from the coarsest
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            first = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
            x[0] = first
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """Random projections with shifts, one per curve; the same for the same dimension and seed."""

    def __init__(self, dimension: int, curves: int, projected: int, bits: int, seed: int) -> None:
        rng = np.random.default_rng([seed, dimension])
        self.bits, self.projected = bits, min(projected, dimension)
        self.axes = [np.linalg.qr(rng.normal(size=(dimension, dimension)))[0][:, : self.projected] * dimension**0.5 for _ in range(curves)]
        self.shifts = rng.uniform(0, 0.5, (curves, self.projected))

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """A column of keys per curve."""
        unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        out = []
        for axes, shift in zip(self.axes, self.shifts, strict=True):
            place = np.clip((unit @ axes + 3 + shift) / 6.5, 0, 1 - 1e-9)
            out.append(hilbert_keys((place * (1 << self.bits)).astype(np.int64), self.bits))
        return np.stack(out, axis=1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, summed in the same order for every row."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def best_in_block(queries: np.ndarray, candidates: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's best: by score, then smaller id. All that tie with the last by rounding are looked at."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    c = unit(candidates / np.abs(candidates).max(axis=1, keepdims=True))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), 64):
        some = queries[at : at + 64]
        near = unit(some / np.abs(some).max(axis=1, keepdims=True)) @ c.T
        last = np.partition(near, max(0, len(c) - most), axis=1)[:, max(0, len(c) - most)]
        q, k = np.nonzero(near >= last[:, None] - 1e-9)
        score = cosines(some[q], candidates[k])
        order = np.lexsort((ids[k], -score, q))
        q, k, score = q[order], k[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        keep = place < most
        out.append((q[keep] + at, k[keep], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass(frozen=True)
class Index:
    """What is fitted on a table: its curves and, per curve, the keys that cut it into blocks."""

    curves: Curves
    cuts: list[np.ndarray]
    recall: float  # on the sample
    work: float  # candidates that a query is scored against, as a share of all rows

    def blocks(self, vectors: np.ndarray) -> np.ndarray:
        """A column of block numbers per curve."""
        keys = self.curves.keys(vectors) if any(len(c) for c in self.cuts) else np.zeros((len(vectors), len(self.cuts)), np.int64)
        return np.stack([np.searchsorted(c, keys[:, i], side="right") for i, c in enumerate(self.cuts)], axis=1)


def fit(sample: np.ndarray, asked: np.ndarray, found: np.ndarray, of: np.ndarray, n: int, asking: int, recall: float, least_rows: int, seed: int, projected: int = 12, bits: int = 5) -> Index:
    """The curves, and the most blocks on them, whose windows hold the share recall of the true neighbours of some queries.

    sample: of the table's n vectors, for the cuts. asked: some of the asking queries; found: their true neighbours, of: the
    query of each. As many curves are taken as cost least in all, for dealing and for scoring. Where any number of them would
    score the whole table or more there is one block, which is the whole table once.
    """
    dimension = max(sample.shape[1], 1)
    best = Index(Curves(dimension, 1, projected, bits, seed), [np.zeros(0, np.int64)], 1.0, 1.0)
    if n < 4 * least_rows or not len(found):
        return best
    least = np.inf
    for curves in CURVES:
        made = Curves(dimension, curves, projected, bits, seed)
        keys = np.sort(made.keys(sample), axis=0)
        ours, theirs = made.keys(asked)[of], made.keys(found)
        most = min(n // least_rows, len(sample) // 16)
        for blocks in sorted({int(4 * 1.12**i) for i in range(200) if 4 * 1.12**i <= most}, reverse=True):
            cuts = [np.unique(keys[[len(keys) * b // blocks for b in range(1, blocks)], c]) for c in range(curves)]
            apart = np.stack([np.abs(np.searchsorted(x, ours[:, c], side="right") - np.searchsorted(x, theirs[:, c], side="right")) for c, x in enumerate(cuts)])
            share = float((apart.min(axis=0) <= 1).mean())
            if share >= recall:
                work = 3 * curves / blocks
                cost = curves * DEAL + work * asking
                if work < 1 and cost < least:
                    best, least = Index(made, cuts, share, work), cost
                break
    return best


def _unpacked(data, wide: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(data), wide).astype(float).reshape(len(data), -1)


def _true_neighbours(vectors: DataFrame, ids: np.ndarray, asked: np.ndarray, k: int, wide: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Place of the query, and vector, of each of the k nearest of some queries: one pass over all vectors, each task keeping k a query."""
    unit = asked / np.linalg.norm(asked, axis=1, keepdims=True)

    def scan(batches):
        score = np.full((len(unit), k), -np.inf)
        data: np.ndarray = np.full((len(unit), k), b"", object)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                packed = np.array(some.column(1).to_pylist(), object)
                own = _unpacked(packed, wide)
                near = unit @ (own / np.linalg.norm(own, axis=1, keepdims=True)).T
                near[ids[:, None] == some.column(0).to_numpy()[None, :]] = -np.inf
                score = np.concatenate((score, near), axis=1)
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                data = np.where(top < k, np.take_along_axis(data, np.minimum(top, k - 1), axis=1), packed[np.clip(top - k, 0, len(packed) - 1)])
                score = np.take_along_axis(score, top, axis=1)
        q, j = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(score[q, j]), pa.array(data[q, j].tolist(), pa.binary())], ["q", "score", "data"])

    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "data"))
    rows = vectors.select("rep", "data").mapInArrow(scan, "q long, score double, data binary").withColumn("_rank", place).where(F.col("_rank") <= k).collect()
    return np.array([r.q for r in rows], np.int64), _unpacked([r.data for r in rows], wide) if rows else np.zeros((0, asked.shape[1]))


def nearest(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", recall: float = 0.95, sample: int = 20_000, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found for each row where is_query (over the id) holds.

    recall: the share of true neighbours to find, of about SAMPLED queries that are also answered by one pass over all rows.
    sample: about how many vectors, by their hash, the blocks' limits are taken from. Every row is indexed and searched.
    """
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("vec"), is_query.alias("is_query"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    lengths = sorted(r.n for r in rows.select(F.size("vec").alias("n")).distinct().collect())
    found = [_nearest_of_length(rows.where(F.size("vec") == n), n, k, recall, sample, seed) for n in lengths or [0]]
    return reduce(DataFrame.unionByName, found)


def _nearest_of_length(rows: DataFrame, dimension: int, k: int, recall: float, sample: int, seed: int) -> DataFrame:
    wide = np.dtype("<f8" if rows.schema["vec"].dataType.elementType.simpleString() not in ("float",) else "<f4")

    @F.arrow_udf("binary")
    def packed(vectors: pa.Array) -> pa.Array:
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(wide).reshape(len(vectors), -1) + wide.type(0)  # one zero, not two
        return pa.array([x.tobytes() for x in flat], pa.binary())

    rows = written(rows.select("vec_id", "is_query", packed("vec").alias("data")), "vectors")
    # equal vectors: the k + 1 smallest ids
    rank = F.row_number().over(Window.partitionBy("data").orderBy("vec_id"))
    few = rows.select("vec_id", "data").distinct().withColumn("_rank", rank).where(F.col("_rank") <= k + 1)
    groups = few.groupBy("data").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    groups = written(groups.select(F.col("ids")[0].alias("rep"), "ids", "data"), "vectors")
    asked = written(rows.where("is_query").select("vec_id", "data").distinct().join(groups.select("rep", "data"), "data").select(F.col("vec_id").alias("query_id"), "rep"), "queries")
    discard(rows)
    asking = written(groups.select("rep", "data").join(asked.select("rep").distinct(), "rep"), "asking")

    n, n_asking = groups.count(), asking.count()
    taken = lambda df, most, total: df.where(F.pmod(F.xxhash64("data"), F.lit(1 << 30)) < int(min(1.0, most / max(total, 1)) * (1 << 30))).select("rep", "data").collect()
    some, some_asked = taken(groups, sample, n), taken(asking, SAMPLED, n_asking)
    vectors = lambda found: _unpacked([r.data for r in found], wide) if found else np.zeros((0, dimension))
    of, near = _true_neighbours(groups, np.array([r.rep for r in some_asked], np.int64), vectors(some_asked), k, wide) if some_asked and n >= 4 * BLOCK_ROWS else (np.zeros(0, np.int64), np.zeros((0, dimension)))
    index = fit(vectors(some), vectors(some_asked), near, of, n, n_asking, recall, max(BLOCK_ROWS, 4 * (k + 1)), seed)
    curves = len(index.cuts)

    def placed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                blocks = index.blocks(_unpacked(part.column(1).to_pylist(), wide)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, blocks.size + 1, curves, dtype=np.int32)), pa.array(blocks.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], ["rep", "data", "ids", "blocks"])

    kind = "rep long, data binary, ids array<long>, blocks array<int>"
    candidates = written(groups.select("rep", "data", "ids").mapInArrow(placed, kind), "placed")
    queries = written(asking.select("rep", "data", F.array().cast("array<long>").alias("ids")).mapInArrow(placed, kind), "placed")
    discard(groups, asking)
    held = candidates.select(F.posexplode("blocks").alias("curve", "block")).groupBy("curve", "block").agg(F.ceil(F.count("*") / TASK_ROWS).cast("int").alias("parts"))
    parts = F.broadcast(written(held, "parts"))  # a row per block, of which there are at most sample / 16 on each curve

    def score(_key, own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asking):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "score": np.zeros(0)})
        ids = own["own_rep"].to_numpy()
        q, c, s = best_in_block(_unpacked(asking["asking_data"], wide), _unpacked(own["own_data"], wide), ids, k + 1)
        return pd.DataFrame({"query": asking["asking_rep"].to_numpy()[q], "rep": ids[c], "score": s})

    def searched(first: int) -> DataFrame:
        """The k + 1 best on some curves of each query; the vectors are dealt once per curve and no more than TOGETHER times at once."""
        on = lambda df: df.select("rep", "data", F.posexplode(F.slice("blocks", first + 1, TOGETHER)).alias("curve", "block")).withColumn("curve", F.col("curve") + first)
        own = on(candidates).join(parts, ["curve", "block"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        asking = on(queries).withColumn("block", F.explode(F.array(*[F.col("block") + d for d in (-1, 0, 1)])))
        asking = asking.join(parts, ["curve", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        by = ("curve", "block", "part")
        own, asking = (x.select(*[F.col(c).alias(f"{side}_{c}") for c in (*by, "rep", "data")]) for side, x in (("own", own), ("asking", asking)))
        found = own.groupBy(*[f"own_{c}" for c in by]).cogroup(asking.groupBy(*[f"asking_{c}" for c in by])).applyInPandas(score, "query long, rep long, score double")
        return written(merged(found), "found")

    def merged(found: DataFrame) -> DataFrame:
        best = found.groupBy("query", "rep").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
        return best.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k + 1).select("query", "rep", "score")

    each_curve = [searched(first) for first in range(0, curves, TOGETHER)]
    best = merged(reduce(DataFrame.unionByName, each_curve)) if len(each_curve) > 1 else each_curve[0]
    each = best.join(candidates.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    place = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    each = each.withColumn("_rank", F.row_number().over(place)).where(F.col("_rank") <= k + 1)
    lists = each.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_rank", "vec_id", "score"))).alias("near"))
    out = asked.join(lists, F.col("rep") == F.col("query")).select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    out = out.select("query_id", F.posexplode("near").alias("at", "n"))
    out = written(out.select("query_id", (F.col("at") + 1).alias("rank"), "n.vec_id", "n.score"), "nearest")
    discard(asked, candidates, queries, *each_curve)
    return out
