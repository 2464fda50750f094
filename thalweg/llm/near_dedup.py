"""Near duplicates by DartMinHash over word shingles.

A text is the set of its five-word shingles (with weights: one each, or their counts). Every unit of a
shingle's weight is a strip over which darts fall by its hash: a Poisson process of ranks, each dart with a
coordinate. A signature keeps the dart of least rank in each coordinate; a document of total weight W
only needs the darts up to a rank of about (k ln k + 2k) / W, so the work is one look at each shingle and
some k ln k darts, and it looks further only while a coordinate is empty. Two documents agree in a
coordinate with the probability of their (weighted) Jaccard similarity.

1. Texts with the same words are one (their smallest id stands for them).
2. Bands of coordinates make buckets. Sorted by bucket in ranges that may cut one, each run of a bucket's members
   is held against one of them, the hub, which is another one in each bucket, by signature and then exactly
   (the texts that this takes are read where they are); what is similar is linked.
3. Components of the links are found. A bucket whose members are in several components is looked at again:
   its members outside its largest component, against all of its members in others, in blocks of bounded
   size. So every two members of a bucket are either in one class already or are compared.

Copies are never expanded into pairs, no step holds a bucket or a group of copies in one task, and no text is shuffled.
Tables in between are removed as soon as the next one stands.

Defined results: a text without words is alone in its class, whatever others are like it; a text of one to
four words equals only texts of the same words. Rows with the same id are one document. A null id has
the class of its text's copies, null if none has an id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.shared import Spans, addressed, discard, marked, marks, mix64, path_of, text_blocks, window_hashes, word_spans, written

#: Members of a bucket that one task compares at once.
BLOCK = 512
#: Pairs whose signatures agree in less than this share, relative to the threshold, aren't checked exactly: over six standard errors.
LEEWAY = 0.69
#: Parts that rows of one key (an open bucket, a class, a hub) are dealt in to meet what is known of the key.
SALTS = 16
#: Texts whose copies are looked up in a broadcast, at most: those with more copies than this share of all rows.
MOST_COMMON = 10_000

_STEP, _SLAB, _PLACE, _NAME = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each distinct shingle of a block's rows (by row, then hash); words and their rows."""
    starts, ends, rows = word_spans(data, offsets)
    words = Spans(data).hashes(starts, ends)
    hashes, at = window_hashes(words, rows, size)
    own = rows[at]
    order = np.lexsort((hashes, own))
    own, hashes = own[order], hashes[order]
    new = np.append(True, (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])) if len(own) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return own[first], hashes[first], np.diff(np.append(first, len(own))), words, rows


def darts(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n rows, k coordinates) of weighted elements; a row without elements is all 0."""
    out = np.zeros((n, k), np.uint16)
    units = np.ceil(weights).astype(np.int64)
    element = np.repeat(np.arange(len(rows)), units)
    slab = (np.arange(len(element)) - np.repeat(np.cumsum(units) - units, units)).astype(np.uint64)
    room = np.minimum(1.0, weights[element] - slab)  # of this unit
    with np.errstate(over="ignore"):
        seed = mix64(hashes[element] + slab * _SLAB)
    row = rows[element]
    total = np.bincount(rows, weights=weights, minlength=n)
    reach = np.divide(k * np.log(k) + 2 * k, total, out=np.zeros(n), where=total > 0)
    todo = total > 0
    while todo.any():
        on = np.flatnonzero(todo[row])
        rank, number = np.zeros(len(on)), np.uint64(0)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(on):
            with np.errstate(over="ignore"):
                dart = mix64(seed[on] + (number + np.uint64(1)) * _STEP)
                rank = rank - np.log(((dart >> np.uint64(11)).astype(float) + 0.5) / (1 << 53))
                hit = rank <= reach[row[on]]
                on, rank, dart = on[hit], rank[hit], dart[hit]
                inside = ((mix64(dart ^ _SLAB) >> np.uint64(11)).astype(float) / (1 << 53)) < room[on]
                place = mix64(dart ^ _PLACE) % np.uint64(k)
            found.append((row[on][inside] * k + place[inside].astype(np.int64), rank[inside], (mix64(dart[inside] ^ _NAME) >> np.uint64(48)).astype(np.uint16)))
            number += np.uint64(1)
        cell, ranks, name = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ranks, cell))
        cell, name = cell[order], name[order]
        first = np.append(True, cell[1:] != cell[:-1]) if len(cell) else np.zeros(0, bool)
        out.ravel()[cell[first]] = name[first]
        full = np.bincount(cell[first] // k, minlength=n) == k
        todo &= ~full
        reach[todo] *= 2
    return out


def text_hashes(words: np.ndarray, word_rows: np.ndarray, n: int) -> list[np.ndarray]:
    """Two 64-bit hashes of each of n texts, from its words' hashes in order."""
    number = np.bincount(word_rows, minlength=n)
    place = np.arange(len(words)) - (np.cumsum(number) - number)[word_rows]
    sums = []
    with np.errstate(over="ignore"):
        for salt in (np.uint64(1), np.uint64(2)):
            of = mix64(words + mix64(place.astype(np.uint64) + salt * _SLAB))
            total = np.zeros(n, np.uint64)
            np.add.at(total, word_rows, of)
            sums.append(mix64(total + number.astype(np.uint64)).view(np.int64))
    return sums


def _signed(docs: DataFrame, size: int, k: int, weighting: str) -> DataFrame:
    """doc_id, its address, h1 and h2 (of the words in order; null without words) and signature.

    The signature is null with fewer words than a shingle, without an id, and where an earlier row of the same task has the same words.
    """

    def sign(batches):
        seen: set[int] = set()  # of one task's rows
        for batch in batches:
            for at, n, data, offsets in text_blocks(batch.column(1)):
                row, hashes, counts, words, word_rows = shingles(data, offsets, size)
                h1, h2 = text_hashes(words, word_rows, n)
                none, short = np.bincount(word_rows, minlength=n) == 0, np.bincount(row, minlength=n) == 0
                ids = batch.column(0).slice(at, n)
                for i in np.flatnonzero(~short & ids.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    key = int(h1[i])
                    short[i] = key in seen
                    seen.add(key)
                short |= ~ids.is_valid().to_numpy(zero_copy_only=False)
                own = ~short[row]
                signatures = darts(row[own], hashes[own], counts[own].astype(float) if weighting == "count" else np.ones(int(own.sum())), n, k)
                columns = [
                    ids, batch.column(2).slice(at, n), batch.column(3).slice(at, n), pa.array(h1, mask=none), pa.array(h2, mask=none),
                    pa.array([None if s else x.tobytes() for s, x in zip(short.tolist(), signatures, strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_file", "_row", "h1", "h2", "signature"])

    return docs.select("doc_id", "text", "_file", "_row").mapInArrow(sign, "doc_id long, _file long, _row long, h1 long, h2 long, signature binary")


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of the nodes of edges (a, b); a written table.

    Every round takes the least label beside each node, then the label's own label, until nothing changes.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"), F.lit(None).cast("long").alias("was")), "labels")
    spread = written(both.withColumn("salt", _salt("a")), "edges")  # hubs and large classes have many rows beside them
    discard(both)
    while True:
        beside = spread.join(_salted(labels.select(F.col("node").alias("b"), "label")), ["b", "salt"]).groupBy("a").agg(F.min("label").alias("m"))
        near = labels.join(beside, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        near = written(near.withColumn("salt", _salt("node")), "near")
        following = near.groupBy("label").agg(F.count("*").alias("n")).join(near.select(F.col("node").alias("label"), F.col("label").alias("next")), "label")
        new = written(near.join(_salted(following.select("label", "next")), ["label", "salt"]).select("node", F.col("next").alias("label"), "was"), "labels")
        discard(near, labels)
        labels = new
        if not labels.where("label <> was").limit(1).count():
            discard(spread)
            return labels


def _salt(column: str):
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def _salted(rows: DataFrame) -> DataFrame:
    """rows once for every salt, to meet rows of one key that are dealt by salt."""
    return rows.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))


def _agreement():
    @F.arrow_udf("double")
    def agree(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint16).reshape(len(s), -1) for s in (a, b))
        return pa.array((x == y).mean(axis=1) if len(a) else np.zeros(0))

    return agree


def similarity(a: bytes, b: bytes, weighted: bool = False) -> float:
    """(Weighted) Jaccard similarity of two sets as _sets_of packs them."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not weighted:
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return shared / (len(x) + len(y) - shared)
    (hx, wx), (hy, wy) = x.reshape(2, -1), y.reshape(2, -1)
    _, i, j = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
    shared = int(np.minimum(wx[i], wy[j]).sum(dtype=np.int64))
    return shared / (int(wx.sum(dtype=np.int64)) + int(wy.sum(dtype=np.int64)) - shared)


def _sets_of(reps: DataFrame, docs: DataFrame, size: int, weighting: str) -> DataFrame:
    """rep and set of the texts whose addresses are in reps (one per rep); a written table. The texts are read where they are.

    rep is the text's hash; a set has the 32-bit hashes of the shingles, and with weighting "count" their counts after them.
    """
    wanted = marks(reps.select("_file", "_row", F.lit(1).cast("long").alias("value")), "wanted")
    path = path_of(wanted)

    def gather(batches):
        for batch in batches:
            texts = batch.column(0).filter(pa.array(marked(path, batch.column(1), batch.column(2)) > 0))
            for _, n, data, offsets in text_blocks(texts):
                row, hashes, counts, words, word_rows = shingles(data, offsets, size)
                cuts = np.searchsorted(row, np.arange(n + 1))
                sets = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    short, first = np.unique((hashes[a:b] >> np.uint64(32)).astype(np.uint32), return_index=True)
                    sets.append((np.concatenate((short, counts[a:b][first].astype(np.uint32))) if weighting == "count" else short).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(text_hashes(words, word_rows, n)[0]), pa.array(sets, pa.binary())], ["rep", "set"])

    found = written(docs.select("text", "_file", "_row").mapInArrow(gather, "rep long, set binary"), "sets", compression="zstd")
    discard(wanted)
    return found


def _runs(batches):
    """Of rows (bucket, draw, band, rep) in order: (bucket, band, rep, hub, edge), where the hub is the run's first.

    Runs of one row are left out. The first row of a task's first run and of its last has edge, the run's length here, as
    the run may go on in another task; all other rows have edge 0.
    """
    kinds = {"bucket": pa.int64(), "band": pa.int32(), "rep": pa.int64(), "hub": pa.int64(), "edge": pa.int64()}
    bucket = head = band = None
    length, first = 0, True
    last: list[np.ndarray] = []

    def batch(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    for some in batches:
        b, _, n, r = (c.to_numpy(zero_copy_only=False) for c in some.columns)
        if not len(b):
            continue
        new = np.append(bucket is None or b[0] != bucket, b[1:] != b[:-1])
        starts = np.flatnonzero(new)
        if len(starts) and bucket is not None:  # the run that was held ends at the first of them
            length += int(starts[0])
            if first or length > 1:
                yield batch([bucket], [band], [head], [head], [length if first else 0])
            first = False
        elif not len(starts):
            length += len(b)
        begin = np.concatenate((np.full(int(starts[0]) if len(starts) else len(b), -1), np.repeat(starts, np.diff(np.append(starts, len(b))))))
        hub = np.where(begin < 0, 0 if head is None else head, r[np.maximum(begin, 0)])
        size = np.zeros(len(b), np.int64)
        if len(starts):
            size[starts] = np.diff(np.append(starts, len(b)))
            size[starts[-1]] = 0  # goes on
        keep = ~new | (size > 1)
        edge = np.zeros(len(b), np.int64)
        if len(starts) and first:
            if len(starts) > 1:  # the task's first run ends in this batch
                keep[starts[0]], edge[starts[0]] = True, size[starts[0]]
                first = False
        yield batch(b[keep], n[keep], r[keep], hub[keep], edge[keep])
        if len(starts):
            at = int(starts[-1])
            bucket, band, head, length = int(b[at]), int(n[at]), int(r[at]), len(b) - at
    if bucket is not None:
        yield batch([bucket], [band], [head], [head], [length])


def _met(members: DataFrame) -> DataFrame:
    """bucket, band, rep and hub of the members (bucket, band, rep) of buckets of several; a written table.

    Members are dealt by ranges of (bucket, a draw), so a bucket of any size is spread over as many tasks as its rows need, and
    each task's own runs are joined by their heads: at most two per task.
    """
    dealt = members.select("bucket", F.xxhash64("rep", "bucket").alias("draw"), "band", "rep").repartitionByRange("bucket", "draw").sortWithinPartitions("bucket", "draw")
    runs = written(dealt.mapInArrow(_runs, "bucket long, band int, rep long, hub long, edge long"), "runs")
    heads = runs.where("edge > 0").groupBy("bucket").agg(F.count("*").alias("parts"), F.min("hub").alias("least"))
    ends = runs.where("edge > 0").join(heads, "bucket").where("parts > 1 or edge > 1").select("bucket", "band", "rep", F.col("least").alias("hub"))
    found = written(runs.where("edge = 0").select("bucket", "band", "rep", "hub").unionByName(ends), "buckets")
    discard(runs)
    return found


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 4, weighting: str = "set") -> DataFrame:
    """doc_id, class_id and the address (_file, _row) of every row; a written table. See near_duplicates."""
    k = bands * rows
    docs = addressed(df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    signed = written(_signed(docs, size, k, weighting), "signed")
    signatures = written(signed.where("signature is not null").select(F.col("h1").alias("rep"), "_file", "_row", "signature").dropDuplicates(["rep"]), "signatures")
    places = signatures.select("rep", "_file", "_row")  # a text's key is its hash, as an id may have several texts

    def band(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                x = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint16).reshape(len(some), bands, rows).astype(np.uint64)
                with np.errstate(over="ignore"):
                    key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(some), axis=0)
                    for i in range(rows):
                        key = mix64(key * _STEP + x[:, :, i])
                number = np.tile(np.arange(bands, dtype=np.int32), len(some))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some.column(0).to_numpy(), bands)), pa.array(number), pa.array(key.ravel().view(np.int64))], ["rep", "band", "bucket"])

    shared = _met(signatures.select("rep", "signature").mapInArrow(band, "rep long, band int, bucket long"))

    least = threshold * LEEWAY
    pairs = shared.where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    side = lambda c: signatures.select(F.col("rep").alias(c), F.col("signature").alias(f"signature_{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    near = near.withColumn("agree", _agreement()("signature_a", "signature_b")).where(F.col("agree") >= least).select("a", "b")
    near = written(near, "pairs")
    links = _checked(near, places, docs, size, threshold, weighting)
    discard(near)
    labels = components(links)

    # Members of one bucket that are in different classes so far.
    labelled = shared.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("bucket", "band", "rep", "hub", F.coalesce("label", "rep").alias("label"))
    labelled = written(labelled, "labelled")
    discard(shared)
    per = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    largest = per.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n")).where("top.n < n and n > 2")
    open_buckets = _salted(largest.select("bucket", "n", F.col("top.label").alias("top")))
    opened = labelled.where("rep <> hub").withColumn("salt", _salt("rep")).join(open_buckets, ["bucket", "salt"])
    opened = opened.select("bucket", "band", "rep", "label", (F.col("label") != F.col("top")).alias("odd"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    opened = written(opened, "open")
    discard(labelled)
    known = _sets_of(opened.select("rep").distinct().join(places, "rep"), docs, size, weighting)
    compared = opened.join(signatures.select("rep", "signature"), "rep").join(known, "rep")
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    odd = compared.where("odd").select(F.col("bucket").alias("b1"), mine.alias("i1"), every.alias("j1"), *[F.col(c).alias(f"{c}1") for c in ("band", "rep", "label", "signature", "set")])
    rest = compared.select(F.col("bucket").alias("b2"), every.alias("i2"), mine.alias("j2"), *[F.col(c).alias(f"{c}2") for c in ("rep", "label", "odd", "signature", "set")])
    weighted = weighting == "count"

    def compare(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Links between the two sides that join labels not yet joined here; a pair is looked at in its first common band alone."""
        found: list[tuple[int, int]] = []
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        if len(left) and len(right):
            x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), -1) for s in (left["signature1"], right["signature2"]))
            rep1, rep2, label1, label2, odd2 = (c.to_numpy() for c in (left["rep1"], right["rep2"], left["label1"], right["label2"], right["odd2"]))
            set1, set2, number = left["set1"].to_list(), right["set2"].to_list(), int(left["band1"].iloc[0])
            for at in range(len(x)):
                same = y == x[at]
                share = same.mean(axis=1)
                hit = np.flatnonzero((label2 != label1[at]) & (share >= least) & ~(odd2 & (rep2 < rep1[at])))
                hit = hit[same[hit].reshape(len(hit), bands, rows).all(axis=2).argmax(axis=1) == number]
                for other in hit[np.argsort(-share[hit], kind="stable")].tolist():
                    p, q = top(int(label1[at])), top(int(label2[other]))
                    if p != q and similarity(set1[at], set2[other], weighted) >= threshold:
                        root[max(p, q)] = min(p, q)
                        found.append((int(rep1[at]), int(rep2[other])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    late = written(odd.groupBy("b1", "i1", "j1").cogroup(rest.groupBy("b2", "i2", "j2")).applyInPandas(compare, "a long, b long"), "late")
    discard(opened, known, signatures)
    if late.limit(1).count():
        discard(labels)
        labels = components(links.unionByName(late))

    # Every text's class; texts with very many copies are few, so that their classes can be broadcast, and no task has all copies of one.
    texts = signed.where("h1 is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    named = written(texts.join(labels.select("node", "label"), F.col("h1") == F.col("node"), "left").select("h1", "h2", "doc_id", "copies", "label"), "named")
    least_ids = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least_id"))
    common = max(1000, signed.count() // MOST_COMMON)  # so at most MOST_COMMON texts have more copies
    classed = named.where("label is not null").withColumn("salt", _salt("h1")).join(_salted(least_ids), ["label", "salt"])
    found = classed.select("h1", "h2", F.col("least_id").alias("class_id"), "copies").unionByName(named.where("label is null").select("h1", "h2", F.col("doc_id").alias("class_id"), "copies"))
    found = written(found.select("h1", "h2", "class_id", (F.col("copies") > common).alias("common")), "named")
    keys, own = ["h1", "h2"], signed.select("doc_id", "_file", "_row", "h1", "h2")
    frequent = F.broadcast(found.where("common").drop("common"))
    out = own.join(frequent, keys, "left_anti").join(found.where("not common").drop("common"), keys, "left")
    out = out.unionByName(own.join(frequent, keys))
    out = written(out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "_file", "_row"), "classes")
    discard(signed, named, found, labels, links, late)
    return out


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 4, weighting: str = "set") -> DataFrame:
    """doc_id and class_id of every row: the smallest id of its class, itself if nothing is like it.

    Two texts whose (weighted, with weighting "count") shingle similarity is at least threshold meet in a
    bucket with probability 1 - (1 - threshold ** rows) ** bands, and are then in one class.
    """
    return classes(df, doc_id, text, size, threshold, bands, rows, weighting).select("doc_id", "class_id")


def _checked(pairs: DataFrame, places: DataFrame, docs: DataFrame, size: int, threshold: float, weighting: str) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are as similar as threshold; a written table."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(places, "rep"), docs, size, weighting)
    side = lambda c: sets.select(F.col("rep").alias(c), F.col("set").alias(f"set_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    found = written(both.withColumn("s", _similarity(weighting == "count")("set_a", "set_b")).where(F.col("s") >= threshold).select("a", "b"), "links")
    discard(sets)
    return found


def _similarity(weighted: bool):
    @F.arrow_udf("double")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([similarity(x, y, weighted) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return similar
