"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations alone.

A document's size is its number of words. Sources share the words of all documents by weight; a source
gets no more than a fixed multiple of its own size, and what it can't take is shared again by weight. Every
document of a source then has the same wanted number of copies, target / size of the source: its whole
part is sure, its fraction is rounded so that the source's words stay near the target. Pairs of documents
hold their fractions against each other: words move at random from one to the other, in expectation none,
until one of the two is whole; the other goes on to the next pair. Blocks of documents do that in parallel
and each leaves one fraction, and these go through the same in a reduction tree, until a source has one
fraction left, which is drawn by its probability.

The draws are hashes of document ids, so reruns agree. No block grows with a source, so a hot one only
has more blocks.

Defined results: a null text has size 0; documents of size 0 take 0 words; a null source is a source of
its own, last in order; a source without words has target 0. Rows with one id and size are separate
documents. Columns other than id, source and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thalweg.llm.shared import WORD_PATTERN, discard, written

#: Documents that a block rounds one after the other, on average.
BLOCK = 48


def sizes(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size: the number of words of the text, and place: a struct of the columns to keep."""
    words = F.regexp_count(F.col(f"`{text}`"), F.lit(WORD_PATTERN))
    place = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]) if keep else F.lit(None).cast("int")
    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.coalesce(words, F.lit(0)).cast("long").alias("size"), place.alias("place"))


def _before(rows: DataFrame, order: Sequence[Column], sums: dict[str, Column], label: str) -> DataFrame:
    """A written table of rows with the sums over all rows before each in the given order: within ranges of rows, and then over ranges."""
    dealt = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label)
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])  # a row per range
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in sums])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = dealt.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(k) for k, c in sums.items()])
    out = here.join(F.broadcast(bases), "_part").select(*rows.columns, *[(F.col(k) + F.col(f"_{k}")).alias(k) for k in sums])
    out = written(out, label)
    discard(dealt)
    return out


def targets(sized: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Per source: source_size, n (its documents with words), and target.

    In order of name (null last) sources weigh as weights says, over and over. A source is at its cap if
    its share of what is left, after sources that reach their caps at a smaller share per weight, is above it.
    There may be many sources: no task puts all of them in order.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("n"))
    named = _before(per, [F.col("source").asc_nulls_last()], {"place": F.lit(1)}, "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    named = named.select("source", "source_size", "n", weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("most"))
    everything = named.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    ratio = F.col("most") / F.col("weight")
    shared = _before(named, [ratio, F.col("source").asc_nulls_last()], {"spent": F.col("most"), "spent_weight": F.col("weight")}, "shares")
    left, left_weight = F.lit(float(everything.size or 0)) - F.col("spent"), F.lit(float(everything.weight or 0)) - F.col("spent_weight")
    shared = shared.withColumn("left", left).withColumn("left_weight", left_weight)
    shared = shared.withColumn("capped", F.col("left") * F.col("weight") >= F.col("most") * F.col("left_weight"))
    # the rate at which those below their caps share, which is that of the first of them in the order above
    first = shared.where("not capped").agg(F.min(F.struct(ratio.alias("ratio"), (F.col("left") / F.col("left_weight")).alias("rate"))).alias("first")).first().first
    rate = F.lit(None if first is None else first.rate).cast("double")
    return shared.select("source", "source_size", "n", F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * rate).alias("target"))


_ITEM = "struct<doc_id: {0}, source: {1}, size: bigint, place: {2}, p: double>"

#: One pair: c is the fraction that is carried, x the next one, u a draw from [0, 1). Of size * p each, words
#: move from one to the other; up and down are the most that c can gain and lose before one of the two is whole.
_PAIR = """
aggregate(items, named_struct('c', CAST(NULL AS {item}), 'out', CAST(array() AS array<{out}>)),
  (a, x) -> CASE WHEN a.c IS NULL THEN named_struct('c', x, 'out', a.out) ELSE
    element_at(transform(array(named_struct(
        'up', least(a.c.size * (1 - a.c.p), x.size * x.p), 'down', least(a.c.size * a.c.p, x.size * (1 - x.p)),
        'u', pmod(xxhash64(x.doc_id, x.size, a.c.doc_id, {seed}), 9007199254740992) / 9007199254740992D)), d -> CASE
      WHEN d.u * (d.up + d.down) < d.down THEN
        CASE WHEN a.c.size * (1 - a.c.p) <= x.size * x.p
          THEN named_struct('c', {x_less}, 'out', array_append(a.out, {c_one}))
          ELSE named_struct('c', {c_more}, 'out', array_append(a.out, {x_zero})) END
      ELSE
        CASE WHEN a.c.size * a.c.p <= x.size * (1 - x.p)
          THEN named_struct('c', {x_more}, 'out', array_append(a.out, {c_zero}))
          ELSE named_struct('c', {c_less}, 'out', array_append(a.out, {x_one})) END
    END), 1) END)
"""


def _pairs(doc_id: str, source: str, place: str, seed: int) -> Column:
    item, out = _ITEM.format(doc_id, source, place), f"struct<doc_id: {doc_id}, source: {source}, size: bigint, place: {place}, more: int>"
    own = lambda who: f"'doc_id', {who}.doc_id, 'source', {who}.source, 'size', {who}.size, 'place', {who}.place"
    carried = lambda who, p: f"named_struct({own(who)}, 'p', greatest(0D, least(1D, {p})))"
    whole = lambda who, n: f"named_struct({own(who)}, 'more', {n})"
    return F.expr(
        _PAIR.format(
            item=item, out=out, seed=f"{seed}L",
            x_less=carried("x", "x.p - a.c.size * (1 - a.c.p) / x.size"), c_one=whole("a.c", 1),
            c_more=carried("a.c", "a.c.p + x.size * x.p / a.c.size"), x_zero=whole("x", 0),
            x_more=carried("x", "x.p + a.c.size * a.c.p / x.size"), c_zero=whole("a.c", 0),
            c_less=carried("a.c", "a.c.p - x.size * (1 - x.p) / a.c.size"), x_one=whole("x", 1),
        )
    )


def _level(items: DataFrame, block: Column, types: tuple[str, str, str], seed: int, label: str) -> DataFrame:
    """A written table of one level of the tree: per block what became whole, and the fraction it leaves."""
    grouped = items.groupBy("source", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "source", "size", "place", "p"))).alias("items"))
    return written(grouped.select(_pairs(*types, seed).alias("r")).select("r.c", "r.out"), label)


def mix(df: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 11, block: int = BLOCK, keep: Sequence[str] = ()) -> DataFrame:
    """Every document with size, source_size, target (its source's), copies and taken: the words that the mix takes from it.

    Columns of df named in keep (not doc_id, source or text) come along; reruns agree on the rest whatever they hold, but where
    rows share id and size they decide which of them is taken.
    """
    sized = written(sizes(df, doc_id, source, text, keep), "sizes")
    per = written(targets(sized, weights, cap).withColumn("times", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))), "targets")
    types = tuple(sized.schema[c].dataType.simpleString() for c in ("doc_id", "source", "place"))
    shares = per.select(F.col("source").alias("_source"), "n", F.floor("times").alias("whole"), (F.col("times") - F.floor("times")).alias("p"))
    same = F.col("source").eqNullSafe(F.col("_source"))
    items = sized.where("size > 0").join(shares, same).select("doc_id", "source", "size", "place", "p", "n")

    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block))
    levels = [_level(items, F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), blocks), types, seed, "mix0")]
    fractions = -(-(per.agg(F.max("n")).first()[0] or 0) // block)
    while fractions > 1:  # of the source with most; each level leaves one per block
        left = levels[-1].select("c.*")
        counts = left.groupBy("source").agg(F.count("*").alias("n")).select(F.col("source").alias("_source"), "n")
        rest = left.join(counts, same).select("doc_id", "source", "size", "place", "p", F.greatest(F.lit(1), F.ceil(F.col("n") / block)).alias("blocks"))
        k = len(levels)
        levels.append(_level(rest, F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + k)), F.col("blocks")), types, seed + k, f"mix{k}"))
        fractions = -(-fractions // block)
    final = levels[-1].select("c.*")
    draw = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed - 1)), F.lit(1 << 53)) / float(1 << 53)
    rounded = final.select("doc_id", "source", "size", "place", (draw < F.col("p")).cast("int").alias("more"))
    for level in levels:
        rounded = rounded.unionByName(level.select(F.explode("out").alias("o")).select("o.*"))
    rounded = rounded.unionByName(sized.where("size = 0").withColumn("more", F.lit(0)))
    out = rounded.join(per.select(F.col("source").alias("_source"), "source_size", "target", F.floor("times").alias("whole")), same)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(F.lit(0)).cast("long")
    kept = [F.col(f"place.k{i}").alias(c) for i, c in enumerate(keep)]
    out = written(out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *kept), "mix")
    discard(sized, per, *levels)
    return out
