"""The corpus pipeline: five stages over documents, each written and read again by whoever runs them.

Language ID drops documents without a language; quality rules drop documents and the lines that fail;
of near duplicates the document with the smallest id stays; mixing drops or repeats documents so that
sources come near their targets; packing cuts what is left into sequences of 2048 tokens. The stages but
the last return the columns of documents.

Rows with a null id are never near duplicates to be dropped. Mixing decides on rows, so rows that share an
id (or have none) are as many documents. Other columns than those of documents come along, whatever their names.
Between stages no text is shuffled but in mixing, where a document meets its number of copies.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm import language_id
from thalweg.llm.mixing import mix
from thalweg.llm.near_dedup import classes
from thalweg.llm.packing import pack
from thalweg.llm.quality import quality
from thalweg.llm.shared import addressed, discard, look_up, marks, written


def _plain(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1, ... , so that no operator's own column can clash with one."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def _column(docs: DataFrame, name: str) -> str:
    """The name in _plain of a column of documents."""
    return f"c{docs.columns.index(name)}"


def _as(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The columns of _plain among those of rows, named as in docs."""
    return rows.select(*[F.col(f"c{k}") for k in range(len(docs.columns))]).toDF(*docs.columns)


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; profiles are learned as in op6_language_id."""
    doc_id, text, lang = (_column(docs, c) for c in ("doc_id", "text", "lang"))
    rows = addressed(_plain(docs))
    learned = rows.where(F.crc32(F.col(doc_id).cast("string")) % 4 != 2)
    profiles = language_id.fit(learned, text, lang, by=F.col(doc_id))
    known = language_id.predict(rows.select("_file", "_row", text), profiles, text).where(F.col("lang_pred") != language_id.UNDETERMINED)
    kept = marks(known.withColumn("value", F.lit(1).cast("long")), "languages")
    return _as(docs, rows.where(look_up(kept)(F.col("_file"), F.col("_row")) > 0))


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    text, n_chars = _column(docs, "text"), _column(docs, "n_chars")
    kept = quality(_plain(docs), text).where("kept").withColumn(text, F.col("cleaned_text"))
    kept = kept.withColumn(n_chars, F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return _as(docs, written(kept.drop("cleaned_text"), "cleaned", compression="zstd"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one with the smallest id; of rows with one id the first where they are stored."""
    rows = addressed(_plain(docs))
    found = classes(rows.select("_file", "_row", _column(docs, "doc_id"), _column(docs, "text")), _column(docs, "doc_id"), _column(docs, "text"))
    per = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min(F.struct("_file", "_row")).alias("first"))
    kept = per.where("class_id = doc_id").select("first.*").unionByName(found.where("doc_id is null").select("_file", "_row"))
    kept = marks(kept.withColumn("value", F.lit(1).cast("long")), "distinct")
    discard(found)
    return _as(docs, rows.where(look_up(kept)(F.col("_file"), F.col("_row")) > 0))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    rows = addressed(_plain(docs))
    copies = mix(rows, doc_id=_column(docs, "doc_id"), source=_column(docs, "source"), text=_column(docs, "text"), keep=("_file", "_row"))
    copies = written(copies.where("copies > 0").select("_file", "_row", F.col("copies").cast("int").alias("copies")), "copies")
    copies = copies.hint("merge")  # never broadcast: there is a row for every document
    return _as(docs, rows.join(copies, ["_file", "_row"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, as op7_packing returns them."""
    pieces = pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", by_language),
    ("quality_rules", by_quality),
    ("near_dedup", without_near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: Language ID, near duplicates, mixing and packing have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
