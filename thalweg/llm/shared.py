"""What several operators share: written tables, addresses of rows, text blocks, word hashes."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; a longer single text is a block of its own.
BLOCK_BYTES = 1 << 18

#: Rows of a batch that goes to a Python worker, at most.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The six characters that end a word (fixed values): space, tab, \n, \v, \f, \r.
WORD_END = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same as a Java regular expression for words.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_ENDS = np.zeros(256, bool)
_ENDS[list(WORD_END)] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, or one beside its tables (in the warehouse) only where that is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/thalweg-work"


@contextmanager
def bounded(spark: SparkSession) -> Iterator[None]:
    """While a job runs: at most BATCH_ROWS rows at once go to Python workers, as texts may be long, and its shuffle files go when it ends."""
    before = {k: spark.conf.get(k) for k in (_BATCH, _CLEAN)}
    if not 0 < int(before[_BATCH]) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, label: str, by: tuple[str, ...] = (), **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here and a lost executor costs no earlier stage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    with bounded(spark):
        df.write.partitionBy(*by).options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for table in tables:
        path = _paths.pop(table, None)
        if path:
            place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system and path of a place in the shared folder."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def addressed(df: DataFrame, file: str = "_file", row: str = "_row") -> DataFrame:
    """df with two more columns, the address of each row: its file's hash and its place there. A df that is no scan of Parquet files is written first."""
    for table in (df, None):
        table = written(df, "rows", compression="zstd") if table is None else table
        try:
            place = table.metadataColumn("_metadata")
            return table.select("*", F.xxhash64(place["file_path"]).alias(file), place["row_index"].alias(row))
        except AnalysisException:
            if table is not df:
                raise
    raise AssertionError


#: Rows of a file whose marks a task holds at once.
MARKED = 1 << 20


def marks(rows: DataFrame, label: str) -> DataFrame:
    """A written table of (_file, _row, value: a long), laid out by file and runs of MARKED rows for look_up."""
    rows = rows.select("_row", "value", F.col("_file").alias("f"), F.expr(f"_row div {MARKED}").alias("part"))
    return written(rows.repartition("f", "part").sortWithinPartitions("f", "part", "_row"), label, ("f", "part"))


@lru_cache(maxsize=2)
def _marked(path: str, file: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    store, place = opened(f"{path}/f={file}/part={part}")
    if store.get_file_info(place).type == fs.FileType.NotFound:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = [x for x in store.get_file_info(fs.FileSelector(place)) if x.base_name.endswith(".parquet")]
    table = pa.concat_tables([pq.read_table(store.open_input_file(x.path), columns=["_row", "value"]) for x in found])
    rows, values = table.column("_row").to_numpy(), table.column("value").to_numpy()
    order = np.argsort(rows, kind="stable")
    return rows[order], values[order]


def marked(path: str, file: pa.Array, row: pa.Array) -> np.ndarray:
    """Values of rows' addresses in the table of marks at path, 0 where there is none; for use inside a task."""
    f, r = file.to_numpy(zero_copy_only=False), row.to_numpy(zero_copy_only=False)
    part, out = r // MARKED, np.zeros(len(r), np.int64)
    for own_file, own_part in sorted(set(zip(f.tolist(), part.tolist(), strict=True))):
        rows, values = _marked(path, own_file, own_part)
        mine = np.flatnonzero((f == own_file) & (part == own_part))
        at = np.searchsorted(rows, r[mine])
        hit = np.append(rows, -1)[at] == r[mine]
        out[mine[hit]] = values[at[hit]]
    return out


def path_of(table: DataFrame) -> str:
    """Where a written table is."""
    return _paths[table]


def look_up(table: DataFrame) -> Callable[[Column, Column], Column]:
    """A column function of a row's address: its value in a table of marks, 0 if it has none.

    A task reads only the marks of the files and runs of rows that it scans, so neither texts nor marks are shuffled to meet.
    """
    path = path_of(table)

    @F.arrow_udf("bigint")
    def find(file: pa.Array, row: pa.Array) -> pa.Array:
        return pa.array(marked(path, file, row))

    return find


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) for runs of rows with at most limit bytes, or a single longer row. Nulls count as empty."""
    flat = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8) if len(flat) else np.zeros(0, np.uint8)
    row = 0
    while row < len(flat):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end - row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit integer over all others."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64, at least n of each."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _BASE, np.uint64))), dtype=np.uint64)
            down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, inverse, np.uint64))), dtype=np.uint64)
        if n > BLOCK_BYTES + 1:
            return up, down  # a very long text's powers aren't kept
        _powers.update(up=up, down=down)
    return _powers["up"], _powers["down"]


class Spans:
    """64-bit hashes of any spans of one block's bytes; equal bytes give equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray) -> None:
        self.up, self.down = _power(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word of a block; a word never crosses rows."""
    inside = ~_ENDS[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def window_hashes(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of size words within a row, and the index of its first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[:n] == rows[size - 1 :])
    with np.errstate(over="ignore"):
        total = np.zeros(len(at), np.uint64)
        for k in range(size):
            total = (total * _BASE) + words[at + k]
    return mix64(total), at
