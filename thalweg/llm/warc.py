"""WARC archives with an index first: byte ranges of selected records are read back, nothing else.

Writing: each task writes archives of gzip members, one record each, and gives one index row per record
(archive, offset, length, URL, digest). Payloads that several records share are written once: the record
with the largest page id is the response, the others are revisits of it. An archive's name is its task
attempt's own, and only attempts that succeed give index rows, so a lost executor leaves at most an
archive that no index names.

Reading: selected index rows are dealt by archive and place, sorted by offset, and near ranges are
coalesced into one read each. Archives are opened by URI through pyarrow's file systems, so they can
be in any store it knows.

Defined results: a null html is an empty payload. Payloads below least_bytes are always responses. A
null page id counts as smaller than any other; rows that share page id and payload with the response are
responses too. A null URL has no target header.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.shared import discard, opened, shared_dir, written

#: Ranges this near are read together, up to so many bytes; records of an archive are dealt to tasks by this much of it.
GAP, RANGE, DEALT = 1 << 16, 4 << 20, 32 << 20

INDEX_TYPE = "archive string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long, payload_bytes long"
RECORD_TYPE = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_CONTROL = re.compile(r"[\x00-\x20\x7f%]")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """An uncompressed record; a revisit has the HTTP head alone."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {digest} {url}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What record() was given, from its bytes; the digest of a response is that of the payload as read."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    told = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    digest = told if revisit else hashlib.sha1(payload).hexdigest()
    size = int(fields["X-Payload-Length"])
    if digest != told or not (revisit or len(payload) == size):
        raise ValueError(f"the record of {fields.get('WARC-Target-URI')} is damaged")
    uri = fields.get("WARC-Target-URI")
    return {
        "page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None,
        "url": None if uri is None else re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), uri),
        "record_type": fields["WARC-Type"],
        "refers_to": int(fields["X-Refers-To-Page-ID"]) if revisit else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }


def write_archives(df: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 1000, archive_bytes: int = 256 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write every row's record under folder (by default in the shared folder) and return the index, a written table."""
    folder = (folder or f"{shared_dir(df.sparkSession)}/warc-{uuid.uuid4().hex}").rstrip("/")
    text = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    pages = df.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), text.alias("html"), F.sha1(text).alias("digest"), F.octet_length(text).alias("size"))
    shared = pages.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first"))
    shared = written(shared.where("n > 1 and first is not null").select("digest", "first"), "payloads")
    rows = pages.join(shared, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("size") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, path = opened(folder)
        store.create_dir(path, recursive=True)
        attempt, number, out, name, at = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", 0, None, "", 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                found = []
                for page, uri, page_html, digest, refers in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns), strict=True):
                    if out is None or at > archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"pages-{attempt}-{number}.warc.gz", 0
                        out, number = store.open_output_stream(f"{path}/{name}", compression=None), number + 1
                    payload = page_html.encode("utf-8", "surrogatepass")
                    gz = zlib.compressobj(4, zlib.DEFLATED, 31)
                    data = gz.compress(record(page, uri, payload, digest, refers, refers is not None, date)) + gz.flush()
                    out.write(data)
                    found.append((f"{folder}/{name}", at, len(data), uri, digest, page, "response" if refers is None else "revisit", refers, len(payload)))
                    at += len(data)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                names = ("archive", "offset", "length", "url", "digest", "page_id", "record_type", "refers_to", "payload_bytes")
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], list(names))
        if out is not None:
            out.close()

    index = written(rows.mapInArrow(write, INDEX_TYPE), "index")
    discard(shared)
    return index


def ranges(rows: Iterator[tuple[str, int, int]], gap: int = GAP, most: int = RANGE) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(archive, from, to, records) of coalesced ranges, from (archive, offset, length) sorted by archive and offset."""
    now: tuple[str, int, int, list[tuple[int, int]]] | None = None
    for archive, offset, length in rows:
        if now and archive == now[0] and offset - now[2] <= gap and offset + length - now[1] <= most:
            now[3].append((offset, length))
            now = (now[0], now[1], max(now[2], offset + length), now[3])
        else:
            if now:
                yield now
            now = (archive, offset, offset + length, [(offset, length)])
    if now:
        yield now


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that rows of an index select, read from the archives; payload is null for revisits, and if payloads is false."""
    n, total = index.agg(F.count_distinct("archive"), F.sum("length")).first()
    tasks = max(1, n, -(-(total or 0) // DEALT))  # by what there is to read, not by the index's own size
    rows = index.select("archive", "offset", "length").repartition(tasks, "archive", F.expr(f"offset div {DEALT}")).sortWithinPartitions("archive", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}
        held, file = None, None
        for archive, begin, end, records in ranges(wanted):
            if archive != held:
                if file is not None:
                    file.close()
                store, path = opened(archive)
                held, file = archive, store.open_input_file(path)
            data = file.read_at(end - begin, begin)
            found = [parse(zlib.decompress(data[o - begin : o - begin + n], 31)) for o, n in records]
            columns = [pa.array([f[c] if payloads or c != "payload" else None for f in found], t) for c, t in kinds.items()]
            yield pa.RecordBatch.from_arrays(columns, list(kinds))
        if file is not None:
            file.close()

    return rows.mapInArrow(read, RECORD_TYPE)
