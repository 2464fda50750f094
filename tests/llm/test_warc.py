import gzip
import hashlib
from collections import Counter

from pyspark.sql import functions as F

from thalweg.llm.warc import parse, ranges, read_records, record, write_archives


def brute(rows):
    data = [(p, u, (h or "").encode()) for p, u, h in rows]
    best = {}
    for p, _, h in data:
        if len(h) >= 1000 and p is not None:
            best[h] = max(best.get(h, p), p)
    out = []
    for p, _, h in data:
        revisit = len(h) >= 1000 and best.get(h) is not None and p != best[h]
        out.append((p, len(h), hashlib.sha1(h).hexdigest(), "revisit" if revisit else "response", best[h] if revisit else None))
    return Counter(out)


ROWS = [(1, "http://a/", "x" * 1000), (2, "http://b/\r\nX: y %41", "x" * 1000), (9, None, "x" * 1000), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "ü", None), (6, "", ""), (7, "u", "é" * 500), (8, "u", "é" * 500), (None, "n", "x" * 1000), (None, "n", "q"), (9, None, "x" * 1000), (10, "l", "\r\n\r\nlong " * 100_000)]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "c") for r in ROWS], "page_id long, url string, html string, digest string").repartition(3)
    index = write_archives(df, archive_bytes=500)
    got = read_records(index).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(ROWS)
    assert Counter(r.url for r in got) == Counter(u for _, u, _ in ROWS)
    whole = {(p, (h or "").encode()) for p, _, h in ROWS}
    assert all((r.page_id, bytes(r.payload)) in whole for r in got if r.record_type == "response")
    one = read_records(index.where("page_id = 8")).collect()
    assert len(one) == 1 and bytes(one[0].payload) == ("é" * 500).encode()
    for r in index.collect():  # an archive is a plain gzip file, and an index row a member of it
        with open(r.archive.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            assert parse(gzip.decompress(f.read(r.length)))["page_id"] == r.page_id
    assert read_records(write_archives(df.limit(0))).count() == 0


def test_real_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    df = df.unionByName(df.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 1000))
    got = read_records(write_archives(df), payloads=False).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute([(r.page_id, r.url, r.html) for r in df.collect()])


def test_ranges():
    rows = [("a", 0, 5), ("a", 5, 5), ("a", 20, 5), ("a", 100, 5), ("b", 0, 3)]
    assert list(ranges(iter(rows), gap=10, most=50)) == [("a", 0, 25, [(0, 5), (5, 5), (20, 5)]), ("a", 100, 105, [(100, 5)]), ("b", 0, 3, [(0, 3)])]
    assert [r[1:3] for r in ranges(iter(rows), gap=10, most=10)] == [(0, 10), (20, 25), (100, 105), (0, 3)]


def test_record_is_parsed():
    data = record(4, "http://x/?q=%20", b"ab", hashlib.sha1(b"ab").hexdigest(), None, False, "2020-01-01T00:00:00Z")
    assert data.endswith(b"ab\r\n\r\n") and parse(data)["url"] == "http://x/?q=%20"
