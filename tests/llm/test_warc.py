"""WARC chunk table: exact round trips, also over many chunks."""

import base64
import hashlib
import uuid

import pytest

from trawlspark.llm import warc
from trawlspark.session import work_folder


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


ROWS = [
    (1, "http://a/", "same"),
    (2, "http://b/\r\nX: y", "same"),
    (9, None, "same"),
    (None, "http://n/", "same"),
    (3, "http://c/", ""),
    (4, "http://d/", None),
    (5, "http://e/", "ä" * 5000),
    (6, "http://e/", "WARC/1.1\r\n\r\n\r\n\r\n" * 300),
    (7, "http://e/", "x" * 7000),
    (7, "http://e/", "y" * 7000),
    (8, "http://e/", "z" * 7000),
    (8, "http://e/", "z" * 7000),
]
SCHEMA = "page_id bigint, url string, html string"


@pytest.mark.parametrize("chunk", [64, 1000, warc.CHUNK])
def test_round_trip(spark, chunk):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    got = warc.round_trip(pages, work_folder(spark, "warc-test"), chunk=chunk).collect()
    best = {}
    for page, _, html in ROWS:
        if page is not None:
            best[html or ""] = max(best.get(html or "", page), page)
    want = []
    for page, _, html in ROWS:
        html = html or ""
        first = page == best[html]
        want.append((page, len(html.encode()), digest(html), "response" if first else "revisit", None if first else best[html]))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_least_size_and_archive_bytes(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "long enough"), (4, "u", "long enough")], SCHEMA)
    path = work_folder(spark, f"warc-{uuid.uuid4().hex}")
    got = {r["page_id"]: r for r in warc.round_trip(pages, path, least=5, chunk=4).collect()}
    assert [got[i]["record_type"] for i in (1, 2, 3, 4)] == ["response", "response", "revisit", "response"]
    chunks = spark.read.parquet(path).orderBy("record", "chunk_no").collect()
    data = b"".join(bytes(c["body"]) for c in chunks)
    assert data.count(b"WARC/1.1\r\n") == 4
    assert all(len(c["body"]) < 1000 for c in chunks)


def test_damage_is_found(spark):
    from pyspark.sql import functions as F

    path, other = work_folder(spark, "warc-good"), work_folder(spark, "warc-bad")
    warc.write_archive(spark.createDataFrame([(1, "u", "payload")], SCHEMA), path)
    bad = spark.read.parquet(path).withColumn("body", F.encode(F.replace(F.decode("body", "UTF-8"), F.lit("payload"), F.lit("pAyload")), "UTF-8"))
    bad.write.parquet(other)
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, other).collect()


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.round_trip(empty, work_folder(spark, "warc-empty")).count() == 0
    clash = spark.createDataFrame([(1, "u", "x", "k", 3)], SCHEMA + ", kind string, digest int")
    assert warc.round_trip(clash, work_folder(spark, "warc-clash")).collect()[0]["record_type"] == "response"


def test_repeated_ids_and_odd_ids(spark, tmp_path):
    """One page id with payloads of different sizes and a revisit to it; ids with line ends and % signs."""
    rows = [(5, "u", "x" * 10), (5, "u", "y" * 20), (3, "u", "x" * 10), (2, "u", "y" * 20)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string"), str(tmp_path / "a")).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got if r["page_id"] != 5) == [
        (2, 20, "revisit", 5), (3, 10, "revisit", 5),
    ]
    rows = [("a\na", "u%0A", "payload"), ("%0A", "u", "payload"), ("", "u", "other"), ("b>", "u", "p")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string"), str(tmp_path / "b")).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["refers_to"]) for r in got) == [("", 5, None), ("%0A", 7, "a\na"), ("a\na", 7, None), ("b>", 1, None)]
