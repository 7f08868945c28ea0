"""Archives: exact round trips, and version lines inside payloads."""

import base64
import hashlib

import pytest

from checks.compare import check
from tablematch.llm import queries, warc

V = "WARC/1.1\r\n"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


FAKE = V + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
ROWS = [
    (0, "http://a/\r\nX: y", "plain"), (1, None, None), (2, "u", ""), (3, "u", "é\r\n\r\nü" * 50), (4, "u", V), (5, "u", V + V + "x"), (6, "u", FAKE),
    (7, "u", "a" + FAKE + FAKE + "b" + V + "Content-Length: 5"), (8, "u", "plain"), (9, "u", FAKE), (10, "u", "q" * 3000 + V + "r" * 4000), (11, "u", "WARC/1.0\r\n"),
]


@pytest.mark.parametrize("records,split", [(4096, "64m"), (5, "2k"), (1, "64m")])
def test_round_trip(spark, tmp_path, records, split):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS file").coalesce(1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.archived(pages, path=str(tmp_path / "w"), records=records).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    heads = {}
    for i, _, t in ROWS:
        heads[t or ""] = max(i, heads.get(t or "", i))
    want = {
        i: (len((t or "").encode()), digest(t or ""), *(("response", None) if heads[t or ""] == i else ("revisit", heads[t or ""]))) for i, _, t in ROWS
    }
    page = lambda x: None if x is None else int(x.rsplit(":")[-1])
    assert {page(r.record_id): (r.payload_bytes, r.payload_digest, r.type, page(r.refers_to)) for r in got} == want and len(got) == len(ROWS)
    assert {r.url for r in got} == {None, "u", "http://a/ X: y"}


def test_repeated_rows_null_ids_and_limits(spark, tmp_path):
    rows = [(1, "u", "same text"), (1, "u", "same text"), (2, "u", "same text"), (2, "u", "same text"), (None, "u", "same text"), (None, "u", "own"), (3, "u", "ab"), (4, "u", "ab")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.record_id, r.type, r.refers_to) for r in warc.archived(pages, min_bytes=3, path=str(tmp_path / "w")).collect()]
    head = "urn:page:2"
    want = [("urn:page:1", "revisit", head)] * 2 + [(head, "response", None)] * 2 + [("urn:page:", "revisit", head), ("urn:page:", "response", None)]
    want += [("urn:page:3", "response", None), ("urn:page:4", "response", None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.archived(pages.limit(0), path=str(tmp_path / "e")).count() == 0


def test_broken_chain_ends(spark, tmp_path):
    record = V + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:{}>\r\nContent-Length: {}\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc\r\n\r\n"
    good, bad = record.format(1, 22), record.format(2, 21)
    folder = tmp_path / "b"
    folder.mkdir()
    (folder / "one.warc").write_bytes((good + bad + good).encode())
    (folder / "two.warc").write_bytes(("junk" + good).encode())
    got = warc.read_archives(spark, str(folder)).collect()
    assert sorted(r.record_id for r in got) == ["urn:page:1", "urn:page:2"]


def test_query_equals_sql(spark):
    good, why = check(spark, "/root/testdata/sf0.001", "op8_warc", queries.QUERIES["op8_warc"], queries.ORACLES["op8_warc"])
    assert good, why
