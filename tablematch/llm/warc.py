"""Web archives: writing records with revisits, and reading them back by verified chains of records.

An archive is read in splits, cut at the version line that begins a record. Such a line may also stand inside a payload,
so each piece is only a candidate. A candidate says where its successor begins; pointer jumping from the start of each
file finds the candidates that the chain reaches, and these alone are records. Pieces between them belong to the payload
of the record before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablematch.plans.skew import durable, release, work_folder

# The version line, the end of a head and of a record, the profile of revisits.
VERSION, BREAK = "WARC/1.1\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records in one file, and bytes in one cell when pieces look for their record.
RECORDS, CELL = 4096, 1 << 20


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 20 bits, five hex digits, make four characters."""
    digits = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z", records: int = RECORDS,
) -> None:
    """One record per row of `pages` under `path`, at most `records` in a file. Of equal payloads of `min_bytes` or more
    that of the largest id is a response and the others revisit it; rows of that id and payload are all responses. Null
    payloads are empty; null urls are left out, line ends in urls become spaces; null ids stay empty and revisit
    payloads that have an id."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_name"), F.col(id_col).alias("_id"),
        F.regexp_replace(F.col(url_col).cast("string"), "[\r\n]+", " ").alias("_url"), html.alias("_html"),
        F.octet_length(html).cast("long").alias("_bytes"), base32_sha1(html.cast("binary")).alias("_digest"),
    )
    same = rows.where(F.col("_bytes") >= min_bytes).groupBy("_digest", "_bytes").agg(F.max("_id").alias("_head"), F.count(F.lit(1)).alias("_n"))
    heads = durable(same.where("_n > 1 AND _head IS NOT NULL").drop("_n"))
    rows = rows.join(heads, ["_digest", "_bytes"], "left")
    revisit = F.col("_head").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_head"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit(BREAK))
    block = F.when(revisit, http).otherwise(F.concat(http, "_html"))
    head = F.concat(
        F.lit(f"{VERSION}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:page:"),
        F.col("_name"), F.lit(">\r\n"), F.coalesce(F.concat(F.lit("WARC-Target-URI: "), "_url", F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("_digest"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("_head").cast("string"), F.lit(">\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("_block").cast("string"), F.lit(BREAK),
    )
    out = rows.withColumn("_block", block).select(F.concat(head, "_block").alias("value"))
    out.write.option("lineSep", BREAK).option("maxRecordsPerFile", records).text(path)
    release(heads)


def _pieces(spark: SparkSession, path: str, *columns: Column) -> DataFrame:
    """(file, start, place, size, *columns): what stands between version lines, in order by (file, start, place)."""
    scan = spark.read.option("lineSep", VERSION).text(path)
    return scan.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"), F.octet_length("value").cast("long").alias("size"), *columns,
    )


def _located(pieces: DataFrame) -> DataFrame:
    """Add `at`, the byte where the piece begins: sums inside each split, and over the splits of a file before it."""
    step = F.col("size") + len(VERSION)
    inside = Window.partitionBy("file", "start").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = pieces.groupBy("file", "start").agg(F.sum(step).alias("bytes"))
    offsets = splits.select("file", "start", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset"))
    local = pieces.withColumn("inside", F.coalesce(F.sum(step).over(inside), F.lit(0)))
    return local.join(offsets, ["file", "start"]).withColumn("at", F.col("offset") + F.col("inside")).drop("offset", "inside")


def _field(head: Column, name: str, pattern: str = r"([^\r\n]*)") -> Column:
    found = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*{pattern}", 1)
    return F.when(found != "", found)


def _parsed(value: Column) -> list[Column]:
    """Of a piece: its head's fields, where its block begins and how long it says it is, and of whole pieces size and digest
    of the payload that the block holds."""
    head = F.substring_index(value, BREAK, 1)
    return [
        F.lower(_field(head, "WARC-Type")).alias("type"), _field(head, "WARC-Record-ID", r"<?([^>\r\n]*)").alias("record_id"),
        _field(head, "WARC-Target-URI").alias("url"), _field(head, "WARC-Refers-To", r"<?([^>\r\n]*)").alias("refers_to"),
        _field(head, "WARC-Payload-Digest", r"(?:sha1:)?([^\r\n]*)").alias("digest"),
        _field(head, "Content-Length", "([0-9]{1,18})").cast("long").alias("length"),
        (F.octet_length(head) + len(BREAK)).cast("long").alias("skip"), *_payload(value.cast("binary"), F.octet_length(head) + len(BREAK)),
    ]


def _payload(data: Column, skip: Column) -> list[Column]:
    """Of a record's bytes without version line, but with the break after it: HTTP head, payload size and digest."""
    block = F.substring(data, skip + 1, F.octet_length(data) - skip - len(BREAK))
    http = F.substring_index(block.cast("string"), BREAK, 1)
    body = F.substring(block, F.octet_length(http) + len(BREAK) + 1, F.octet_length(block))
    return [_field(http, "Content-Length", "([0-9]{1,18})").cast("long").alias("told"), F.octet_length(body).cast("long").alias("bytes"), base32_sha1(body).alias("sha1")]


def reached(candidates: DataFrame) -> DataFrame:
    """(file, at): the candidates (file, at, next) that the chain from byte 0 of each file reaches. Every round doubles the
    length of the jumps, and so the part of each chain that is known."""
    jumps = durable(candidates.select("file", "at", "next"))
    known = durable(jumps.where("at = 0").select("file", "at"))
    n = known.count()
    while n:
        ahead = known.join(jumps, ["file", "at"]).select("file", F.col("next").alias("at"))
        places = candidates.select("file", "at")
        grown = durable(known.union(ahead.join(places, ["file", "at"], "left_semi")).distinct())
        release(known)
        known, last, n = grown, n, grown.count()
        if n == last:
            break
        onward = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("further"))
        longer = durable(jumps.join(onward, ["file", "next"]).select("file", "at", F.col("further").alias("next")))
        release(jumps)
        jumps = longer
    return known


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, type, record_id, url, refers_to, digest, payload_bytes, payload_digest): the records of the archives
    under `path`, uncompressed, with size and digest of the payload as read; a revisit has those of the payload it tells.
    Files that do not begin with a record, and what follows a broken record, give none; no files, no records."""
    located = durable(_located(_pieces(spark, path, *_parsed(F.col("value")))))
    candidates = located.where("at > 0 AND length IS NOT NULL").withColumn("at", F.col("at") - len(VERSION))
    # a piece is whole if the next version line stands where its record ends; the last piece of a file has none behind it
    candidates = durable(candidates.withColumn("end", F.col("at") + len(VERSION) + F.col("skip") + F.col("length") + len(BREAK)))
    records = candidates.join(reached(candidates.withColumn("next", F.col("end"))), ["file", "at"], "left_semi")
    whole = F.col("at") + len(VERSION) + F.col("size") == F.col("end")
    records = durable(records.withColumn("whole", whole))
    release(located)
    broken = records.where("NOT whole").select("file", F.col("at").alias("from"), "end", "skip")
    if not broken.isEmpty():
        again = _joined(spark, path, durable(broken))
        records = records.drop("told", "bytes", "sha1").where("NOT whole").join(again, ["file", "at"]).unionByName(records.where("whole"))
    told = (F.col("type") == "revisit") & F.col("told").isNotNull()
    return records.select(
        "file", "at", "type", "record_id", "url", "refers_to", "digest", F.when(told, F.col("told")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(F.col("type") == "revisit", F.coalesce("digest", "sha1")).otherwise(F.col("sha1")).alias("payload_digest"),
    )


def _joined(spark: SparkSession, path: str, broken: DataFrame) -> DataFrame:
    """(file, at, told, bytes, sha1) of records in several pieces, put together again. Only their files are read twice."""
    files = broken.select("file").distinct()
    pieces = _located(_pieces(spark, path, F.col("value").cast("binary").alias("value")).join(files, "file", "left_semi"))
    cells = broken.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / CELL), F.floor(F.col("end") / CELL))))
    placed = pieces.withColumn("cell", F.floor(F.col("at") / CELL))
    held = placed.join(cells, ["file", "cell"]).where("at > `from` AND at < `end`")
    parts = held.groupBy("file", "from", "end", "skip").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))
    values = F.transform("parts", lambda p: F.hex(p["value"]))  # bytes of one record, a version line between each two
    data = F.unhex(F.array_join(values, VERSION.encode().hex().upper()))
    size = (F.col("end") - F.col("from") - len(VERSION)).cast("int")
    rows = parts.withColumn("data", F.substring(data, F.lit(1), size))
    return rows.select("file", F.col("from").alias("at"), *_payload(F.col("data"), F.col("skip").cast("int")))


def archived(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, path: str | None = None,
    records: int = RECORDS,
) -> DataFrame:
    """The records of `read_archives` after `write_archives` of `pages` to `path` (a folder of the work folder, if none)."""
    path = path or f"{work_folder(pages.sparkSession)}/archive-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col, url_col, html_col, min_bytes, records=records)
    return read_archives(pages.sparkSession, path)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
    SELECT page_id, octet_length(encode(html)) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS head,
           list_transform(range(0, 8), lambda k: ('0x' || substr(sha1(html), (5 * k + 1)::INT, 5))::INTEGER) AS parts
    FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(parts, lambda v:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 10) % 32 + 1, 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1)), '') AS payload_digest,
       CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN head <> page_id THEN head END AS refers_to
FROM d
"""
