"""WARC archives: write captures, read them back, and merge their indexes into ordered capture histories.

Writing: a record per row, as a text table whose line separator is the two line ends that close a WARC record, so that
Spark's own writer (its commit, its compression, any file system) makes the archives. Of the records with equal payloads, the one
with the smallest id is the response and the others are revisits of it, without a body. Reading: Spark lists and opens the
files; each is parsed by its content lengths and its captures make a run sorted by (url key, time, id). Merging: the runs are
cut at common range boundaries, and each range merges its k segments with a loser tree. Ranges are by the whole key, so one URL
with very many captures spreads over several.

Null payloads are empty. Null urls have no target line and an empty url key; null ids sort first and have an empty record
id; they are a revisit if the payload has a response with an id, else a response. Rows that repeat the smallest id are responses
all of them. Other columns are not read. No rows: no archives, no captures.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

RECORDS_PER_FILE = 5000
#: Captures that one merged range holds, about.
RANGE_ROWS = 200_000
CAPTURE = "urlkey string, ts string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, run string, at int"
_SEP = "\r\n\r\n"


def base32_sha1(text: Column) -> Column:
    """The SHA-1 of a text's UTF-8 bytes in upper-case base32."""
    digest = F.sha1(text.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then path and query: what sorts a site's captures together."""
    m = re.match(r"(?s)[^:/?#]*://([^/?#]*)([^#]*)", url or "")
    return f"{','.join(reversed(m[1].lower().split('.')))}){m[2] or '/'}" if m else ""


def write_archives(pages: DataFrame, to: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Write the archives of pages below `to`. Payloads under min_bytes are never revisits."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    first = scratch.stored(rows.select("page_id", "digest").groupBy("digest").agg(F.min("page_id").alias("first")), "payloads")
    rows = rows.join(first, "digest")
    again = (F.col("bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_SEP))
    block = F.when(again, http).otherwise(F.concat(http, "payload"))
    seconds = F.coalesce(F.pmod("page_id", F.lit(10**9)), F.lit(0))
    date = F.date_format(F.timestamp_seconds(F.lit(1704067200) + seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    target = F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20]", "%20"), F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name("page_id"), F.lit("\r\n"),
        F.coalesce(target, F.lit("")), F.lit("WARC-Date: "), date, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"),
        F.when(again, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name("first"), F.lit("\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_SEP),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", _SEP).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(to)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    at = 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        head = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]))
        size = int(head["content-length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _id(name: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(m[1]) if m else None


def capture(head: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = head["warc-type"] == "revisit"
    if revisit:
        size = int(re.search(rb"(?i)content-length:\s*(\d+)", http)[1])
        digest = head["warc-payload-digest"].removeprefix("sha1:")
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    url = head.get("warc-target-uri")
    return url_key(url), head["warc-date"], _id(head["warc-record-id"]), url, head["warc-type"], size, digest, _id(head.get("warc-refers-to")) if revisit else None


def _order(row) -> tuple:
    return row[0], row[1], -(1 << 63) if row[2] is None or row[2] != row[2] else row[2]


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives below path; each archive is a run that is sorted by url key, time and id."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                run = sorted((capture(*r) for r in records(gzip.decompress(content))), key=_order)
                out = pd.DataFrame([(*r, name, i) for i, r in enumerate(run)], columns=[c.split()[0] for c in CAPTURE.split(", ")])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content").mapInPandas(parse, CAPTURE)


def loser_tree(runs: list[list[tuple]], key) -> Iterator[tuple]:
    """The rows of k sorted runs in one order. Each inner node keeps the loser of its match, so a row costs log k matches."""
    k = len(runs)
    if k == 0:
        return
    at = [0] * k
    ended = (1,)
    heads = [(0, key(r[0])) if r else ended for r in runs]
    tree, top = [-1] * k, -1
    for i in range(k):  # the first to reach a node waits there; the second plays it and the winner goes on
        winner, node = i, (i + k) // 2
        while node:
            other = tree[node]
            if other < 0:
                tree[node], winner = winner, -1
                break
            if (heads[other], other) < (heads[winner], winner):
                tree[node], winner = winner, other
            node //= 2
        top = winner if winner >= 0 else top
    while heads[top] != ended:
        yield runs[top][at[top]]
        at[top] += 1
        heads[top] = (0, key(runs[top][at[top]])) if at[top] < len(runs[top]) else ended
        winner, node = top, (top + k) // 2
        while node:
            other = tree[node]
            if (heads[other], other) < (heads[winner], winner):
                tree[node], winner = winner, other
            node //= 2
        top = winner


def merged(runs: DataFrame) -> DataFrame:
    """All captures in one order by url key, time and id: range by range, and in each range merged from the runs' segments."""
    n = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segments: dict[str, list[tuple]] = {}
        names = None
        for pdf in frames:
            names = list(pdf.columns)
            for row in pdf.itertuples(index=False, name=None):
                segments.setdefault(row[8], []).append(row)
        if not segments:
            return
        for rows in segments.values():  # a shuffle may deliver a segment's batches in any order
            if any(a[9] > b[9] for a, b in zip(rows, rows[1:])):
                rows.sort(key=lambda r: r[9])
        part: list[tuple] = []
        for row in loser_tree([segments[k] for k in sorted(segments)], _order):
            part.append(row)
            if len(part) == 10_000:
                yield pd.DataFrame(part, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                part = []
        yield pd.DataFrame(part, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return runs.repartitionByRange(n, "urlkey", "ts", "page_id").mapInPandas(merge, CAPTURE)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Write every page to archives, read them back, and return the merged capture index."""
    to = scratch.path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), to)
    runs = scratch.stored(read_runs(spark, to), "runs")
    return merged(runs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts")
