"""WARC: resolving not-modified revisits by an as-of join on the canonical URL.

A revisit takes the payload of the latest full response captured before it (by time, then record id) under the same
canonical URL. Its validators are checked: with an entity tag on both sides the tags must be equal (a weak mark aside);
else with a modification date on both, the dates. Then the stored headers are updated by those that a 304 may update;
others (lengths, encodings, types, hop-by-hop) stay as stored.

As-of join without a hot task: rows are range-partitioned by (URL, time, id), so one URL's captures may lie in several
partitions. Inside a (partition, URL) the latest response comes from a window; for the rows before a partition's first
response it is carried over from the URL's earlier partitions, of which there is one row each. Payloads stay out of
it: digest and size stand for them.

Records are read from WARC bytes (``read_warc``: plain or gzip by member, response and revisit records with their HTTP
header blocks). The query writes ``pages`` as such bytes first.

Defined results: status full (a response), resolved, unverified (resolved, but no validator on both sides to check),
mismatch (validators differ) or orphan (no earlier response); a null URL equals no other, with or without a record id;
null times come first; records of equal id and time are kept, each resolved; missing header maps count as empty; very
long payloads are hashed, not carried; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, map_texts, written

# Header fields that a 304 response doesn't replace in the stored ones (RFC 9111, 3.2), lower case.
KEPT_AS_STORED = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
TRACKING = "utm_[a-z]+|ref|sessionid|fbclid|gclid"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www./m. and default ports, path without end slash, query without tracking."""
    head = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, head, 1)), r"^(?:www[0-9]*|m)\.", ""), r":(?:80|443)$", "")
    rest = F.regexp_replace(url, head, "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^?#]*", 0), r"/+$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"\?([^#]*)", 1), rf"(?:^|&)(?:{TRACKING})=[^&]*", ""), "^&", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def resolve(records: DataFrame) -> DataFrame:
    """Resolve ``records(record_id, kind, url, ts, headers map, digest, n_bytes)``; header names in lower case.

    Returns record_id, kind, url_key, ts, status, response_id, headers, digest, n_bytes.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = records.select("record_id", "kind", F.col("ts").cast("long").alias("ts"), F.coalesce(canonical_url(F.col("url")), F.concat(F.lit("\0"), F.coalesce(F.col("record_id").cast("string"), F.concat(F.lit("?"), F.monotonically_increasing_id())))).alias("url_key"), F.coalesce("headers", none).alias("headers"), "digest", "n_bytes")
    full = F.when(F.col("kind") == "response", F.struct("record_id", "headers", "digest", "n_bytes"))
    # the partition's number is part of the rows from here on, so it's written
    rows = cut(rows.repartitionByRange("url_key", F.col("ts").asc_nulls_first(), "record_id").withColumn("part", F.spark_partition_id()).withColumn("full", full))
    order = [F.col("ts").asc_nulls_first(), F.col("record_id")]
    earlier = Window.partitionBy("part", "url_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.last("full", ignorenulls=True).over(earlier))
    tails = rows.filter("full IS NOT NULL").groupBy("part", "url_key").agg(F.max_by("full", F.struct(F.coalesce("ts", F.lit(-(2**63))), "record_id")).alias("tail"))
    places = rows.select("part", "url_key").distinct().join(tails, ["part", "url_key"], "left")
    before = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = places.withColumn("carried", F.last("tail", ignorenulls=True).over(before)).filter("carried IS NOT NULL").select("part", "url_key", "carried")
    out = near.join(carried, ["part", "url_key"], "left").withColumn("past", F.coalesce("near", "carried"))

    def tag(h: str) -> Column:
        return F.regexp_replace(F.col(h).getItem("etag"), "^W/", "")

    same = F.coalesce(tag("headers") == tag("past.headers"), F.col("headers").getItem("last-modified") == F.col("past.headers").getItem("last-modified"))
    status = F.when(F.col("kind") == "response", "full").when(F.col("past").isNull(), "orphan").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    out = out.withColumn("status", status)
    done = F.col("status").isin("resolved", "unverified")
    new = F.map_filter("headers", lambda k, v: ~k.isin(*KEPT_AS_STORED))
    stored = F.map_filter("past.headers", lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return out.select(
        "record_id", "kind", "url_key", "ts", "status",
        F.when(done, F.col("past.record_id")).alias("response_id"),
        F.when(done, F.map_concat(stored, new)).otherwise(F.col("headers")).alias("headers"),
        F.when(done, F.col("past.digest")).otherwise(F.col("digest")).alias("digest"),
        F.when(done, F.col("past.n_bytes")).otherwise(F.col("n_bytes")).alias("n_bytes"),
    )


# --- WARC bytes ---------------------------------------------------------------------------------------------------

RECORD = "record_id string, kind string, url string, ts long, headers map<string,string>, digest string, n_bytes long"
NAMES = ["record_id", "kind", "url", "ts", "headers", "digest", "n_bytes"]
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"


def _fields(block: bytes) -> tuple[str, dict[str, str]]:
    """(first line, fields by lower-case name) of a header block; repeated fields are joined by commas, folded lines by a space."""
    lines = block.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    out: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name, value = name.strip().lower(), value.strip()
            out[name] = f"{out[name]}, {value}" if name in out else value
    return lines[0], out


def members(data: bytes) -> Iterator[bytes]:
    """The members of a gzip file one by one, or the data itself if it isn't one. A broken member ends it."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(data):
        d, parts = zlib.decompressobj(31), []
        try:
            while not d.eof and at < len(data):
                parts.append(d.decompress(view[at : at + 65_536]))
                at = min(at + 65_536, len(data)) - len(d.unused_data)
        except zlib.error:
            return
        yield b"".join(parts)


def records(data: bytes) -> Iterator[tuple]:
    """The response and revisit records of WARC bytes, as RECORD; a record that the end cuts off is left out."""
    for part in members(data):
        at = part.find(b"WARC/")
        while at >= 0:
            end = part.find(b"\r\n\r\n", at)
            if end < 0:
                break
            _, f = _fields(part[at:end])
            size = int(f["content-length"]) if f.get("content-length", "").isdigit() else 0
            body = part[end + 4 : end + 4 + size]
            if len(body) < size:
                break
            kind = f.get("warc-type", "")
            if kind in ("response", "revisit"):
                head, _, payload = body.partition(b"\r\n\r\n")
                headers = _fields(head)[1] if head.startswith(b"HTTP/") else {}
                payload = payload if kind == "response" else b""
                digest = f.get("warc-payload-digest") if kind == "revisit" else f.get("warc-payload-digest") or "sha256:" + hashlib.sha256(payload).hexdigest()
                yield f.get("warc-record-id", "").strip("<>") or None, kind, f.get("warc-target-uri"), seconds(f.get("warc-date")), headers, digest, len(payload)
            at = part.find(b"WARC/", end + 4 + size)


def seconds(date: str | None) -> int | None:
    """Seconds since 1970 of a WARC date; null where it can't be read."""
    try:
        return int(datetime.fromisoformat(date.replace("Z", "+00:00")).timestamp()) if date else None
    except ValueError:
        return None


def record_bytes(record_id: str | None, kind: str, url: str | None, ts: int | None, headers: dict[str, str], payload: bytes) -> bytes:
    """One WARC record with its HTTP header block."""
    plain = lambda v: re.sub(r"[\r\n]+", " ", v)
    status = b"HTTP/1.1 200 OK" if kind == "response" else b"HTTP/1.1 304 Not Modified"
    body = b"\r\n".join([status, *(f"{plain(k)}: {plain(v)}".encode("utf-8", "surrogatepass") for k, v in headers.items()), b"", b""]) + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id and f"<{record_id}>"), ("WARC-Target-URI", url), ("WARC-Date", None if ts is None else (EPOCH + timedelta(seconds=ts)).strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0"))]
    fields += [("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest())] if kind == "response" else [("WARC-Profile", NOT_MODIFIED)]
    fields += [("Content-Type", "application/http"), ("Content-Length", str(len(body)))]
    head = "\r\n".join(["WARC/1.1", *(f"{k}: {plain(v)}" for k, v in fields if v is not None), "", ""])
    return head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def _table(rows: list[tuple], more: dict[str, pa.Array] | None = None) -> pa.RecordBatch:
    """RECORD rows as a batch, with further columns."""
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64())
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    arrays = [pa.array([list((x or {}).items()) for x in v] if pa.types.is_map(t) else list(v), t) for v, t in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, *(more or {}).values()], [*NAMES, *(more or {})])


def read_records(files: DataFrame) -> DataFrame:
    """RECORD rows of files(content): WARC bytes, plain or gzip. One file is one row, up to Spark's limit of 2 GB."""

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows = list(records(content.as_py() or b""))
                for k in range(0, len(rows), 10_000):
                    yield _table(rows[k : k + 10_000])

    return files.select("content").mapInArrow(run, RECORD)


NEXT = "\r\n\r\nWARC/"  # what ends a record and begins the next


def is_whole(piece: bytes) -> bool:
    """Whether a piece of a file, from one header on, holds the record that its header announces."""
    end = piece.find(b"\r\n\r\n")
    # the separator took the blank line of a record without a body
    size = _fields(piece if end < 0 else piece[:end])[1].get("content-length", "")
    return size.isdigit() and (len(piece) - end - 4 if end >= 0 else 0) >= int(size)


def read_warc(spark: SparkSession, *paths: str, skip_broken: bool = False) -> DataFrame:
    """RECORD rows of the WARC files at paths, record by record: a task holds a few records, not a file.

    Plain files are dealt in splits, gzip files are read as streams. A file in which a record isn't whole between two
    separators (its body holds the separator, or the file's end cuts it off) is read again as one row by ``read_records``; so is
    one that doesn't begin with a record. A broken gzip file is an error; with ``skip_broken`` the rest of it is left out,
    whatever the error was.
    """
    text = spark.read.option("lineSep", NEXT).option("ignoreCorruptFiles", skip_broken).text(list(paths))
    pieces = text.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"))

    def run(batches):
        for b in batches:
            rows, files, whole = [], [], []
            for piece, file in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                data = piece.as_py() or b""
                if not data.strip():
                    continue
                data = data if data.startswith(b"WARC/") else b"WARC/" + data
                fine = is_whole(data)
                found = list(records(data + b"\r\n\r\n")) if fine else [(None,) * len(NAMES)]
                rows += found
                files += [file] * len(found)
                whole += [fine] * len(found)
            yield _table(rows, {"file": pa.array(files, pa.string()), "whole": pa.array(whole, pa.bool_())})

    got = written(map_texts(pieces, run, f"{RECORD}, file string, whole boolean"), "records")
    broken = got.filter("NOT whole").select("file").distinct()
    names = [r["file"] for r in broken.collect()]  # of files, as the driver lists them anyway
    if not names:
        return got.select(*NAMES)
    again = spark.read.format("binaryFile").load([re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(n)) for n in names])
    return got.join(broken, "file", "left_anti").select(*NAMES).union(read_records(again))


def capture_log(pages: DataFrame) -> DataFrame:
    """WARC bytes of every row of ``pages``: a full response, and a later revisit under another spelling of the URL.

    Every fifth revisit has a stale entity tag; every third has none and is checked by its date.
    """

    def run(batches):
        for b in batches:
            out = []
            for page, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                body = (html.as_py() or "").encode("utf-8", "surrogatepass")
                tag, n = hashlib.md5(body).hexdigest(), page or 0
                date = f"day {n // 7}"
                full = {"Content-Type": "text/html", "Content-Length": str(len(body)), "ETag": tag, "Last-Modified": date, "Cache-Control": "max-age=60"}
                etag = {"ETag": "stale"} if n % 5 == 0 else {"ETag": f"W/{tag}"} if n % 3 else {}
                name = lambda k, page=page: None if page is None else f"urn:capture:{page * 2 + k}"
                ts = None if page is None else page * 2
                again = None if url is None else url.partition("#")[0] + "#again"
                out.append(record_bytes(name(0), "response", url, ts, full, body) + record_bytes(name(1), "revisit", again, None if ts is None else ts + 1, {"Content-Length": "0", "Last-Modified": date, "Cache-Control": f"max-age={n}"} | etag, b""))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["content"])

    return pages.selectExpr("cast(page_id as long)", "url", "html").mapInArrow(run, "content binary")


def resolve_pages(pages: DataFrame) -> DataFrame:
    """The capture log of ``pages``, read from its WARC bytes and resolved; header fields as columns; response_id -1 where
    there is none."""
    number = lambda c: F.regexp_extract(c, r"([0-9]+)$", 1).try_cast("long")
    # written, as the range partitioning of ``resolve`` reads its input twice: once to sample, once to deal
    log = written(read_records(capture_log(pages)).withColumn("record_id", number(F.col("record_id"))), "captures")
    out = resolve(log)
    fields = ("content-type", "content-length", "etag", "last-modified", "cache-control")
    return out.select("record_id", "kind", "url_key", "ts", "status", F.coalesce("response_id", F.lit(-1)).alias("response_id"), *[F.col("headers").getItem(f).alias(f.replace("-", "_")) for f in fields], F.regexp_replace("digest", "^sha256:", "").alias("digest"), "n_bytes")


ORACLE = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, 'day ' || CAST(page_id // 7 AS VARCHAR) AS stamp FROM pages),
r AS (
  SELECT page_id * 2 AS record_id, 'response' AS kind, url, page_id * 2 AS ts, 'text/html' AS content_type, CAST(strlen(body) AS VARCHAR) AS content_length,
    md5(body) AS etag, stamp AS last_modified, 'max-age=60' AS cache_control, sha256(body) AS digest, CAST(strlen(body) AS BIGINT) AS n_bytes FROM p
  UNION ALL
  SELECT page_id * 2 + 1, 'revisit', regexp_replace(url, '#.*$', '') || '#again', page_id * 2 + 1, NULL, '0',
    CASE WHEN page_id % 5 = 0 THEN 'stale' WHEN page_id % 3 <> 0 THEN 'W/' || md5(body) END, stamp, 'max-age=' || CAST(page_id AS VARCHAR), NULL, CAST(0 AS BIGINT) FROM p),
u AS (SELECT *,
    regexp_replace(regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^(?:www[0-9]*|m)\.', ''), ':(?:80|443)$', '') AS host,
    regexp_replace(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', '') AS rest FROM r),
q AS (SELECT *, regexp_replace(regexp_extract(rest, '^[^?#]*'), '/+$', '') AS path,
    regexp_replace(regexp_replace(regexp_extract(rest, '\?([^#]*)', 1), '(?:^|&)(?:utm_[a-z]+|ref|sessionid|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') AS query FROM u),
k AS (SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key FROM q),
a AS (SELECT *, max(CASE WHEN kind = 'response' THEN struct_pack(ts := ts, id := record_id) END) OVER (PARTITION BY url_key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM k),
j AS (SELECT a.*, s.etag AS s_etag, s.last_modified AS s_lm, s.content_type AS s_type, s.content_length AS s_length, s.digest AS s_digest, s.n_bytes AS s_bytes,
    CASE WHEN a.kind = 'response' THEN 'full' WHEN a.past IS NULL THEN 'orphan'
      WHEN coalesce(regexp_replace(a.etag, '^W/', '') = regexp_replace(s.etag, '^W/', ''), a.last_modified = s.last_modified) THEN 'resolved' ELSE 'mismatch' END AS status
  FROM a LEFT JOIN k s ON s.record_id = a.past.id)
SELECT record_id, kind, url_key, ts, status, CASE WHEN status = 'resolved' THEN past.id ELSE -1 END AS response_id,
  CASE WHEN status = 'resolved' THEN s_type ELSE content_type END AS content_type, CASE WHEN status = 'resolved' THEN s_length ELSE content_length END AS content_length,
  CASE WHEN status = 'resolved' THEN coalesce(etag, s_etag) ELSE etag END AS etag, CASE WHEN status = 'resolved' THEN coalesce(last_modified, s_lm) ELSE last_modified END AS last_modified, cache_control,
  CASE WHEN status = 'resolved' THEN s_digest ELSE digest END AS digest, CASE WHEN status = 'resolved' THEN s_bytes ELSE n_bytes END AS n_bytes
FROM j
"""
