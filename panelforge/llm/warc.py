"""WARC records, and not-modified revisits resolved to the responses that they stand for.

A revisit (304) has no payload: it says that the latest full response of its URL still holds.  ``resolve`` finds that
response by an as-of join on the canonical URL, checks the validators, and merges the headers that a 304 may change.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._prefix import attach
from ._store import durable, small_batches
from ._text import tidied

#: Fixed list: fields of a 304 that don't replace those of the stored response, being of its own message or content.
NOT_MERGED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: Query parameters that don't tell pages apart.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)="
#: The kind of the rows that stand for records that can't be read.
UNREADABLE = "unreadable"
#: Microseconds of a bucket of a URL's times.
BUCKET = 3_600_000_000

_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)\??([^#]*)"


def canonical_url(url: Column) -> Column:
    """Host in small letters without www. and default port, path without slashes at its end, parameters sorted and
    without those that only track; scheme and fragment don't count.  A null or other string without a host gives null."""
    part = lambda k: F.regexp_extract(url, _URL, k)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(part(2), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(part(3), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, query))


def record(kind: str | None, record_id: str | None, url: str | None, date: str | None, status: int | None, headers: dict[str, str | None] | None, payload: bytes | None) -> bytes:
    """One WARC record of a response or a revisit, with its HTTP message.  What is null is left out: a header without a
    value, a WARC field, the payload; a null status is written as 0, and a line break inside a value as a blank."""
    flat = lambda x: re.sub(r"[\r\n]+", " ", str(x))
    reason = {200: "OK", 304: "Not Modified"}.get(status, "-")
    http = f"HTTP/1.1 {status or 0} {reason}\r\n" + "".join(f"{flat(k)}: {flat(v)}\r\n" for k, v in (headers or {}).items() if v is not None) + "\r\n"
    body = http.encode() + (payload or b"")
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Target-URI": url, "WARC-Date": date}
    head |= {"WARC-Profile": NOT_MODIFIED} if kind == "revisit" else {}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {flat(v)}\r\n" for k, v in head.items() if v is not None).encode() + b"\r\n" + body + b"\r\n\r\n"


def _fields(stream: io.BufferedIOBase) -> dict[str, str]:
    found: dict[str, str] = {}
    last = ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:  # a folded line
            found[last] += " " + text.strip()
        elif ":" in text:
            last, value = text.split(":", 1)
            last = last.strip().lower()
            found[last] = f"{found[last]}, {value.strip()}" if last in found else value.strip()
    return found


def _broken(reason: str) -> dict:
    """The row that stands for a record that can't be read."""
    return {"kind": UNREADABLE, "record_id": None, "url": None, "date": None, "status": None, "headers": {}, "payload": reason.encode()}


def records(stream: io.BufferedIOBase) -> Iterator[dict]:
    """The records of a WARC stream, one at a time.  In the place of one that can't be read (no version line where a
    record should begin, no length or a bad one, an early end, broken compression) stands a row of the kind UNREADABLE
    with the reason for a payload; reading goes on at the next version line, if there is one."""
    lost = False
    while True:
        try:
            if not (line := stream.readline()):
                return
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                if not lost:
                    yield _broken(f"no WARC record begins with {line[:40]!r}")
                lost = True
                continue
            lost = False
            head = _fields(stream)
            told = head.get("content-length", "")
            if not (told.isascii() and told.isdigit()):
                lost = True
                yield _broken(f"Content-Length is {told!r}")
                continue
            body = stream.read(int(told))
        except (EOFError, OSError, zlib.error) as error:
            yield _broken(f"{type(error).__name__}: {error}")
            return
        if len(body) < int(told):
            yield _broken("a WARC record ends early")
            return
        out = {"kind": head.get("warc-type"), "record_id": head.get("warc-record-id"), "url": head.get("warc-target-uri"), "date": head.get("warc-date"), "status": None, "headers": {}, "payload": body}
        if head.get("content-type", "").startswith("application/http"):
            message = io.BytesIO(body)
            first = message.readline().split()
            out["status"] = int(first[1]) if len(first) > 1 and re.fullmatch(rb"[0-9]{1,9}", first[1]) else None
            out["headers"] = _fields(message)
            out["payload"] = message.read()
        yield out


_ROW = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "record_id", "url", "date")] + [T.StructField("status", T.IntegerType()), T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("payload", T.BinaryType())])
_ARROW = pa.schema([*[(n, pa.string()) for n in ("kind", "record_id", "url", "date")], ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _batches(found: Iterator[dict], rows: int = 256, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    part, held = [], 0
    for x in found:
        part.append(x | {"headers": list(x["headers"].items())})
        held += len(x["payload"])
        if len(part) >= rows or held >= size:
            yield pa.RecordBatch.from_pylist(part, _ARROW)
            part, held = [], 0
    if part:
        yield pa.RecordBatch.from_pylist(part, _ARROW)


def parse(df: DataFrame, content: str = "content") -> DataFrame:
    """The records in a binary column: kind, record_id, url, date, status, headers (names in small letters) and payload.
    Gzipped content, a member for each record or not, is unpacked as it is read; null and empty content has no records.
    What can't be read gives a row of the kind UNREADABLE (see ``records``), and the other records stay; a status that
    is no number is null, a header that occurs twice has both values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[dict]:
            for batch in batches:
                for value in batch.column(0):
                    if (buffer := value.as_buffer()) is not None:
                        raw = pa.BufferReader(buffer)
                        zipped = bytes(memoryview(buffer)[:2]) == b"\x1f\x8b"
                        yield from records(io.BufferedReader(gzip.GzipFile(fileobj=raw) if zipped else raw))

        yield from _batches(every())

    small_batches(df.sparkSession)
    return df.select(content).mapInArrow(tidied(run), _ROW)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, one task a file or several.  A file is one binary value, which Spark bounds at 2 GB;
    WARC files are written in parts of about 1 GB."""
    return parse(spark.read.format("binaryFile").load(path), "content")


def render(df: DataFrame, out: str = "content") -> DataFrame:
    """One WARC record for each row with kind, record_id, url, date, status, headers and payload, as a binary column.
    Nulls in any of them are left out of the record (see ``record``); repeated rows are records of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = batch.slice(start, 512).to_pylist()
                made = [record(r["kind"], r["record_id"], r["url"], r["date"], r["status"], r["headers"] and dict(r["headers"]), r["payload"]) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], [out])

    return df.select(*_ROW.names).mapInArrow(tidied(run), T.StructType([T.StructField(out, T.BinaryType())]))


def resolve(captures: DataFrame) -> DataFrame:
    """Every capture with url_key, refers_to, outcome and merged headers.

    ``captures`` has record_id, url, date (ISO 8601, UTC), status, headers, and other columns, which stay; url_key,
    refers_to and outcome give way.  A capture with status 304 is a revisit, one with 200 a full response.  A revisit
    is joined to the latest response of the same canonical URL with an earlier date (of equal dates the greatest
    record_id); outcome says what came of it: ``resolved``; ``no_earlier`` response; ``mismatch``, when its ETag, or
    without one its Last-Modified, isn't that of the response; ``no_validator``, when it has neither.  Other captures
    are ``full`` (200) or ``other``.  A resolved revisit has the response's headers with its own over them, but for
    NOT_MERGED; all others keep theirs.  Null URLs and dates match nothing, null headers are none; repeated rows stay;
    empty gives empty.

    The join works on each URL's distinct times, with the last response of each: they are cut into hours, the latest
    response before an hour comes from the hours' own latest ones, and a revisit looks up its time.  So a URL with a
    large part of all captures, at one time or many, isn't sorted in one task: a window holds the times of an hour, or
    the hours of a URL.
    """
    rows = captures.drop("url_key", "refers_to", "outcome").withColumn("url_key", canonical_url(F.col("url")))
    rows = rows.withColumn("__t__", F.unix_micros(F.try_to_timestamp("date")))
    placed = F.col("__t__").isNotNull() & F.col("url_key").isNotNull()
    own = [F.col("record_id").alias("id"), F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("modified")]
    times = rows.filter(placed & F.col("status").isin(200, 304)).groupBy(F.col("url_key").alias("k"), F.col("__t__").alias("t")).agg(F.max(F.when(F.col("status") == 200, F.struct(*own))).alias("r"))
    times = durable(times.withColumn("r", F.when(F.col("r").isNotNull(), F.struct("t", *[F.col(f"r.{n}").alias(n) for n in ("id", "etag", "modified")]))).withColumn("hour", F.floor(F.col("t") / BUCKET)), "times")
    hours = times.groupBy("k", "hour").agg(F.max("r").alias("r"))
    past = Window.partitionBy("k").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("k", "hour", F.max("r").over(past).alias("carried"))
    inside = Window.partitionBy("k", "hour").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    found = times.withColumn("r", F.max("r").over(inside)).join(hours, ["k", "hour"]).select(F.col("k").alias("url_key"), F.col("t").alias("__t__"), F.coalesce("r", "carried").alias("__found__"))
    asks = placed & (F.col("status") == 304)
    revisits = attach(rows.filter(asks), found, ["url_key", "__t__"], "record_id")
    kind = found.schema["__found__"].dataType
    rows = rows.filter(~F.coalesce(asks, F.lit(False))).withColumn("__found__", F.lit(None).cast(kind)).unionByName(revisits)

    tag = lambda c: F.regexp_replace(c, "^W/", "")
    told, modified = F.col("headers")["etag"], F.col("headers")["last-modified"]
    same = F.when(told.isNotNull(), tag(told) == tag(F.col("__found__.etag"))).otherwise(modified == F.col("__found__.modified"))
    outcome = (
        F.when(F.col("status") == 200, "full")
        .when(F.col("status").isNull() | (F.col("status") != 304), "other")
        .when(F.col("__found__").isNull(), "no_earlier")
        .when(told.isNull() & modified.isNull(), "no_validator")
        .when(F.coalesce(same, F.lit(False)), "resolved")
        .otherwise("mismatch")
    )
    rows = rows.withColumn("outcome", outcome).withColumn("refers_to", F.when(F.col("outcome") == "resolved", F.col("__found__.id")))
    rows = rows.drop("__t__", "__found__")
    stored = captures.filter("status = 200 and record_id is not null").select(F.col("record_id").alias("refers_to"), F.col("headers").alias("__stored__"))
    rows = with_response(rows, stored.groupBy("refers_to").agg(F.first("__stored__", ignorenulls=True).alias("__stored__")))
    fresh = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*NOT_MERGED))
    kept = F.map_filter("__stored__", lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    return rows.withColumn("headers", F.when(F.col("__stored__").isNull(), F.col("headers")).otherwise(F.map_concat(kept, fresh))).drop("__stored__")


def with_response(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``stored`` (one row for each refers_to) where they refer to it.  Many rows may refer
    to one response: they meet it in parts; rows that refer to none take no part in the join."""
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in stored.schema if f.name != "refers_to"]
    found = attach(rows.filter("refers_to is not null"), stored, ["refers_to"], "record_id")
    return rows.filter("refers_to is null").select("*", *more).unionByName(found)


def restore(resolved: DataFrame) -> DataFrame:
    """Resolved captures with payload: a resolved revisit gets that of its response (and its status), the others keep
    theirs."""
    full = resolved.filter("outcome = 'full' and record_id is not null").groupBy(F.col("record_id").alias("refers_to")).agg(F.first("payload", ignorenulls=True).alias("__payload__"))
    rows = with_response(resolved, full)
    rows = rows.withColumn("payload", F.coalesce("__payload__", "payload")).withColumn("status", F.when(F.col("outcome") == "resolved", 200).otherwise(F.col("status")))
    return rows.drop("__payload__")
