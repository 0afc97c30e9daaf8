import gzip
import io
import random
import re

import duckdb
import pytest

from panelforge.llm import queries, warc

SCHEMA = "record_id string, url string, date string, status int, headers map<string,string>, outcome string, payload binary"


def key(url):
    m = re.match(warc._URL, url or "")
    if not m or not m[1]:
        return None
    host = re.sub(r"^www\.", "", re.sub(r":(80|443)$", "", m[1].lower()))
    kept = sorted(p for p in m[3].split("&") if p and not re.match(warc.TRACKING, p))
    return host + m[2].rstrip("/") + ("?" + "&".join(kept) if kept else "") if host else None


URLS = ["http://A.com/x", "https://www.a.com:443/x/#f", "//a.com/x?utm_source=1&b=2&a=1", "http://a.com/x?a=1&b=2", "http://a.com", "a.com/x", "", None, "ftp://b.org:80/?ref=1"]


def brute(rows):
    out = {}
    for rid, url, date, status, headers, *_ in rows:
        k, merged, refers = key(url), dict(headers), None
        if status == 200:
            what = "full"
        elif status != 304:
            what = "other"
        else:
            earlier = [r for r in rows if r[3] == 200 and k is not None and key(r[1]) == k and date and r[2] and r[2] < date]
            best = max(earlier, key=lambda r: (r[2], r[0]), default=None)
            tag, modified = headers.get("etag"), headers.get("last-modified")
            strip = lambda t: t and re.sub("^W/", "", t)
            if best is None:
                what = "no_earlier"
            elif tag is None and modified is None:
                what = "no_validator"
            elif (strip(tag) == strip(best[4].get("etag"))) if tag is not None else modified == best[4].get("last-modified"):
                what, refers = "resolved", best[0]
                merged = best[4] | {n: v for n, v in headers.items() if n not in warc.NOT_MERGED}
            else:
                what = "mismatch"
        out[rid] = (k, what, refers, merged)
    return out


@pytest.mark.parametrize("bucket", [3_600_000_000, 120_000_000])
def test_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(warc, "BUCKET", bucket)
    rng = random.Random(1)
    rows = []
    for k in range(500):
        status = rng.choice([200, 304, 304, 304, 404, None])
        headers = {n: v for n, v in (("etag", rng.choice(['"1"', 'W/"1"', '"2"'])), ("last-modified", rng.choice(["a", "b"])), ("content-length", str(k)), ("x", str(k))) if rng.random() < 0.6}
        date = None if rng.random() < 0.03 else f"2024-01-01T00:{rng.randrange(60):02}:{rng.randrange(3):02}Z"
        rows.append((f"r{k:04}", rng.choice(URLS[:4] * 4 + URLS), date, status, headers, "z", b"p%d" % k))
    df = spark.createDataFrame(rows, SCHEMA)
    resolved = warc.resolve(df)
    got = {r.record_id: (r.url_key, r.outcome, r.refers_to, r.headers) for r in resolved.collect()}
    assert got == brute(rows)
    whole = {r.record_id: (bytes(r.payload), r.status) for r in warc.restore(resolved).collect()}
    for rid, _, _, status, _, _, body in rows:
        refers = got[rid][2]
        assert whole[rid] == ((b"p%d" % int(refers[1:]), 200) if refers else (body, status))
    assert warc.resolve(df.limit(0)).count() == 0


def test_records_round_trip(spark, tmp_path):
    rows = [("response", "<urn:1>", "http://a/é", "2024-01-01T00:00:00Z", 200, {"etag": '"x"'}, b"a\r\n\r\nb\x00"), ("revisit", "<urn:2>", "http://a/", "2024-01-01T00:00:01Z", 304, {}, b"")]
    df = spark.createDataFrame(rows, warc._ROW)
    content = [bytes(r.content) for r in warc.render(df).collect()]
    assert warc.NOT_MODIFIED.encode() in content[1] and warc.NOT_MODIFIED.encode() not in content[0]
    (tmp_path / "a.warc").write_bytes(b"".join(content))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, content)))
    got = sorted(map(tuple, warc.read(spark, str(tmp_path)).collect()), key=str)
    assert [g[:6] + (bytes(g[6]),) for g in got] == sorted([r for r in rows for _ in range(2)], key=str)


def test_odd_records():
    raw = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\nX: a\r\n b\r\n\r\nabc\r\n\r\n"
    (r,) = warc.records(io.BytesIO(raw))
    assert (r["kind"], r["payload"], r["status"]) == ("warcinfo", b"abc", None)
    rows = list(warc.records(io.BytesIO(raw[:-6])))
    assert [r["kind"] for r in rows] == [warc.UNREADABLE] and b"ends early" in rows[0]["payload"]


def test_what_is_unreadable_leaves_the_rest():
    good = warc.record("response", "<urn:1>", "http://a/", "2024-01-01T00:00:00Z", 200, {"etag": '"x"'}, b"body")
    bad = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nsome body\r\n\r\n"
    none = b"WARC/1.1\r\nWARC-Type: response\r\n\r\n"
    for raw, want in ((bad + good, [warc.UNREADABLE, "response"]), (b"junk\njunk\n" + good, [warc.UNREADABLE, "response"]), (good + none + good, ["response", warc.UNREADABLE, "response"]), (b"", []), (good + bad, ["response", warc.UNREADABLE])):
        assert [r["kind"] for r in warc.records(io.BytesIO(raw))] == want
    zipped = gzip.compress(good) + gzip.compress(good)[:-12]
    assert [r["kind"] for r in warc.records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(zipped))))][-1] == warc.UNREADABLE
    odd = warc.record("response", "<urn:1>", "http://a/", "d", 200, {}, b"").replace(b"HTTP/1.1 200", b"HTTP/1.1 2x0")
    assert next(warc.records(io.BytesIO(odd)))["status"] is None


def test_nulls_in_any_column(spark):
    rows = [(None, None, None, None, None, None, None), ("revisit", None, "http://a/", "2024-01-01T00:00:01Z", 304, None, None), ("response", "<1>", "http://a/", "2024-01-01T00:00:00Z", 200, None, b"x"), ("response", "<2>", "http://a/", None, 200, {"etag": None, "a": "b\r\nc"}, b"x")]
    df = spark.createDataFrame(rows, warc._ROW)
    back = warc.parse(warc.render(df)).collect()
    assert sorted((r.kind or "", r.status, len(r.headers)) for r in back) == [("", 0, 0), ("response", 200, 0), ("response", 200, 1), ("revisit", 304, 0)]
    assert sorted(r.outcome for r in warc.resolve(df).collect()) == ["full", "full", "no_validator", "other"]
    assert warc.parse(spark.createDataFrame([(None,), (b"",)], "content binary")).count() == 0


def test_query_against_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(queries.OP6_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, queries.op6_warc(spark, sf).select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)
