"""The queries of the training-data operators over whole tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, langid, minhash, mixing, quality, secrets, sharding, syncmers, warc
from ._store import durable

RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """Whether a document is held out of what is learned."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again; digests of both."""
    path = public_tokenizers.path(RANKS)
    rows = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded="decoded")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.joined(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of near-duplicates."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("row_hash", "n_links")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes of each document."""
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
         source_size * 2.0::DOUBLE AS cap
  FROM totals),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, least(cap, (SELECT max(level) FROM levels WHERE level * w <= cap) * w) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM placed
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every whole text, learned from the labelled rows that aren't held out."""
    fold = (F.crc32(F.col("doc_id").cast("string")) % 5).cast("int").alias("fold")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", fold)
    rows = quality.classify(documents, table(spark, sf_dir, "labels"), "fold")
    return rows.select("doc_id", (F.col("fold") == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its group of equal texts."""
    rows = exact.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(t) AS text_sha256
FROM bare
WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
"""

def page_captures(pages: DataFrame) -> DataFrame:
    """A crawl of ``pages``: page n is fetched in full in second 2n, and asked for again, with a 304 for an answer, at
    an odd second: one later, or after 1,000 or 2,000 other pages, or, for one in 25, before it was fetched.  Some
    answers have an old ETag, some only a Last-Modified, some nothing to check by."""
    n = F.col("page_id")
    second = lambda s: F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + s), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    payload = F.coalesce("html", F.lit("")).cast("binary")
    pairs = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k.replace("_", "-")), v if isinstance(v, Column) else F.lit(v))])
    full = pairs(content_type="text/html", content_length=F.octet_length(payload).cast("string"), etag=tag, last_modified=second(n), cache_control="max-age=60", server="s1")
    again = F.when(n % 10 == 7, pairs(etag='"old"', cache_control="max-age=120", content_length="0"))
    again = again.when(n % 10 == 3, pairs(last_modified=second(n), cache_control="max-age=120", content_length="0"))
    again = again.when(n % 10 == 9, pairs(cache_control="max-age=120", content_length="0"))
    again = again.otherwise(pairs(etag=F.concat(F.lit("W/"), tag), cache_control="max-age=120", content_length="0", content_type="text/plain"))
    later = F.when(n % 25 == 4, 2 * n - 1).otherwise(2 * n + 1 + 2000 * (n % 3))
    of = lambda kind, k, date, status, headers, body, url: pages.select(F.lit(kind).alias("kind"), (2 * n + k).cast("string").alias("record_id"), url.alias("url"), second(date).alias("date"), F.lit(status).alias("status"), headers.alias("headers"), body.alias("payload"))
    return of("response", 0, 2 * n, 200, full, payload, F.col("url")).unionByName(of("revisit", 1, later, 304, again, F.lit(b""), F.concat("url", F.lit("#again"))))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of all pages written as WARC records, read back, and its not-modified revisits resolved."""
    written = warc.render(page_captures(table(spark, sf_dir, "pages")))
    read = warc.parse(written).withColumn("payload_sha256", F.sha2("payload", 256)).drop("payload")
    found = warc.resolve(durable(read, "captures"))
    number = F.col("record_id").cast("long")
    found = durable(found, "resolved")
    found = warc.with_response(found, found.filter("outcome = 'full'").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("payload_sha256").alias("full_sha256")))
    return found.select(
        number.alias("record_id"), F.expr("record_id div 2").cast("long").alias("page_id"), "url_key", "outcome", F.col("refers_to").cast("long").alias("refers_to"),
        *[F.col("headers")[k].alias(k.replace("-", "_")) for k in ("etag", "cache-control", "content-type", "content-length", "server")],
        F.coalesce("full_sha256", "payload_sha256").alias("payload_sha256"),
    )


OP6_SQL = r"""
WITH parts AS (
  SELECT page_id AS n, coalesce(html, '') AS html,
         regexp_replace(regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)\??([^#]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
         regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)\??([^#]*)', 2), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)\??([^#]*)', 3), '&'),
                               lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)='))) AS q
  FROM pages),
base AS (
  SELECT n, html, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key,
         '"' || substr(md5(html), 1, 16) || '"' AS tag FROM parts),
full_ AS (SELECT 2 * n AS id, n, url_key, 2 * n AS t, tag, html FROM base),
again AS (
  SELECT 2 * n + 1 AS id, n, url_key, CASE WHEN n % 25 = 4 THEN 2 * n - 1 ELSE 2 * n + 1 + 2000 * (n % 3) END AS t,
         CASE WHEN n % 10 = 7 THEN '"old"' WHEN n % 10 IN (3, 9) THEN NULL ELSE tag END AS tag,
         CASE WHEN n % 10 = 3 THEN 2 * n END AS modified,
         CASE WHEN n % 10 IN (3, 7, 9) THEN NULL ELSE 'text/plain' END AS kind
  FROM base),
found AS (
  SELECT a.*, f.id AS fid, f.tag AS ftag, f.t AS ft, f.html AS fhtml,
         CASE WHEN f.id IS NULL THEN 'no_earlier' WHEN a.tag IS NULL AND a.modified IS NULL THEN 'no_validator'
              WHEN CASE WHEN a.tag IS NOT NULL THEN a.tag = f.tag ELSE a.modified = f.t END THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM again a ASOF LEFT JOIN full_ f ON a.url_key = f.url_key AND a.t > f.t)
SELECT id::BIGINT AS record_id, n::BIGINT AS page_id, url_key, 'full' AS outcome, NULL::BIGINT AS refers_to, tag AS etag, 'max-age=60' AS cache_control,
       'text/html' AS content_type, strlen(html)::VARCHAR AS content_length, 's1' AS server, sha256(html) AS payload_sha256
FROM full_
UNION ALL
SELECT id, n, url_key, outcome, CASE WHEN outcome = 'resolved' THEN fid END,
       CASE WHEN outcome = 'resolved' AND tag IS NULL THEN ftag WHEN tag = '"old"' THEN tag ELSE 'W/' || tag END, 'max-age=120',
       CASE WHEN outcome = 'resolved' THEN 'text/html' ELSE kind END,
       CASE WHEN outcome = 'resolved' THEN strlen(fhtml)::VARCHAR ELSE '0' END, CASE WHEN outcome = 'resolved' THEN 's1' END,
       CASE WHEN outcome = 'resolved' THEN sha256(fhtml) ELSE sha256('') END
FROM found
"""


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose row counts differ by one at most, equal texts together."""
    rows = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return rows.withColumn("grown_shard", F.lit(None).cast("int"))


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document."""
    rows = syncmers.compare_with_edits(table(spark, sf_dir, "documents"))
    shown = {n: syncmers.as_string(F.col(c)).alias(n) for n, c in (("fingerprint", "found"), ("edited_fingerprint", "edited_found"))}
    return rows.select("doc_id", "n_chars", "edited_sha256", *shown.values(), "near_edited", "near_next")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the rows that aren't held out."""
    documents = table(spark, sf_dir, "documents")
    model = langid.train(documents.filter(~held_out()))
    rows = documents.select("doc_id", "text", held_out().alias("held_out"))
    return langid.predict(rows, model, keep=["doc_id", "held_out"])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text; n_measured has the values and candidates whose novelty was measured, most_novel the
    greatest share of random strings' novelty among them (null if there are none)."""
    rows = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    spans = F.filter("spans", lambda s: s["kind"].isNotNull())
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", *map(count, secrets.KINDS), F.sha2(secrets.as_string(base), 256).alias("base_sha256"), secrets.as_string(spans).alias("spans"),
        F.size("spans").cast("long").alias("n_measured"), F.round(F.array_max(F.col("spans")["share"]), 6).alias("most_novel"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_minhash": op2_minhash,
    "op3_mix": op3_mix,
    "op4_quality": op4_quality,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_warc": op6_warc,
    "op7_shards": op7_shards,
    "op8_syncmers": op8_syncmers,
    "op9_langid": op9_langid,
    "op10_secrets": op10_secrets,
}

ORACLES: dict[str, str] = {
    "op3_mix": OP3_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op6_warc": OP6_SQL,
}
