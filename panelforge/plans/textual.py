"""Queries: text normal forms, quotes, numbers, labels, nearest vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import vectors
from .base import table

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


#: What stands in printed text, after each document: quotes, dashes, a ligature, blanks before marks, a broken word.
PRINTED = " “a” – b −6 ⁃ ′\nﬁn ‘c’ , so-\n  called x ."
_SQL_PRINTED = "' “a” – b −6 ⁃ ′' || chr(10) || 'ﬁn ‘c’ , so-' || chr(10) || '  called x .'"
# written from the rules in the text, not from the module's lists; NFC is NFKC for the tables' texts
_L1 = r"""trim(regexp_replace(trim(regexp_replace(
  translate(replace(replace(replace(replace(replace(t, chr(64256), 'ff'), chr(64257), 'fi'), chr(64258), 'fl'), chr(64259), 'ffi'), chr(64260), 'ffl'),
    chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(8208) || chr(8209) || chr(8210) || chr(8211) || chr(8212) || chr(8213) || chr(8259) || chr(8722), '''''""--------'),
  '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')), ' ([.,;:)])', '\1', 'g'))"""


@query(f"SELECT doc_id, md5({_L1}) AS digest FROM (SELECT doc_id, text || {_SQL_PRINTED} AS t FROM documents)")
def text_normalise(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit(PRINTED)).alias("t"))
    return rows.select("doc_id", F.md5(text.normalise(F.col("t"), "L1", compatibility=False)).alias("digest"))


# without look-ahead, words of one letter between two hyphens need a second pass
_JOIN = r"regexp_replace({}, '([\pL\pN_])- +([\pL\pN_])', '\1\2', 'g')"


@query(f"SELECT doc_id, md5({_JOIN.format(_JOIN.format(_L1))}) AS digest FROM (SELECT doc_id, nfc_normalize(text || {_SQL_PRINTED}) AS t FROM documents)")
def text_normalise_full(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit(PRINTED)).alias("t"))
    return rows.select("doc_id", F.md5(text.normalise(F.col("t"), "L2")).alias("digest"))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page FROM documents),
l AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY page) AS after FROM p),
q AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN substr(line0, 1, 25) WHEN 1 THEN line0 || ' ' || substr(line1, 1, 8) WHEN 2 THEN 'nowhere to be found' ELSE '' END AS quote
  FROM (SELECT doc_id, string_split(text, chr(10))[1] AS line0, coalesce(string_split(text, chr(10))[2], '') AS line1 FROM documents)),
f AS (SELECT q.doc_id, page, CASE WHEN contains(line, quote) THEN 0 WHEN contains(line || coalesce(' ' || after, ''), quote) THEN 1 END AS kind FROM q JOIN l USING (doc_id) WHERE quote <> ''),
b AS (SELECT doc_id, min(struct_pack(kind := kind, page := page)) AS best FROM f WHERE kind IS NOT NULL GROUP BY 1)
SELECT q.doc_id AS quote_id, q.doc_id, best.page::INT AS page, best.kind = 1 AS seam FROM q LEFT JOIN b USING (doc_id)""")
def locate_quote(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    lines = F.split("text", "\n")
    pages = documents.select("doc_id", F.posexplode(lines).alias("page", "line"))
    first, second = F.get(lines, 0), F.coalesce(F.get(lines, 1), F.lit(""))
    kind = F.col("doc_id") % 4
    quote = F.when(kind == 0, F.substring(first, 1, 25)).when(kind == 1, F.concat(first, F.lit(" "), F.substring(second, 1, 8))).when(kind == 2, "nowhere to be found").otherwise("")
    quotes = documents.select(F.col("doc_id").alias("quote_id"), "doc_id", quote.alias("quote"))
    return text.locate_quotes(pages, quotes, "doc_id", "page", "line", "quote_id", "quote")


@query(r"""WITH x AS (SELECT doc_id, regexp_extract_all(text || ' about 227.50% or 5.55 or -2e0, v1.3', '(?:^|[^\pL\pN_.])([+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?%?)', 1) AS tokens FROM documents),
t AS (SELECT doc_id, unnest(tokens) AS token FROM x),
c AS (SELECT DISTINCT token, replace(token, '%', '')::DOUBLE AS v, CASE WHEN regexp_matches(token, '[eE]') THEN 12 ELSE length(regexp_extract(token, '\.([0-9]+)', 1)) END AS d FROM t),
k AS (SELECT token, v, d FROM c UNION ALL SELECT token, v / 100, d + 2 FROM c WHERE suffix(token, '%')),
ok AS (SELECT DISTINCT token FROM k, (SELECT unnest([1.0, -2.0, 3.0, 2.275, 5.55]::DOUBLE[]) AS r) WHERE abs(r - v) <= 0.5 * pow(10, -d) + 1e-9 * (1 + abs(v))),
n AS (SELECT doc_id, count(*) AS n_verified FROM t JOIN ok USING (token) GROUP BY 1)
SELECT doc_id, len(tokens)::INT AS n, coalesce(n_verified, 0)::INT AS n_verified, array_to_string(tokens, ' ') AS tokens FROM x LEFT JOIN n USING (doc_id)""")
def number_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in every document, and how many of them are in a report of a few."""
    tokens = text.number_tokens(F.concat("text", F.lit(" about 227.50% or 5.55 or -2e0, v1.3")))
    rows = table(spark, sf, "documents").select("doc_id", tokens.alias("tokens"))
    report = F.array(*[F.lit(k) for k in (1.0, -2.0, 3.0, 2.275, 5.55)])
    return rows.select("doc_id", F.size("tokens").alias("n"), F.size(F.filter(text.verified(F.col("tokens"), report), lambda v: v)).alias("n_verified"), F.array_join("tokens", " ").alias("tokens"))


@query(r"""WITH t AS (SELECT conv_id, turn, text || chr(10) || '> quoted 12' || chr(10) || 'a `code 7` b ```' || chr(10) || 'x = 3' || chr(10) || '``` end' AS t FROM conversations)
SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(t, '(?s)```.*?```', ' ', 'g'), '`[^`\n]*`', ' ', 'g'), '(?m)^\s*>.*$', ' ', 'g')) AS digest FROM t""")
def strip_code(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.concat("text", F.lit("\n> quoted 12\na `code 7` b ```\nx = 3\n``` end")).alias("t"))
    return rows.select("conv_id", "turn", F.md5(text.strip_code(F.col("t"))).alias("digest"))


@query(r"""SELECT p_partkey, trim(regexp_replace(lower(trim(' ' || p_brand || '** ')), '\*+$', '')) AS label, nullif(trim(CASE WHEN p_size % 3 = 0 THEN '  ' ELSE p_type END), '') AS kind FROM part""")
def label_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part")
    return rows.select("p_partkey", text.label_key(F.concat(F.lit(" "), "p_brand", F.lit("** "))).alias("label"), text.null_if_blank(F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.col("p_type"))).alias("kind"))


@query(r"""WITH v AS (SELECT p_partkey, p_size::VARCHAR || CASE p_partkey % 5 WHEN 0 THEN ' months' WHEN 1 THEN '-month' WHEN 2 THEN '.0' WHEN 3 THEN '.5' ELSE '' END AS n, ' ' || upper(p_type) || '-X ' AS t, CASE p_partkey % 3 WHEN 0 THEN '2004-07' WHEN 1 THEN '2004-13' END AS m FROM part)
SELECT p_partkey, CASE WHEN n NOT LIKE '%.5' THEN regexp_extract(n, '^(-?[0-9]+)', 1) END AS number, lower(replace(replace(trim(t), ' ', '_'), '-', '_')) AS token, CASE WHEN p_partkey % 3 = 0 THEN m END AS month,
  CASE WHEN p_partkey % 3 = 0 THEN true WHEN p_partkey % 3 = 2 THEN false END AS match, CASE WHEN p_partkey % 3 = 1 THEN 'found_unnormalisable' ELSE 'comparable' END AS status FROM v""")
def value_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Fields' values in the forms in which they are compared, and a comparison that may have no answer."""
    k = F.col("p_partkey")
    number = F.concat(F.col("p_size").cast("string"), F.when(k % 5 == 0, " months").when(k % 5 == 1, "-month").when(k % 5 == 2, ".0").when(k % 5 == 3, ".5").otherwise(""))
    month = F.when(k % 3 == 0, "2004-07").when(k % 3 == 1, "2004-13")
    rows = table(spark, sf, "part").select(k, text.value_form(number, "int").alias("number"), text.value_form(F.concat(F.lit(" "), F.upper("p_type"), F.lit("-X ")), "token").alias("token"), text.value_form(month, "month").alias("month"), text.compare_values(F.lit(" 2004-07 "), month, "month").alias("c"))
    return rows.select("p_partkey", "number", "token", "month", "c.match", "c.status")


@query()
def relocated_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages with a changed word, found again among the passages as pages."""
    rows = table(spark, sf, "benchmark").select("item_id", "text", (F.col("item_id") % 20).alias("doc"))
    quotes = rows.filter("item_id % 7 = 0").select(F.col("item_id").alias("quote_id"), "doc", F.concat(F.substring("text", 1, 60), F.lit(" changed "), F.substring("text", 70, 60)).alias("quote"))
    return text.relocate(rows, quotes, "doc", "item_id", "text", "quote_id", "quote", bar=0.8)


@query()
def quote_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """How alike each benchmark passage is to the next one, and the longest block that they share."""
    rows = table(spark, sf, "benchmark")
    after = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    both = rows.join(after, "item_id")
    return both.select("item_id", F.round(text.similarity_ratio(F.col("text"), F.col("other")), 8).alias("ratio"), text.common_block(F.col("text"), F.col("other")).alias("block"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) + 1e-12 AS norm FROM e),
s AS (SELECT q.vec_id AS query, n.vec_id AS neighbour, ROUND(list_inner_product(q.v, n.v) / (q.norm * n.norm), 9) AS similarity FROM n q, n WHERE q.vec_id % 50 = 0 AND q.vec_id <> n.vec_id)
SELECT query, neighbour, similarity FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) <= 5""")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(rows.filter("vec_id % 50 = 0"), rows, "vec_id", "vec_id", "embedding", 5)
