import base64
import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
import public_tokenizers
import tiktoken

from tests.llm.test_minhash import brute
from tests.llm.test_mixing import level


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "x", 0), (9002, "", "en", "x", 0), (9003, "12 34 !!", "en", "x", 8), (9004, "12 34 !!", None, None, 8)], docs.schema)
    docs = docs.unionByName(extra).withColumn("score", docs.n_chars)
    rows = {r.doc_id: r for r in docs.collect()}

    got = cp.language(spark, docs, sf)
    assert got.columns == docs.columns
    kept = {r.doc_id for r in got.collect()}
    assert kept == set(range(200))

    got = cp.exact_copies(spark, got, sf)
    groups = defaultdict(list)
    for d in kept:
        groups[re.sub(r"[\x20\x09-\x0D]", "", rows[d].text)].append((-len(rows[d].text), d))
    kept = {min(g)[1] for g in groups.values()}
    assert sorted(r.doc_id for r in got.collect()) == sorted(kept) and got.columns == docs.columns

    got = cp.near_copies(spark, got, sf)
    classes = brute([(d, rows[d].text) for d in kept])
    kept = set(classes.values())
    assert sorted(r.doc_id for r in got.collect()) == sorted(kept) and got.columns == docs.columns

    got = cp.mixture(spark, got, sf)
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", rows[d].text)) for d in kept}
    totals = defaultdict(int)
    for d in kept:
        totals[rows[d].source] += size[d]
    times = Counter(r.doc_id for r in got.collect())
    assert set(times) <= kept and max(times.values()) <= 2 and got.columns == docs.columns
    for source, target in level(totals).items():
        own = [d for d in kept if rows[d].source == source]
        taken = sum(times[d] * size[d] for d in own)
        assert target - 1 <= taken < target + max(size[d] for d in own)

    got = cp.tokens(spark, got, sf).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(cp.RANKS), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Counter(r.doc_id for r in got) == times
    assert all(r.round_trip and r.ids == library.encode_ordinary(rows[r.doc_id].text) for r in got)


def test_empty_tables_pass_all_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_names_and_run(spark, sf):
    assert [n for n, _ in cp.STAGES] == ["language ID", "exact dedup", "near-dedup", "mixing", "encoding"]
    assert cp.run(spark, sf).count() > 100


def test_texts_of_other_languages_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    foreign = [r for r in docs.filter("lang = 'de'").collect() if len(r.text) > 200]
    japanese = (9001, "これは日本語の文章です。" * 20, None, "x", 240)
    others = docs.filter("lang != 'de'")
    known = others.count()
    rows = spark.createDataFrame([(9100 + k, r.text, None, r.source, r.n_chars) for k, r in enumerate(foreign)] + [japanese], docs.schema)
    kept = [r.doc_id for r in cp.language(spark, others.unionByName(rows), sf).collect()]
    assert 9001 not in kept
    assert sum(d > 9001 for d in kept) <= 0.2 * len(foreign) and sum(d < 9001 for d in kept) >= 0.98 * known


def test_documents_without_labels_stay(spark):
    rows = [(1, "some words", None), (2, "日本", None), (3, "12 !?", None), (4, None, None), (5, "", None)]
    got = cp.language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 2]
