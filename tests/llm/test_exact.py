import hashlib
import random
import re
from collections import defaultdict

import duckdb
import xxhash

from panelforge.llm import exact, queries


def brute(rows):
    groups = defaultdict(list)
    for k, (doc, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc if doc is not None else 0, k))
    out = []
    for bare, members in groups.items():
        best = min(members)
        for _, none, doc, k in members:
            out.append((None if none else doc, None if best[1] else best[2], len(members), k == best[3], hashlib.sha256(bare.encode()).hexdigest()))
    return out


def key(rows):
    return sorted(rows, key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    long = "".join(rng.choices("abc é", k=30000))
    texts = ["", None, " ", "a b", "ab", "a\tb ", "a\x0bb", "a b", long, long + "x", long[:4096], long[:4096] + " ", long[:-1], long + " ", "x" * 4096, "x" * 8192, "x" * 12288]
    rows = [(k, rng.choice(texts)) for k in range(300)] + [(5, "ab"), (5, "ab"), (None, "ab"), (None, None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, name string")
    got = exact.exact_dedup(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    plain = lambda rs: key((r[0], r[1], r[2], r[4]) for r in rs)
    want = brute(rows)
    assert plain(got) == plain(want)
    kept = lambda rs: key((r[0], r[4]) for r in rs if r[3])
    assert kept(got) == kept(want)
    stay = exact.kept_rows(df)
    assert stay.columns == df.columns
    assert key((r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r.text or "").encode()).hexdigest()) for r in stay.collect()) == kept(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact.exact_dedup(df).count() == 0 and exact.kept_rows(df).count() == 0


def test_names_do_not_trust_hashes(spark, monkeypatch):
    class Same:
        xxh64_intdigest = staticmethod(lambda x, seed: 7)

    df = spark.createDataFrame([(k, "t" * (k % 3) + "u" * 5000) for k in range(30)], "doc_id long, text string")
    parts = exact._emit.__globals__
    monkeypatch.setitem(parts, "xxhash", Same)
    assert {r.group_size for r in exact.exact_dedup(df).collect()} == {10}


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 9, 9, True, 9, "n"), (2, "a ", 9, 9, True, 9, "n")], "doc_id long, text string, keep_id int, group_size int, kept boolean, best int, name string")
    got = exact.exact_dedup(df).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 2, 2, False), (2, 2, 2, True)]
    assert [tuple(r) for r in exact.kept_rows(df).collect()] == [(2, "a ", 9, 9, True, 9, "n")]


def test_items_of_many_chunks_are_named_apart(spark, monkeypatch):
    monkeypatch.setattr(exact, "HOT_ROWS", 20)
    monkeypatch.setattr(exact, "CHUNK_BYTES", 20_000)
    rng = random.Random(2)
    blocks = ["".join(rng.choices("abcdef", k=4096)) for _ in range(3)]
    rows = [(k, "".join(rng.choices(blocks, k=rng.randrange(1, 5))) + rng.choice(["", "x"])) for k in range(150)] + [(1000 + k, "hot") for k in range(100)]
    got = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert key((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == key(brute(rows))


def test_hot_blocks_are_those_of_the_chunks(spark, monkeypatch):
    monkeypatch.setattr(exact, "HOT_ROWS", 2)
    long = "é b" * 3000
    df = spark.createDataFrame([(t,) for t in ["a b", "ab", "a\tb", None, "", " ", long, long + "x", long + "y", "z"]], "t string")
    bare = re.sub(r"[\x20\x09-\x0D]", "", long).encode()
    want = {xxhash.xxh64_intdigest(x, 42) for x in (b"ab", b"", bare[:4096], bare[4096:8192])}
    assert {r.route % 2**64 for r in exact._hot_blocks(df, "t").collect()} == want
    assert exact._hot_blocks(df.limit(2), "t") is None


def test_any_column_names_stay(spark):
    names = ["doc_id", "text", "__key__", "__rows__", "id", "h", "key", "stay", "n", "c0", "a.b"]
    df = spark.createDataFrame([(1, "a", *range(9)), (1, "a", *range(9)), (1, "a ", *range(9)), (2, None, *[None] * 9), (None, "", *range(9))], ", ".join(f"`{n}` {'string' if n == 'text' else 'long'}" for n in names))
    got = exact.kept_rows(df)
    assert got.columns == names and sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a ", *range(9)), (2, None, *[None] * 9)], key=str)


def test_of_repeated_rows_as_many_stay_as_are_kept(spark):
    rows = [(1, "a", x) for x in "xxyyz"]
    df = spark.createDataFrame(rows, "doc_id long, text string, more string")
    one = exact.kept_rows(df).collect()
    assert len(one) == 1 and one == exact.kept_rows(df.repartition(3)).collect()
    decided = spark.createDataFrame([(1, True)] * 3 + [(1, False)] * 2, "id long, kept boolean").crossJoin(df.limit(1).selectExpr("xxhash64(text) h"))
    assert exact.stay_rows(df, decided, "text", "doc_id").count() == 3


def test_query_against_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.op5_exact_dedup(spark, sf).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.OP5_SQL).fetchall())
