import random
import re
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from panelforge.llm import mixing, queries

TEXTS = ["", None, " ", "a", " a", "a ", "a b", "\ta\n\x0bb\x0c c\r", "a b", "x " * 50, "  ", "a\x85b c"]


def test_word_count(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, text string")
    got = {r.k: r.n for r in df.select("k", mixing.word_count(F.col("text")).alias("n")).collect()}
    assert got == {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in enumerate(TEXTS)}


def level(totals):
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, target, free = 1.5 * sum(totals.values()), {}, set(names)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > 2 * totals[s]}
        if not over:
            return target | {s: unit * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * totals[s]
            left -= target[s]
        free -= over
    return target


def test_mix_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["hot"] * 6 + ["b", "a", "é", "Z", None, "zero"]), "w " * rng.randrange(0, 30), 1) for k in range(900)]
    rows = [(k, s, "" if s == "zero" else t, x) for k, s, t, x in rows] + [(5, "a", "w w", 1), (5, "a", "w w", 1), (None, "b", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, taken int")
    got = mixing.mix_documents(df).collect()
    totals = defaultdict(int)
    for _, s, t, _ in rows:
        totals[s] += len((t or "").split())
    want = level(totals)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == totals[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert {s: int(want[s] + 1e-9) for s in totals} == dict(taken)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_documents(df.repartition(7)).collect()), key=str)
    out = mixing.mixed_rows(df.drop("taken")).groupBy("doc_id", "source").count().collect()
    whole = defaultdict(int)
    for r in got:
        whole[r.doc_id, r.source] += -(-r.taken // r.size) if r.size else 0
    assert {(r.doc_id, r.source): r["count"] for r in out} == {k: v for k, v in whole.items() if v}


def test_buckets_join_up(spark, monkeypatch):
    monkeypatch.setattr("panelforge.llm._prefix.BUCKET_ROWS", 16)
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 7).alias("size"))
    got = mixing.mix(df, "size", share=1.3).agg(F.sum("taken"), F.max("target")).first()
    assert got[0] == int(got[1])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix_documents(df).count() == 0 and mixing.mixed_rows(df).count() == 0


def test_equal_rows_of_which_some_are_taken(spark):
    rows = [(1, "s", "a b c d")] * 5 + [(k, "t", "w " * 50) for k in range(2, 6)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    options = {"weights": (0.2, 5.0), "share": 0.5}
    taken = sum(-(-r.taken // r.size) for r in mixing.mix_documents(df, **options).collect() if r.taken and r.source == "s")
    assert 0 < taken < 5
    assert mixing.mixed_rows(df, **options).filter("source = 's'").count() == taken


def test_any_column_names_stay(spark):
    names = ["doc_id", "source", "text", "__row_hash__", "__copies__", "__rows__", "id", "of", "h", "key", "copy", "c0"]
    rows = [(k, "s", "a b c", *[k] * 9) for k in range(20)] + [(3, "s", "a b c", *[3] * 9)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n in ('source', 'text') else 'long'}" for n in names))
    got = mixing.mixed_rows(df)
    assert got.columns == names and {tuple(r) for r in got.collect()} <= set(rows)


def test_query_against_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.op3_mix(spark, sf).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.OP3_SQL).fetchall())
