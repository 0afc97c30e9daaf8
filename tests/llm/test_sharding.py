import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelforge.llm import _prefix, queries, sharding

SCHEMA = "doc_id long, text string, shard string"


def texts():
    rng = random.Random(9)
    rows = ["hot"] * 400 + [f"single {k} " + "x" * rng.randrange(200) for k in range(500)]
    for k in range(150):
        rows += [f"group {k} " + "y" * rng.randrange(200)] * rng.choice([2, 2, 3, 5, 9])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_quotas_and_cuts(spark, law):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(k, t, "s") for k, t in rows], SCHEMA)
    got = sharding.shard_documents(df, shards=10, law=law).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {law}
    by_id = {r.doc_id: r for r in got}
    load, slots, groups = Counter(), defaultdict(list), defaultdict(Counter)
    for k, t in rows:
        r = by_id[k]
        assert (r["size"], r.text_crc32) == (len(t.encode()) + 16, zlib.crc32(t.encode()))
        load[r.shard] += 1 if law == "rows" else r["size"]
        slots[r.shard].append(r.slot)
        groups[t][r.shard] += 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(load) == 10
    spread = max(load.values()) - min(load.values())
    assert spread <= (1 if law == "rows" else 2 * max(r["size"] for r in got))
    apart = sum(len(g) > 1 for t, g in groups.items() if t != "hot")
    assert apart <= 9
    if law == "rows":
        assert len(groups["hot"]) <= 6  # 400 of 1,500 rows: over two quotas


def brute_cut(rows):
    """Links and cut links of (group, shard) rows, pair by pair."""
    by = defaultdict(list)
    for g, s in rows:
        by[g].append(s)
    pairs = [(a, b) for ss in by.values() for k, a in enumerate(ss) for b in ss[:k]]
    return len(pairs), sum(a != b for a, b in pairs)


def test_query_unites_equal_documents(spark):
    sf = "/root/testdata/sf0.01"
    documents = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    got = queries.op7_shards(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(documents)
    count, slots = Counter(r.shard for r in got), defaultdict(list)
    assert set(count) == set(range(40)) and max(count.values()) - min(count.values()) <= 1
    for r in got:
        data = (documents[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    copies = Counter(documents.values())
    assert all((r.start_shard is None) == (copies[documents[r.doc_id]] == 1) for r in got)
    linked = [r for r in got if r.start_shard is not None]
    links, before = brute_cut([(documents[r.doc_id], r.start_shard) for r in linked])
    _, after = brute_cut([(documents[r.doc_id], r.shard) for r in linked])
    assert before > 0.9 * links and after <= 0.05 * links  # the start knows nothing of links
    frame = spark.createDataFrame([(documents[r.doc_id] and zlib.crc32(documents[r.doc_id].encode()), r.start_shard, r.shard) for r in linked], "link long, a int, b int")
    for shard, cut in (("a", before), ("b", after)):
        assert tuple(sharding.cut_links(frame, "link", shard).first()) == (links, cut)


def test_prefix_sums_in_two_levels(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, rng.randrange(2**60), rng.randrange(5), rng.choice(["a", "b", None]), 7) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, key long, v long, g string, n int")
    for level in (4096, 4):
        monkeypatch.setattr(_prefix, "BUCKET_ROWS", 20)
        monkeypatch.setattr(_prefix, "LEVEL_ROWS", level)
        for group in ([], ["g"]):
            got = {r.id: r.out for r in _prefix.prefix_sums(df, group, [F.col("key"), F.col("id")], "key", "v", "out").collect()}
            sums, want = Counter(), {}
            for k, _, v, g, _ in sorted(rows, key=lambda r: (r[1], r[0])):
                want[k] = sums[g if group else 0]
                sums[g if group else 0] += v
            assert got == want


def test_reruns_agree(spark):
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts()[:300])], SCHEMA)
    first, second = ({r.doc_id: (r.shard, r.slot) for r in sharding.shard_documents(x).collect()} for x in (df, df.repartition(7)))
    assert first == second


def test_propagation_unites_scattered_groups(spark):
    rng = random.Random(3)
    rows = [(k, k // 4, rng.randrange(2**60), 1, rng.randrange(5)) for k in range(400)]
    state = spark.createDataFrame(rows, "uid long, link long, key long, weight long, shard int")
    out = sharding.propagate(state, [100] * 5, 8).collect()
    cut = lambda rs: sum(len(s) > 1 for s in groups(rs).values())

    def groups(rs):
        found = defaultdict(set)
        for r in rs:
            found[r[1]].add(r[4])
        return found

    assert cut([(r.uid, r.link, 0, 0, r.shard) for r in out]) < cut(rows) and max(Counter(r.shard for r in out).values()) <= max(100, max(Counter(r[4] for r in rows).values()))


def test_edges(spark):
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, None, "s"), (1, None, "s"), (None, "", "s"), (2, "é", "s")], SCHEMA)
    got = sharding.shard_documents(df).collect()
    assert sorted((r["size"], r.text_crc32) for r in got) == [(16, 0)] * 3 + [(18, zlib.crc32("é".encode()))]
    assert sorted(r.shard for r in got) == [0, 1, 2, 3]
    all_linked = spark.createDataFrame([(k, "t", "s") for k in range(90)], SCHEMA)
    assert sorted(Counter(r.shard for r in sharding.shard_documents(all_linked).collect()).values()) == [2] * 30 + [3] * 10


def test_clashing_names(spark):
    df = spark.createDataFrame([(k, 1, "w", 5, 6, 7, k) for k in range(20)], "doc_id long, size long, weight string, uid int, key int, one int, link long")
    got = sharding.balanced_shards(df, F.col("link") % 3, shards=4)
    assert got.columns == [*df.columns, "law", "shard", "slot", "start_shard"] and {(r.weight, r.uid, r.key, r.one) for r in got.collect()} == {("w", 5, 6, 7)}


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_a_group_over_ten_shards_comes_together(spark, law):
    rows = ["hot"] * 2700 + [f"pair {k // 2}" for k in range(600)] + [f"five {k // 5}" for k in range(200)] + [f"single {k}" for k in range(4500)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(rows)], SCHEMA)
    got = sharding.shard_documents(df, law=law).collect()
    load, held = Counter(), defaultdict(Counter)
    for r in got:
        load[r.shard] += 1 if law == "rows" else r["size"]
        held[rows[r.doc_id]][r.shard] += 1
    assert max(load.values()) - min(load.values()) <= (1 if law == "rows" else 2 * max(r["size"] for r in got))
    least = -(-2700 * (1 if law == "rows" else 19) // max(load.values()))
    assert least > 10 and len(held["hot"]) <= least + 1
    assert sum(len(g) > 1 for t, g in held.items() if t != "hot") <= 2


def test_small_tables_are_few_files(spark, monkeypatch):
    """Whatever the number of shuffle partitions, each table of the propagation is as many files as its rows need."""
    found, own = [], sharding.durable

    def counted(df, name, *rows):
        out = own(df, name, *rows)
        found.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(sharding, "durable", counted)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(k, "same" if k % 2 else f"text {k // 3}") for k in range(300)], "doc_id long, text string")
        assert sharding.shard_documents(df, shards=5).count() == 300
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert {"wishes", "movers", "moves", "state", "placed"} <= {name for name, _ in found}
    assert all(files == 1 for name, files in found if name != "rows"), found
