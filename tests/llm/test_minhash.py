import random
from collections import defaultdict

import numpy as np
import pytest

from panelforge.llm import _graph, minhash, queries


def alike(a, b):
    """Probability Jaccard similarity, term by term."""
    names = a.keys() | b.keys()
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in names) for i in a.keys() & b.keys())


def brute(rows, least=0.8, weigh="count"):
    """doc -> least doc of its group, by comparing all that share a shingle."""
    sets = {d: minhash.weighted_shingles([minhash.words(t or "")], weigh)[0] for d, t in rows}
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared = defaultdict(int)
    by = defaultdict(list)
    for d, s in sorted(sets.items()):
        for x in s or {None}:
            for e in by[x]:
                shared[e, d] += 1
            by[x].append(d)
    for (a, b), n in shared.items():
        ones = max([*sets[a].values(), *sets[b].values()], default=1) == 1
        if (1.0 if not sets[a] or sets[a] == sets[b] else n / (len(sets[a]) + len(sets[b]) - n) if ones else alike(sets[a], sets[b])) >= least - 1e-12:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {d: top(d) for d in sets}


def test_similarity_is_the_sum_of_its_terms():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ({k: rng.randrange(1, 5) for k in rng.sample("abcdefghij", rng.randrange(1, 10))} for _ in range(2))
        assert abs(minhash.similarity(a, b) - alike(a, b)) < 1e-12
        shared = a.keys() & b.keys()
        p, q = (sum(x[k] for k in shared) / sum(x.values()) for x in (a, b))
        assert minhash.similarity(a, b) <= (p * q / (p + q - p * q) if shared else 0) + 1e-12  # the bound of the rounds
        p, q = (min(part, len(shared) * max(x.values()) / sum(x.values())) for part, x in ((p, a), (q, b)))
        assert minhash.similarity(a, b) <= (p * q / (p + q - p * q) if shared else 0) + 1e-12
        assert abs(minhash.similarity(a, {k: 3 * n for k, n in a.items()}) - 1) < 1e-12
        ones = [dict.fromkeys(x, 1) for x in (a, b)]
        assert minhash.similarity(*ones) == len(shared) / len(a.keys() | b.keys())
    assert minhash.similarity({}, {}) == 1 and minhash.similarity({"a": 1}, {}) == 0


def test_bands_follow_the_similarity():
    assert minhash.bands_for(0.8) == (128, 25, 5, 84)
    for least in (0.05, 0.3, 0.5, 0.7, 0.9, 1.0):
        cut = minhash.bands_for(least)
        assert cut.bands * cut.rows <= cut.places and (1 - least**cut.rows) ** cut.bands <= minhash.MISSED
    with pytest.raises(ValueError):
        minhash.bands_for(0)


def test_places_are_visited_once_each():
    order = np.random.default_rng(5).integers(0, 2**63, 300).astype(np.uint64)
    for places in (128, 256):
        seen = np.stack([minhash._place(order, k, places) for k in range(places)])
        assert (np.sort(seen, 0) == np.arange(places)[:, None]).all()
        assert len({tuple(x) for x in seen.T}) > 295
    follow = np.mean([[(s[k + 1] - s[k]) % 128 == 1 for k in range(127)] for s in np.stack([minhash._place(order, k, 128) for k in range(128)]).T])
    assert follow < 0.03  # neighbours don't come one after the other oftener than by chance


@pytest.mark.parametrize("least", [0.5, 0.7, 0.8])
def test_recall_at_each_similarity(spark, least):
    rng = random.Random(int(least * 100))
    pool = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(4000)]
    rows, pairs = [], 0
    for n in (12, 20, 60, 200):
        for _ in range(60):
            base = rng.choices(pool, k=n)
            other = list(base)
            while True:  # edits until the similarity is just above the limit
                tried = list(other)
                tried[rng.randrange(n)] = rng.choice(pool)
                if minhash.similarity(*minhash.weighted_shingles([[w.encode() for w in x] for x in (base, tried)])) < least:
                    break
                other = tried
            if other != base:
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
                pairs += 1
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), least=least).collect()}
    assert sum(got[k] == got[k + 1] for k in range(0, len(rows), 2)) >= 0.99 * pairs and pairs > 100


def test_repeated_lines_weigh(spark):
    rng = random.Random(6)
    pool = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(500)]
    line, own = rng.choices(pool, k=12), [rng.choices(pool, k=40) for _ in range(2)]
    rows = [(1, " ".join(own[0] + line * 60)), (2, " ".join(own[1] + line * 60)), (3, " ".join(own[0] + line)), (4, " ".join((own[0] + line) * 2))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for weigh in ("count", "presence"):
        got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, weigh=weigh).collect()}
        assert got == brute(rows, weigh=weigh)
    assert brute(rows)[2] == 1 and brute(rows, weigh="presence")[2] == 2


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    errors = []
    for trial in range(60):
        names = minhash._mixed(rng.integers(1, 2**62, 40).astype(np.uint64))
        a, b = rng.integers(0, 4, 40).astype(float), rng.integers(0, 4, 40).astype(float)
        want = sum(1 / np.maximum(a / a[k], b / b[k]).sum() for k in range(40) if a[k] and b[k])
        sets = [(np.flatnonzero(w), w) for w in (a, b)]
        owner = np.concatenate([np.full(len(k), i) for i, (k, _) in enumerate(sets)])
        x = minhash.signatures(2, owner, names[np.concatenate([k for k, _ in sets])], np.concatenate([w[k] for k, w in sets]))
        errors.append((x[0] == x[1]).mean() - want)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_early_stop_changes_nothing():
    rng = np.random.default_rng(1)
    element = rng.integers(1, 2**62, 500).astype(np.uint64)
    owner = np.sort(rng.integers(0, 3, 500))
    together = minhash.signatures(3, owner, element, np.ones(500))
    # places that are visited by every shingle, without a stop
    for n in range(3):
        own = element[owner == n]
        best = [(np.inf, 0)] * minhash.PLACES
        for e in own:
            s = minhash._mixed(np.array([e]) + minhash._GOLDEN)
            order, time = minhash._mixed(s ^ minhash._M1), 0.0
            for k in range(minhash.PLACES):
                s = minhash._mixed(s + minhash._GOLDEN)
                time += -np.log(((int(s[0]) >> 11) + 0.5) * 2.0**-53) / (minhash.PLACES - k)
                at = int(minhash._place(order, k, minhash.PLACES)[0])
                best[at] = min(best[at], (time, int(e)))
        assert [x[1] for x in best] == together[n].tolist()


def test_shingles_are_those_of_the_words():
    texts = ["a b c d e f a b c d e", "a b", "", "a a a a a a a", "x"]
    lists = [minhash.words(t) for t in texts]
    hashes = {w: np.uint64(hash(w) % 2**64) for own in lists for w in own}
    owner, value, count = minhash.shingles([np.array([hashes[w] for w in own], np.uint64) for own in lists])
    assert np.bincount(owner, minlength=5).tolist() == [len(s) for s in minhash.weighted_shingles(lists)] == [6, 1, 0, 1, 1]
    assert np.bincount(owner, weights=count, minlength=5).tolist() == [7, 1, 0, 3, 1]


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (7, 7), (60, 59)]
    got = {r.node: r.label for r in _graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def planted():
    rng = random.Random(7)
    pool = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    rows, doc = [], 0

    def add(ws):
        nonlocal doc
        rows.append((doc * 17 % 10007, " ".join(ws)))
        doc += 1

    for size in (2, 3, 40, 120):  # copies of one original with edits of their own
        base = rng.choices(pool, k=rng.choice([60, 150, 400]))
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(own) // 45))):
                own[rng.randrange(len(own))] = rng.choice(pool)
            add(own)
    chain = rng.choices(pool, k=200)  # each a copy of the one before
    for _ in range(12):
        add(chain)
        chain = list(chain)
        for _ in range(3):
            chain[rng.randrange(200)] = rng.choice(pool)
    passage = rng.choices(pool, k=60)  # shared by unrelated texts
    for _ in range(150):
        add(rng.choices(pool, k=70) + passage)
    for n in (0, 0, 1, 2, 4, 5):
        add(pool[:n])
        add(pool[:n])
    return rows


def test_groups_against_brute_force(spark):
    rows = planted()
    rows = rows + [(20000, rows[0][1].upper()), (20001, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    got = minhash.near_duplicates(df).collect()
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = defaultdict(int)
    for c in want.values():
        sizes[c] += 1
    assert all(r.group_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)
    stay = minhash.kept_rows(df)
    assert stay.columns == df.columns and sorted(r.doc_id for r in stay.collect()) == sorted(sizes)


def test_hot_buckets_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HOT_ROWS", 10)
    rows = planted()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows)


def test_edges(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "A  b c"), (2, None), (3, " ")], schema)
    got = minhash.near_duplicates(df).collect()
    assert sorted((r.class_id, r.group_size) for r in got) == [(1, 3)] * 3 + [(2, 2)] * 2 and sum(r.kept for r in got) == 2
    assert minhash.kept_rows(df).count() == 2


def test_documents_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    assert {r.doc_id: r.class_id for r in queries.op2_minhash(spark, sf).collect()} == brute(rows)


def test_frequencies_of_shingles(spark):
    every = [(u, "abcdefg".index(x), 2 if x == "c" else 1) for u, xs in ((1, "abc"), (2, "ab"), (3, "ad")) for x in xs] + [(u, 0, 1) for u in range(10, 17)]
    got, few = minhash._frequencies(spark.createDataFrame(every, "uid long, shingle long, weight long"))
    assert {r.uid: (r.common, r.distinct, r.peak) for r in got.collect()} == {1: (0.25, 1, 0.5), 2: (0.5, 1, 0.5), 3: (0.5, 1, 0.5), **{u: (1, 1, 1) for u in range(10, 17)}}
    assert sorted(map(tuple, few.select("uid", "shingle").collect())) == [(1, 1), (2, 1)]


def test_both_ways_to_components_agree(spark, monkeypatch):
    rng = random.Random(2)
    first = [(rng.randrange(80), rng.randrange(80)) for _ in range(40)]
    second = [(rng.randrange(80), rng.randrange(80)) for _ in range(15)]
    found = []
    for most in (10**6, 0):
        monkeypatch.setattr(_graph, "ONE_TASK_EDGES", most)
        labels = _graph.components(spark.createDataFrame(second, "a long, b long"), _graph.components(spark.createDataFrame(first, "a long, b long")))
        found.append({(r.node, r.label) for r in labels.collect() if r.node != r.label})
    assert found[0] == found[1] and found[0]
