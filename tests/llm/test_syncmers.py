import hashlib
import random
import re

import xxhash

from panelforge.llm import queries, syncmers


def chain(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else (v % 2**64).to_bytes(8, "little"), seed)
    return seed


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def brute(text):
    h = [signed(chain([t.encode()])) for t in re.findall(syncmers.TOKENS, text or "")]
    s = [signed(chain(h[k : k + syncmers.S])) for k in range(len(h) - syncmers.S + 1)]
    runs, out = syncmers.K - syncmers.S + 1, []
    for k in range(len(h) - syncmers.K + 1):
        inner = s[k : k + runs]
        if min(inner) in (inner[0], inner[-1]):
            out.append((k + 1, chain(h[k : k + syncmers.K]) & 0xFFFFFFFF))
    return out or ([(1, chain(h) & 0xFFFFFFFF)] if h else [])


def near(a, b):
    a, b = {x[1] for x in a}, {x[1] for x in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "WINDOW_ROWS", 1)
    rng = random.Random(2)
    texts = ["", " ", "a", "é" * 70, "日本語" * 40, "a b c d e", "a b c d e f"] + [" ".join(rng.choices("abcdefg\n🙂é", k=rng.randrange(0, 90))) for _ in range(200)]
    texts += [texts[-1], texts[-1]]
    rows = [(k * k % 1009, t, 0.5) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, near_next double")
    got = {r.doc_id: r for r in syncmers.compare_with_edits(df).collect()}
    ordered = sorted(rows, reverse=True)
    assert len(got) == len(ordered)
    for k, (doc, text, _) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert [tuple(x) for x in r.found] == brute(text) and [tuple(x) for x in r.edited_found] == brute(edited)
        assert abs(r.near_edited - near(brute(text), brute(edited))) < 1e-12
        assert abs(r.near_next - near(brute(text), brute(after))) < 1e-12


def test_edges(spark):
    schema = "doc_id long, text string"
    assert syncmers.compare_with_edits(spark.createDataFrame([], schema)).count() == 0
    (r,) = syncmers.compare_with_edits(spark.createDataFrame([(4, "a b c")], schema)).collect()
    assert (r.near_next, r.n_chars) == (1.0, 5)
    rows = syncmers.compare_with_edits(spark.createDataFrame([(1, None), (1, None), (None, "x"), (1, "x"), (None, None)], schema)).collect()
    assert len(rows) == 5 and {r.n_chars for r in rows} == {0, 1}


def test_windows_are_cut(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "WINDOW_ROWS", 2)
    monkeypatch.setattr(syncmers, "QUANTILES", 4)
    rows = [(k**3, f"t{k}") for k in range(100)]
    got = {r.doc_id: r.edited_sha256 for r in syncmers.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (doc, text) in enumerate(rows):
        after = rows[k - 1][1]
        half = len(text) // 2
        assert got[doc] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


def check_next(spark, rows, schema, key):
    """Every row's edited text against that of the next one by descending id, for ids or texts that differ."""
    got = sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in syncmers.compare_with_edits(spark.createDataFrame(rows, schema)).collect())
    ordered, want = sorted(rows, key=key), []
    for k, (doc, text) in enumerate(ordered):
        half = len(text) // 2
        want.append((str(doc), len(text), hashlib.sha256((text[: len(text) - half] + ordered[(k + 1) % len(ordered)][1][:half]).encode()).hexdigest()))
    assert got == sorted(want)


def tie(text):
    return signed(chain([text.encode()]))


def test_ids_of_any_type(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "WINDOW_ROWS", 2)
    monkeypatch.setattr(syncmers, "LEVEL_ROWS", 8)
    rows = [(f"doc-{k * k % 211:03}", f"text number {k}") for k in range(200)]
    rows = list({d: (d, t) for d, t in rows}.values())
    check_next(spark, rows, "doc_id string, text string", lambda r: [-ord(c) for c in r[0]])


def test_null_and_repeated_ids_are_dealt_to_windows(spark, monkeypatch):
    for name, value in (("WINDOW_ROWS", 5), ("HOT_ROWS", 20), ("HOT_SHARE", 10), ("LEVEL_ROWS", 4)):
        monkeypatch.setattr(syncmers, name, value)
    rows = [(k if k % 3 else None if k % 2 else 40, f"text number {k}") for k in range(300)]
    check_next(spark, rows, "doc_id long, text string", lambda r: (r[0] is None, -(r[0] or 0), -tie(r[1])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    windows, _, own = syncmers.with_next(df, "doc_id", ["text"])
    assert max(r["count"] for r in windows.filter(own).groupBy("__window__").count().collect()) <= 30


def test_query_against_brute_force(spark, sf):
    rows = sorted(((r.doc_id, r.text or "") for r in queries.table(spark, sf, "documents").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op8_syncmers(spark, sf).collect()}
    assert len(got) == len(rows)
    shown = lambda found: ",".join(f"{x:X}" for _, x in found)
    for k, (doc, text) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        own, other = brute(text), brute(edited)
        assert (r.fingerprint, r.edited_fingerprint) == (shown(own), shown(other))
        assert abs(r.near_edited - near(own, other)) < 1e-12 and abs(r.near_next - near(own, brute(after))) < 1e-12


def test_unspaced_passages_at_other_places(spark):
    rng = random.Random(6)
    passages = ["".join(rng.choices(letters, k=3000)) for letters in ("".join(map(chr, range(0x4E00, 0x5200))), "ABCDEFGHabcdefgh01234567+/")]
    rows = [(10 * p + k, "x" * k + passage) for p, passage in enumerate(passages) for k in (0, 1, 5, 7)]
    got = {r.doc_id: {a.hash for a in r.found} for r in syncmers.anchors(spark.createDataFrame(rows, "doc_id long, text string"), "text", "found").collect()}
    for p in range(2):
        for k in (1, 5, 7):
            a, b = got[10 * p], got[10 * p + k]
            assert len(a) > 1000 and len(a - b) == 0 and len(b - a) <= 12
