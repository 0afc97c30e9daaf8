import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import langid, queries


@pytest.fixture(scope="module")
def small():
    texts = [("the cat is on the mat and that is this", "en"), ("der hund ist nicht auf dem berg und das", "de")] * 3
    return langid.fit(texts, steps=60)


def test_gradients_match_differences(small):
    rng = np.random.default_rng(0)
    model = langid.Model(small.languages, small.symbols, {k: v.astype(np.float64) for k, v in small.p.items()})
    x, y = rng.integers(0, 8, (5, 6)), rng.integers(0, 2, 6)
    counted = rng.random((5, 6)) < 0.8
    _, grads = model.gradients(x, y, counted)
    for name, value in model.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            loss = []
            for step in (1e-4, -2e-4):
                value[at] += step
                loss.append(model.gradients(x, y, counted)[0])
            value[at] += 1e-4
            assert abs((loss[0] - loss[1]) / 2e-4 - grads[name][at]) < 1e-5


def test_windows():
    read = lambda t: [bytes(w).rstrip() for w in langid.windows(t.encode())]
    assert read("Ab c1D, é-x") == [b"ab c d \xc3\xa9 x"]
    assert [len(w) for w in read("a" * 150)] == [64, 64, 22]
    assert read(" 12 ") == [] and read("") == []
    words = [w for w in read("several words in one window, " * 40)]
    assert all(len(w) > 40 and w.split()[0] in (b"several", b"words", b"in", b"one", b"window") for w in words[:-1])
    for shift in range(4):  # no character is cut
        found = [bytes(w).rstrip().decode() for w in langid.windows(("x" * shift + "日本語🙂é" * 60).encode())]
        assert "".join(found) == "x" * shift + "日本語🙂é" * 60


def test_states_cross_words(small):
    x = lambda t: small.symbols[langid.windows(t.encode()).T]
    a, b = small.positions(x("the mat is on"))[4:7, 0], small.positions(x("der mat is on"))[4:7, 0]
    assert np.abs(a - b).max() > 1e-3


def test_edges(spark, small):
    rows = [(1, "the mat", "x"), (1, "the mat", "x"), (2, None, "x"), (3, "", "x"), (4, "12 !?", "x"), (5, "🙂—", "x"), (None, "der berg " * 9000, None), (6, "日本", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {r.doc_id: r for r in langid.predict(df, small).collect()}
    assert langid.predict(df, small).columns == ["doc_id", "text", "lang_pred", "score"]
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5, None)] == ["en", "und", "und", "und", "und", "de"]
    assert got[6].lang_pred in ("en", "de") and got[2].score == 0 and 0.5 < got[None].score <= 1
    assert langid.predict(df.limit(0), small).count() == 0
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.train(df.withColumn("lang", F.lit(None).cast("string"))) is None


def test_documents_pool_their_positions(spark, small):
    text = "The mat, und 7 der"
    row = langid.label_positions(spark.createDataFrame([(text,)], "text string"), small).first()
    assert len(row.labels) == len(text) and [row.labels[k] for k in (3, 7, 8, 12, 13, 14)] == [-1] * 6
    found = langid.windows(text.encode())
    whole = small.positions(small.symbols[found.T])[:, 0][found[0] != langid.BLANK].mean(0)
    letters = [k for k, c in enumerate(text) if c.isalpha()]
    assert [row.labels[k] for k in letters] == small.positions(small.symbols[found.T])[:, 0][found[0] != langid.BLANK].argmax(-1).tolist()
    got = langid.predict(spark.createDataFrame([(text,)], "text string"), small).first()
    assert abs(got.score - whole.max()) < 1e-5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op9_langid(spark, sf).join(queries.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and 120 < len(held) < 280
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def sentences(rng, words, n):
    return " ".join(rng.choice(words, n))


def test_learns_from_long_texts_and_rows_without_ids(spark):
    rng = np.random.default_rng(3)
    words = {"en": "the and that this with from have which there".split(), "de": "und der nicht ist auch werden eine sich auf".split()}
    rows = [(None if k % 2 else k, sentences(rng, words[lang], 6000 if lang == "en" else 30), lang) for lang in words for k in range(30)]
    rows += [(None, sentences(rng, words["de"], 30), "de") for _ in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert max(len(r[1]) for r in rows) > langid.SAMPLE_POINTS
    model = langid.train(df)
    assert model.languages == ["de", "en"]
    got = langid.predict(df, model, keep=["lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.99
    only = langid.train(df.filter("doc_id is null"))
    assert only.languages == ["de", "en"]


def test_many_languages_share_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_TOTAL", 1_000_000)
    seen = []
    monkeypatch.setattr(langid, "fit", lambda texts, **_: seen.extend(texts))
    rows = [(k, f"text {k} " + "x" * 30_000, f"l{k % 1000}") for k in range(3000)]
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len({lang for _, lang in seen}) == 1000 and sum(len(t) for t, _ in seen) < 1_500_000


def test_long_texts_are_sampled_all_over(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "fit", lambda texts, **_: seen.extend(texts))
    langid.train(spark.createDataFrame([(1, "".join(chr(97 + k) * 10_000 for k in range(20)), "x")], "doc_id long, text string, lang string"))
    assert set(seen[0][0]) >= set("abcdefghijklmnopqrst") and len(seen[0][0]) <= langid.SAMPLE_POINTS + langid.PIECES


def test_clashing_names_and_empty_labels(spark, small):
    df = spark.createDataFrame([(1, "der hund", "a", 0.5, "x")], "doc_id long, text string, Lang_Pred string, SCORE double, `a.b` string")
    assert langid.predict(df, small).columns == ["doc_id", "text", "a.b", "lang_pred", "score"]


def test_query_against_one_text_at_a_time(spark):
    sf = "/root/testdata/sf0.01"
    docs = queries.table(spark, sf, "documents")
    model = langid.train(docs.filter(~queries.held_out()))
    got = {r.doc_id: r for r in queries.op9_langid(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        found = langid.windows((r.text or "").encode())
        if not any(map(str.isalpha, r.text or "")):
            assert (g.lang_pred, g.score) == ("und", 0)
            continue
        mean = model.sums(found).sum(0, dtype=float) / (found != langid.BLANK).sum()
        assert abs(g.score - mean.max()) < 1e-4 and (g.lang_pred == model.languages[int(mean.argmax())] or np.sort(mean)[-1] - np.sort(mean)[-2] < 1e-4)


def test_every_labelled_window_is_learned(spark, monkeypatch):
    """Whatever the sample leaves out takes part in the steps: all bytes get inputs, all windows gradients and scores."""
    monkeypatch.setattr(langid, "SAMPLE_DOCUMENTS", 3)
    rows = [(k, ("der hund und die katze " if k % 2 else "the dog and the cat ") * (1 + k % 9), "de" if k % 2 else "en") for k in range(60)]
    rows += [(100 + k, "\u0436\u0448 " * 40, "ru") for k in range(4)] + [(200, "\u00e5" * 300, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    told = {}
    monkeypatch.setattr(langid, "learn", lambda every, model, letters, known, own=langid.learn: told.update(zip(("model", "bins"), own(every, model, letters, known), strict=True), start=model, letters=letters) or (told["model"], told["bins"]))
    model = langid.train(df, limit=True)
    whole = {lang: sum(int((langid.windows(t.encode()) != langid.BLANK).sum()) for _, t, x in rows if x == lang) for lang in ("de", "en", "ru")}
    assert told["letters"] == whole
    assert all(model.symbols[b] for _, t, _ in rows for b in langid.folded(t.encode())[0])
    assert told["bins"].sum() == len(rows) - 9
    assert all((model.p[n] != told["start"].p[n]).any() for n in model.p)
    again = langid.train(df.repartition(2), limit=True)
    assert again.least == pytest.approx(model.least, abs=1e-3)
    assert all(np.allclose(again.p[n], model.p[n], atol=1e-3) for n in model.p)


def test_windows_that_are_told_well_cost_no_way_back(spark, monkeypatch):
    """Every window is read and scored, those under the margin alone go back through the network, and their gradient's
    weight is that of all windows."""
    rows = [(k, ("der hund und die katze " if k % 2 else "the dog and the cat ") * 40, "de" if k % 2 else "en") for k in range(80)]
    rows += [(100, "der hund und die katze " * 40, "en")]
    df = spark.createDataFrame([(t, lang, i) for i, t, lang in rows], "t string, l string, i long").coalesce(1)
    model = langid.fit([(t, lang) for _, t, lang in rows[:8]], steps=150)
    letters = {lang: sum(int((langid.windows(t.encode()) != langid.BLANK).sum()) for _, t, x in rows if x == lang) for lang in ("de", "en")}
    found, back, own = langid.learn(df, model, letters, np.zeros(0, np.int64)), [], langid.Model.gradients
    monkeypatch.setattr(langid.Model, "gradients", lambda self, x, *more: back.append(x.shape[1]) or own(self, x, *more))
    monkeypatch.setattr(type(df), "mapInArrow", _here)
    again = langid.learn(df, model, letters, np.zeros(0, np.int64))
    assert found[1].sum() == again[1].sum() == len(rows)
    assert 0 < sum(back) <= len(langid.windows(rows[-1][1].encode()))
    assert all(np.allclose(found[0].p[n], again[0].p[n], atol=1e-4) for n in model.p)
    assert any((found[0].p[n] != model.p[n]).any() for n in model.p)


def _here(rows, run, kinds):
    """mapInArrow in this process."""
    table = rows.toArrow()
    return rows.sparkSession.createDataFrame([tuple(r.values()) for b in run(iter(table.to_batches())) for r in b.to_pylist()], kinds)
