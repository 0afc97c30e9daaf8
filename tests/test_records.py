"""Values, quotes, locators, arms, gates, specs and exports."""

import datetime as dt
import difflib
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from panelforge.functions import text
from panelforge.operators import cells, guards, planted, scoring, signals, sorts, specs, views
from panelforge.operators.specs import Stated
from panelforge.sources import files

D = dt.date


def test_value_forms(spark):
    cases = [("int", "6 months", "6"), ("int", " 6-month", "6"), ("int", "6.0", "6"), ("int", "6.5", None), ("int", "quarterly", None), ("int", "-3", "-3"), ("int", None, None),
             ("token", " Equal  Weighted ", "equal_weighted"), ("token", "by-size", "by_size"), ("token", "- x -", "x"), ("month", "2004-07", "2004-07"), ("month", "2004-7", None), ("month", "2004-13", None),
             ("int_set", "[3, 1,1]", "1,3"), ("int_set", "[]", None), ("int_set", "[1, \"a\"]", None), ("int_set", "3", None)]
    for kind in {c[0] for c in cases}:
        own = [c for c in cases if c[0] == kind]
        df = spark.createDataFrame([(k, c[1]) for k, c in enumerate(own)], "k int, v string")
        assert [r.x for r in df.orderBy("k").select(text.value_form(F.col("v"), kind).alias("x")).collect()] == [c[2] for c in own]
    df = spark.createDataFrame([("6", "6 months"), ("6", "7"), ("x", "6"), ("6", "x"), (None, None), (None, "6")], "a string, b string")
    got = [tuple(r.c) for r in df.select(text.compare_values(F.col("a"), F.col("b"), "int").alias("c")).collect()]
    assert got == [(True, "comparable"), (False, "comparable"), (None, "expected_unnormalisable"), (None, "found_unnormalisable"), (True, "comparable"), (False, "comparable")]
    assert df.limit(1).select(text.compare_values(F.col("a"), F.col("b"), "prose").alias("c")).first().c == (None, "no_policy")
    with pytest.raises(ValueError):
        text.value_form(F.col("a"), "nothing")


def test_json_pointers_and_canonical_json(spark):
    doc = json.dumps({"a": [1, {"b/c": None, "m~n": 2.5}], "": "empty", "01": 3})
    cases = [("", True), ("/a/0", "1"), ("/a/1/b~1c", "null"), ("/a/1/m~0n", "2.5"), ("/", '"empty"'), ("/01", "3"), ("/a/01", None), ("/a/2", None), ("/a/-", None), ("a", None), ("/a/0/x", None), ("/z", None), (None, None)]
    df = spark.createDataFrame([(k, doc, p) for k, (p, _) in enumerate(cases)] + [(99, "{broken", ""), (100, None, "")], "k int, d string, p string")
    got = {r.k: r.x for r in df.select("k", text.json_at(F.col("d"), F.col("p")).alias("x")).collect()}
    for k, (_, want) in enumerate(cases):
        assert got[k].found == (want is not None) and (want in (None, True) or got[k].value == want)
    assert json.loads(got[0].value) == json.loads(doc) and not got[99].found and not got[100].found
    assert text.canonical_json({"b": float("nan"), "a": [float("inf"), 1.5, {"z": None}]}) == '{"a":[null,1.5,{"z":null}],"b":null}'
    assert '"x":null' in files.stage_report("s", {"x": float("nan")}, {})


def test_nearest_window(spark):
    df = spark.createDataFrame([("aaaa bbbb the quick brown fox cccc " * 3, "quick brown fix"), ("xyz" * 50, "0123456789"), (None, "a"), ("", "a")], "p string, q string")
    got = [r.w for r in df.select(text.nearest_window(F.col("p"), F.col("q")).alias("w")).collect()]
    assert "quick brown f" in got[0] and len(got[0]) <= 65 and got[1] == ("xyz" * 50)[:50] and got[2] is None and got[3] == ""


def test_relocation(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    pages = [(1, 1, " ".join(words[:100])), (1, 2, " ".join(words[100:200])), (1, 3, " ".join(words[200:300])), (2, 1, " ".join(words[300:]))]
    near = " ".join([*words[120:130], "CHANGED", *words[131:140]])
    seam = " ".join([*words[90:100], *words[100:110]])
    broken = " ".join([*words[192:200], "X", *words[201:208]])
    quotes = [(1, 1, " ".join(words[10:20])), (2, 1, near), (3, 1, seam), (4, 1, broken), (5, 1, ""), (6, 1, "zz"), (7, 1, "0" * 40), (8, 2, near), (9, 1, " ".join(words[230:234]) + " 0123456789" * 6), (10, 9, near), (11, 1, None)]
    out = text.relocate(spark.createDataFrame(pages, "doc int, page int, text string"), spark.createDataFrame(quotes, "q int, doc int, quote string"), "doc", "page", "text", "q", "quote", bar=0.8)
    got = {r.q: r for r in out.collect()}
    assert len(got) == len(quotes)
    assert {q: (got[q].method, got[q].reason) for q in (1, 3, 5, 6, 7, 9, 10, 11)} == {1: ("exact", "exact_match"), 3: ("exact", "exact_match"), 5: ("rejected", "empty_quote"), 6: ("rejected", "too_short"), 7: ("rejected", "no_anchor"), 9: ("rejected", "below_bar"), 10: ("rejected", "no_anchor"), 11: ("rejected", "empty_quote")}
    assert (got[1].page, got[1].seam, got[3].page, got[3].seam) == (1, False, 1, True)
    r = got[2]
    assert (r.method, r.page, r.seam) == ("relocated", 2, False) and pages[1][2][r.start : r.end].startswith(words[120])
    assert abs(r.score - difflib.SequenceMatcher(None, pages[1][2][r.start : r.end], near, autojunk=False).ratio()) < 1e-12
    assert (got[4].method, got[4].page, got[4].seam) == ("relocated", 2, True) and got[8].reason in ("no_anchor", "below_bar")


def test_arms_and_orders(spark):
    arms = spark.createDataFrame([("a", 3, 1), ("b", 0, 2)], "arm string, c int, r int")
    assert [(r.conservative, r.permissive) for r in scoring.completion(arms, "arm", "c", "r").orderBy("arm").collect()] == [(0.75, 1.0), (0.0, 0.0)]
    for bad in ([("x", 0, 0)], [("x", -1, 3)], [("x", None, 1)]):
        with pytest.raises(guards.GuardError):
            scoring.completion(spark.createDataFrame(bad, "arm string, c int, r int"), "arm", "c", "r")
    rows = spark.createDataFrame([(f"p{k}", k % 3 == 0) for k in range(10)], "id string, refused boolean")
    listed = spark.createDataFrame([(f"p{k}", 100 - k) for k in range(12)], "id string, pos int")
    got = sorted((r.pos, r.id, r.arm) for r in scoring.select_arms(rows, "id", F.col("refused"), listed, "pos", 3).collect())
    assert [(i, a) for _, i, a in got if a == "a"] == [("p9", "a"), ("p6", "a"), ("p3", "a"), ("p0", "a")] and [i for _, i, a in got if a == "b"] == ["p8", "p7", "p5"]
    for order in (listed.limit(3), listed.unionByName(listed.limit(1))):
        with pytest.raises(guards.GuardError):
            scoring.in_listed_order(rows, "id", order, "pos")
    one, two = ({r.id for r in scoring.draw(x, "id", 4, 7).collect()} for x in (rows, rows.repartition(5)))
    assert one == two and len(one) == 4 and {r.id for r in scoring.draw(rows, "id", 99, 7).collect()} == {f"p{k}" for k in range(10)}


def test_legs_and_fields_are_paired(spark):
    schema = "spec string, leg int, s string, c string"
    gold = [("one", 0, "mom", None), ("crf", 0, "rating", "var"), ("crf", 1, "rating", "gamma"), ("crf", 2, "rating", "rev"), ("two", 0, "a", None), ("two", 1, "b", None), ("lost", 0, "x", None)]
    run = [("one", 5, "other", None), ("crf", 0, "rating", "rev"), ("crf", 3, "rating", "var"), ("crf", 4, "rating", "gamma"), ("two", 0, "b", "z"), ("two", 1, "a", "z")]
    got = {(r.spec, r.expected_leg): r.found_leg for r in scoring.match_legs(spark.createDataFrame(gold, schema), spark.createDataFrame(run, schema), "spec", "leg", "s", "c").collect()}
    assert got == {("one", 0): 5, ("crf", 0): 3, ("crf", 1): 4, ("crf", 2): 0, ("two", 0): 1, ("two", 1): 0}
    want = spark.createDataFrame([("s", "a", "1"), ("s", "b", "2")], "spec string, field string, v string")
    out = scoring.pair_fields(want, spark.createDataFrame([("s", "a", "9"), ("s", "zz", "3")], "spec string, field string, v string"), ["spec", "field"], "v")
    assert sorted(map(tuple, out.collect())) == [("s", "a", "1", "9"), ("s", "b", "2", None)]
    with pytest.raises(guards.GuardError):
        scoring.pair_fields(want.unionByName(want), want, ["spec", "field"], "v")


def test_gates_in_their_order(spark):
    names = [c for _, needs in scoring.GATES for c in needs]
    rows = [[True] * len(names)] + [[j != k for j in range(len(names))] for k in range(len(names))] + [[None] + [True] * (len(names) - 1), [True, False, True, True, True, True, False, *[True] * (len(names) - 7)]]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + ", ".join(f"{n} boolean" for n in names))
    got = [r.o for r in df.orderBy("k").select(scoring.outcome(df).alias("o")).collect()]
    assert got[0] == "advanced" and got[1 : len(names) + 1] == [g for g, needs in scoring.GATES for _ in needs] and got[-2:] == ["invalid_proposal"] * 2


def stated(**fields):
    return {k: v if isinstance(v, Stated) else Stated(v) for k, v in fields.items()}


def test_specs_become_strategies_or_refusals():
    concepts = views.Concepts({"momentum": "mom6", "rating": "rating", "var": "var_5pct"})
    ok = specs.adapt("s", stated(combiner="single_leg"), [stated(signal="momentum", weighting="equal", groups=3, trim={"method": "truncate", "low": -0.5, "high": 0.5})], concepts, entity="cusip")
    assert isinstance(ok, cells.Strategy) and ok.legs[0] == sorts.Rulebook(score="mom6", entity="cusip", groups=3, by_size=False, trim="truncate", trim_low=-0.5, trim_high=0.5)
    silent = specs.adapt("s", {}, [stated(signal="momentum", holding_period=3)], concepts)
    assert silent.months == 3 and silent.legs[0].by_size and silent.legs[0].groups == 5
    many = specs.adapt("s", stated(combiner="equal_average"), [stated(signal="rating", control=c) for c in ("var", "momentum")], concepts)
    assert [b.control for b in many.legs] == ["var_5pct", "mom6"]
    cases = {
        specs.MISSING_BINDING: ({}, [stated(signal="unknown")]),
        specs.OUT_OF_ENUM_WEIGHTING: ({}, [stated(signal="momentum", weighting="rank")]),
        specs.UNSUPPORTED_TRIM_VARIANT: ({}, [stated(signal="momentum", trim={"method": "truncate", "by": "month"})]),
        specs.UNSUPPORTED_COMBINATION: ({}, [stated(signal="momentum", control="rating", holding_period=6)]),
        specs.ASSUMPTION_MISMATCH: (stated(frequency="weekly"), [stated(signal="momentum")]),
        specs.REVIEW_REQUIRED: ({}, [stated(signal="momentum", groups=Stated(None, "REVIEW"))]),
        specs.REFUSED_ON_SILENCE: ({}, [stated(signal=Stated(None, "UNKNOWN"))]),
        specs.UNSUPPORTED_COMBINER: (stated(combiner="other"), [stated(signal="momentum")]),
    }
    for code, (common, legs) in cases.items():
        got = specs.adapt("s", common, legs, concepts, rules=[("frequency", "weekly", "the engine is monthly")])
        assert code in [r.code for r in got], code
    assert not isinstance(specs.adapt("s", stated(frequency=Stated("weekly", "INFERRED")), [stated(signal="momentum")], concepts, rules=[("frequency", "weekly", "x")]), tuple)
    with pytest.raises(guards.GuardError):
        views.Concepts({"a": "x", "b": "x"})
    with pytest.raises(guards.GuardError):
        concepts.column("nothing")


def test_scope_and_audit(spark):
    def facts(**changed):
        return spark.createDataFrame([(c, *changed.get(c, (True, False, None))) for c in cells.CHOICES], "choice string, runnable boolean, not_applicable boolean, fixed string")

    assert cells.scope(facts()).first().scope == "COMPLETE"
    r = cells.scope(facts(lab_trim=(False, False, "on"), lib_gap=(False, True, None))).first()
    assert (r.scope, r.held, r.not_applicable, r.run) == ("PARTIAL", ["lab_trim=on"], ["lib_gap"], ["meas_err", "stale_price", "survivorship"])
    assert cells.scope(facts(meas_err=(False, False, None), lab_trim=(False, False, "on"))).first().scope == "REFUSED"
    with pytest.raises(guards.GuardError):
        cells.scope(facts().filter("choice <> 'lab_trim'"))
    panel, signals_ = planted.clean_panel(spark, planted.Recipe(entities=25, months=40, seed=5))
    panel = planted.plant(panel, signals_, "meas_err", 0.05)
    strategy = cells.Strategy("s", (sorts.Rulebook(score="score", entity="cusip", by_size=False),))
    told = cells.audit(panel, signals_, strategy)
    shares = {r.bit: r.share for r in told["shapley"].collect()}
    assert told["scope"].first().scope == "COMPLETE" and shares[0] < -0.02 and all(abs(shares[k]) < 1e-9 for k in range(1, 5))
    effects = {r.mask: r for r in told["effects"].collect()}
    assert abs(effects[1].effect - shares[0]) < 1e-9 and effects[2].inert and effects[1].p_value < 1e-6
    with pytest.raises(guards.GuardError):
        cells.audit(panel.drop("ret_corr"), signals_, strategy)


def test_export_recompute_and_windows(spark, tmp_path):
    panel, signals_ = planted.clean_panel(spark, planted.Recipe(entities=8, months=40, seed=5))
    panel = planted.plant(panel, signals_, "survivorship", 0.3)
    columns = ["cusip", "date", "size", "ret", "score"]
    one = files.export_panel(panel, signals_, str(tmp_path / "a"), columns)
    assert one == files.export_panel(panel.repartition(3), signals_, str(tmp_path / "b"), columns)
    out = spark.read.parquet(str(tmp_path / "a"))
    assert out.columns == columns and out.count() == panel.filter("exit_reason is null").count()
    with pytest.raises(guards.GuardError):
        files.export_panel(panel, signals_, str(tmp_path / "c"), [*columns, "rating"])
    view = views.view(panel, "raw", ["raw", "corr"], ["cusip", "date"])
    again = signals.recompute(view.withColumn("mom6", F.lit(9.0)), "cusip", "date")
    want = signals.rolling_kth_lowest(view, "cusip", "date", "ret").select("cusip", "date", "kth")
    assert again.join(want, ["cusip", "date"]).filter("not (var_5pct <=> kth)").count() == 0 and again.filter("mom6 = 9").count() == 0 and again.columns.count("mom6") == 1
    some = spark.createDataFrame([(D(2010, 1, 31),), (D(2010, 3, 15),), (D(2012, 1, 1),)], "d date")
    r = views.window_coverage(some, "d", "2010-01-31", "2010-04-30").first()
    assert (r.expected, r.present, r.missing) == (4, 2, [D(2010, 2, 28), D(2010, 4, 30)])


def test_columns_are_found_and_records_projected(spark, tmp_path):
    assert files.find_column(["X", " Date "], ["month", "date"]) == " Date "
    with pytest.raises(guards.GuardError):
        files.find_column(["x"], ["date"])
    df = spark.createDataFrame([("201001", 1), ("201002", 2)], "yyyymm string, v int")
    assert sorted(r.year_month for r in files.by_month(df).collect()) == ["2010-01", "2010-02"]
    (tmp_path / "r.csv").write_text("a,b,c\n1,2,3\n")
    assert files.read_records(spark, str(tmp_path / "r.csv"), "a int, b int, c int", columns=["c"], sequence="n").columns == ["c", "n"]


def test_grid_and_arms(spark):
    rng = random.Random(4)
    rows = [(f"e{e}", D(2010, m, 28), rng.gauss(0, 1), rng.uniform(1, 2), rng.random(), rng.random()) for e, m in itertools.product(range(20), range(1, 9))]
    df = spark.createDataFrame(rows, "entity string, date date, ret double, size double, score double, other double").withColumn("date", F.last_day("date"))
    book = sorts.Rulebook(score="score", groups=2, control="other", control_groups=2)
    whole = {(r.date, r.control_group, r.score_group): r.ret for r in sorts.grid(df, book).collect()}
    for r in sorts.characteristic_sort(df, book).collect():
        assert abs(r.strategy_ret - sum(whole[r.date, c, 1] - whole[r.date, c, 0] for c in range(2)) / 2) < 1e-12
    both = sorts.arms(df.withColumns({"a": F.col("ret") * 0.5, "b": F.col("ret") * 0.5}), book, {"total": "ret", "a": "a", "b": "b"})
    by = {(r.arm, r.date): r.strategy_ret for r in both.collect()}
    assert all(abs(by["total", d] - by["a", d] - by["b", d]) < 1e-12 for arm, d in by if arm == "total")
