import datetime as dt
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import dates, numbers, text

D = dt.date


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_business_gap_matches_numpy(spark):
    days = [D(2019, 12, 20) + dt.timedelta(k) for k in range(40)]
    rows = [(a, b) for a in days[::3] for b in days]
    got = spark.createDataFrame(rows, "a date, b date").select(dates.business_gap(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r.n for r in got] == [int(np.busday_count(a, b)) if a <= b else -int(np.busday_count(b, a)) for a, b in rows]


def test_month_ends_and_adjacency(spark):
    rows = [(D(2020, 1, 31), D(2020, 2, 29)), (D(2019, 12, 31), D(2020, 1, 31)), (D(2020, 1, 31), D(2020, 3, 31)), (D(2020, 1, 31), D(2020, 1, 31))]
    df = spark.createDataFrame(rows, "a date, b date")
    assert [r.x for r in df.select(dates.adjacent(F.col("a"), F.col("b")).alias("x")).collect()] == [True, True, False, False]
    assert [r.x for r in df.select(dates.shift_month_end(F.col("a"), 1).alias("x")).collect()] == [D(2020, 2, 29), D(2020, 1, 31), D(2020, 2, 29), D(2020, 2, 29)]


def test_thirty_360(spark):
    rows = [(D(2020, 1, 31), D(2020, 2, 29), 29), (D(2020, 1, 30), D(2020, 3, 31), 60), (D(2020, 2, 15), D(2021, 2, 15), 360)]
    got = spark.createDataFrame(rows, "a date, b date, n int").select("n", dates.days_30e_360(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(r.n == r.x for r in got)


def test_accrued_interest(spark):
    maturity = D(2012, 5, 15)
    months = [D(2011, 10, 31), D(2011, 11, 30), D(2011, 12, 31), D(2012, 5, 31), D(2012, 6, 30)]
    df = spark.createDataFrame([(m, maturity, 8.0, 2, None) for m in months] + [(months[0], maturity, 0.0, 2, None), (months[0], maturity, 8.0, 0, None), (months[2], maturity, 8.0, 2, D(2011, 12, 5)), (months[0], None, 8.0, 2, None), (months[0], maturity, None, 2, None)], "d date, m date, c double, f int, x date")
    ai, paid = dates.accrued(F.col("d"), F.col("m"), F.col("c"), F.col("f"), F.col("x"))
    got = [(round(r.a, 6), r.p) for r in df.select(ai.alias("a"), paid.alias("p")).collect()]
    assert got == [(round(8 * 165 / 360, 6), 0), (round(8 * 15 / 360, 6), 4), (round(8 * 45 / 360, 6), 0), (round(8 * 15 / 360, 6), 4), (0, 0), (0, 0), (0, 0), (0, 0), (0, 0), (0, 0)]


def test_nth_business_day(spark):
    df = spark.createDataFrame([(D(2010, 1, 31),)], "d date")
    got = df.select(dates.nth_business_day(F.col("d"), 5).alias("a"), dates.nth_business_day(F.col("d"), -5).alias("b"), dates.nth_business_day(F.col("d"), 99).alias("c")).first()
    assert tuple(got) == (D(2010, 1, 7), D(2010, 1, 25), D(2010, 1, 29))


def test_year_month(spark):
    df = spark.createDataFrame([("2010-03-31",), ("201003",), (" 201003 ",), ("x",), (None,)], "s string")
    assert [r.x for r in df.select(dates.year_month(F.col("s")).alias("x")).collect()] == ["2010-03", "2010-03", "2010-03", None, None]


def test_normal_distribution(spark):
    normal = statistics.NormalDist()
    xs = [-40.0, -8.0, -7.0, -3.0, -0.1, 0.0, 0.5, 2.0, 7.5, 39.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(numbers.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r.p - normal.cdf(x)) < 1e-13 for r, x in zip(got, xs))
    ps = [0.0, 1e-6, 0.01, 0.3, 0.5, 0.9, 0.999, 1.0]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(numbers.normal_inverse(F.col("p")).alias("z")).collect()
    assert got[0].z is None and got[-1].z is None
    assert all(abs(r.z - normal.inv_cdf(p)) < 1e-8 for r, p in zip(got[1:-1], ps[1:-1]))


def test_wilson_and_median(spark):
    low, high = numbers.wilson(F.col("k"), F.col("n"))
    got = spark.createDataFrame([(0, 10), (5, 10), (10, 10), (0, 0)], "k int, n int").select(low.alias("a"), high.alias("b")).collect()
    assert [round(r.a, 4) if r.a is not None else None for r in got] == [0.0, 0.2366, 0.7225, None] and round(got[0].b, 4) == 0.2775
    df = spark.createDataFrame([([3.0, 1.0, 2.0],), ([4.0, 1.0],), ([],)], "v array<double>")
    assert [r.x for r in df.select(numbers.median(F.col("v")).alias("x")).collect()] == [2.0, 2.5, None]


def test_nan_becomes_null(spark):
    df = numbers.nan_to_null(spark.createDataFrame([(float("nan"), "a"), (1.0, None)], "x double, s string"))
    assert [tuple(r) for r in df.collect()] == [(None, "a"), (1.0, None)]


def test_ratings_and_exits(spark):
    df = spark.createDataFrame([("AAA",), (" BBB- ",), ("D",), ("NR",), (None,), ("bbb-",), ("Aa1",)], "s string")
    assert [r.x for r in df.select(numbers.rating_number(F.col("s")).alias("x")).collect()] == [1, 10, 22, None, None, None, None]
    second = spark.createDataFrame([("Aaa", "MR"), ("Aa1", "MR"), ("Baa3", "MR"), ("C", "MR"), ("C", "SPR"), ("WR", "MR"), ("AAA", "MR")], "s string, a string")
    assert [r.x for r in second.select(numbers.rating_number(F.col("s"), F.col("a") == "MR").alias("x")).collect()] == [1, 2, 10, 21, 21, None, None]
    df = spark.createDataFrame([(D(2020, 1, 1), D(2020, 1, 1)), (None, D(2020, 1, 1)), (None, None)], "a date, b date")
    day, label = numbers.first_exit(maturity=F.col("a"), default=F.col("b"))
    assert [(r.d, r.l) for r in df.select(day.alias("d"), label.alias("l")).collect()] == [(D(2020, 1, 1), "maturity"), (D(2020, 1, 1), "default"), (None, None)]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r.x for r in df.select(numbers.cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert abs(got[0] - 1 / math.sqrt(2)) < 1e-9 and got[1] == 0


def test_text_ladder(spark):
    raw = "The “ﬁrst”  –\tsecond \n exam-\nple , ok ½"
    df = spark.createDataFrame([(raw,)], "t string")
    got = df.select(*[text.normalise(F.col("t"), k).alias(k) for k in text.LEVELS]).first()
    assert got.L0 == raw and got.L1 == 'The "first" - second exam- ple, ok 1⁄2' and got.L2 == 'The "first" - second example, ok 1⁄2'
    with pytest.raises(ValueError):
        text.normalise(F.col("t"), "L9")


#: Fixed vectors: text, then its L1 and L2 forms.
LADDER = [
    ("word ,", "word,", "word,"), ("γ .", "γ.", "γ."), ("(a )", "(a)", "(a)"), ("what ?", "what ?", "what ?"), ("t −6", "t -6", "t -6"), ("a⁃b", "a-b", "a-b"),
    ("x′ ≈ y″", "x′ ≈ y′′", "x′ ≈ y′′"), ("a﹘b", "a-b", "a-b"), ("self- made", "self- made", "selfmade"), ("a- b- c", "a- b- c", "abc"), ("a -\nb", "a - b", "a - b"),
    ("‚low‛", "‚low‛", "‚low‛"), ("\u00a0a\x1cb\u2028c\t", "a b c", "a b c"), ("ſt", "st", "st"), ("", "", ""),
]


def test_ladder_vectors(spark):
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(LADDER)], "k int, t string, a string, b string")
    got = df.select("t", "a", "b", text.normalise(F.col("t"), "L1").alias("x"), text.normalise(F.col("t"), "L2").alias("y"))
    assert [(r.t, r.x, r.y) for r in got.collect() if (r.x, r.y) != (r.a, r.b)] == []
    again = got.select(*[(text.normalise(F.col(c), k) == F.col(c)).alias(c) for c, k in (("x", "L1"), ("y", "L2"))])
    assert all(r.x and r.y for r in again.collect())

def test_locate_quotes(spark):
    pages = spark.createDataFrame([(1, 1, "alpha beta"), (1, 2, "gamma beta"), (1, 3, "delta"), (2, 1, "x")], "doc long, page int, text string")
    quotes = spark.createDataFrame([(10, 1, "beta"), (11, 1, "beta gamma"), (12, 1, ""), (13, 2, "beta"), (14, 1, "beta delta"), (15, 9, "x")], "q long, doc long, quote string")
    got = {r.q: (r.page, r.seam) for r in text.locate_quotes(pages, quotes, "doc", "page", "text", "q", "quote").collect()}
    assert got == {10: (1, False), 11: (1, True), 12: (None, None), 13: (None, None), 14: (2, True), 15: (None, None)}


def test_numbers_in_prose(spark):
    prose = "A mean of 0.47% (t 3.36) over 1,200 months; see `99` and v2.1\n> quoted 7\n```\n8\n```"
    df = spark.createDataFrame([(prose,)], "t string").select(text.number_tokens(text.strip_code(F.col("t"))).alias("n"))
    tokens = df.first().n
    assert tokens == ["0.47%", "3.36", "1", "200"] and "99" not in tokens and "7" not in tokens and "8" not in tokens
    of = lambda *report: df.select(text.verified(F.col("n"), F.array(*map(F.lit, report))).alias("v")).first().v
    assert of(0.00468, 3.3551, 200.4) == [True, True, False, True] and of(0.474, 3.3649) == [True, True, False, False]
    assert of(0.00476, 3.366, 201.0) == [False] * 4
    sci = spark.createDataFrame([("1e-3 -2.5E2% +7",)], "t string").select(text.number_tokens(F.col("t")).alias("n"))
    assert sci.first().n == ["1e-3", "-2.5E2%", "+7"]
    assert sci.select(text.verified(F.col("n"), F.array(F.lit(0.001), F.lit(-2.5), F.lit(6.6))).alias("v")).first().v == [True, True, True]


def test_blocks_and_labels(spark):
    df = spark.createDataFrame([("abcdef", "xbcdey"), (None, "a")], "a string, b string")
    got = df.select(text.similarity_ratio("a", "b").alias("r"), text.common_block("a", "b").alias("c")).collect()
    assert (round(got[0].r, 6), got[0].c) == (round(8 / 12, 6), "bcde") and got[1].c is None
    assert one(spark, text.label_key(F.lit("  Size** "))) == "size" and one(spark, text.null_if_blank(F.lit("  "))) is None
