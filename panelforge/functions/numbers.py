"""Numeric columns: normal distribution, intervals, ratings, labels, arrays."""

from __future__ import annotations

from collections.abc import Callable
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Coefficients of a rational approximation to the normal tail (full double precision).
TAIL_NUMERATOR = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_DENOMINATOR = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
#: Coefficients of Acklam's inverse normal distribution.
INVERSE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239)
INVERSE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
INVERSE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
INVERSE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416, 1.0)
INVERSE_EDGE = 0.02425

#: Fixed list: rating letters from best to worst, 1 to 22.
RATINGS = ("AAA", "AA+", "AA", "AA-", "A+", "A", "A-", "BBB+", "BBB", "BBB-", "BB+", "BB", "BB-", "B+", "B", "B-", "CCC+", "CCC", "CCC-", "CC", "C", "D")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every NaN of a float or double column as null: the engine's only missing value."""
    kinds = dict(df.dtypes)
    return df.select([F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + c, coefficients[1:], F.lit(coefficients[0]))


def _bound(x: Column, formula: Callable[[Column], Column]) -> Column:
    """The formula of x with x computed once, however often it stands in it."""
    return F.get(F.transform(F.array(x), formula), 0)


def normal_cdf(x: Column) -> Column:
    def formula(v: Column) -> Column:
        a = F.abs(v)
        near = F.exp(-a * a / 2) * _horner(TAIL_NUMERATOR, a) / _horner(TAIL_DENOMINATOR, a)
        far = F.exp(-a * a / 2) / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
        tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, near).otherwise(far)
        return F.when(v > 0, 1 - tail).otherwise(tail)

    return _bound(x, formula)


def normal_inverse(p: Column) -> Column:
    """Null outside (0, 1)."""
    tail = lambda z: _bound(z, lambda v: _horner(INVERSE_C, v) / _horner(INVERSE_D, v))

    def formula(v: Column) -> Column:
        q = v - 0.5
        middle = _bound(q * q, lambda r: _horner(INVERSE_A, r) / _horner(INVERSE_B, r)) * q
        edges = F.when(v < INVERSE_EDGE, tail(F.sqrt(-2 * F.log(v)))).when(v > 1 - INVERSE_EDGE, -tail(F.sqrt(-2 * F.log(1 - v))))
        return F.when((v > 0) & (v < 1), edges.otherwise(middle))

    return _bound(p, formula)


def student_upper(t: Column, degrees: Column) -> Column:
    """The upper tail of Student's t with a whole number of degrees of freedom, by the finite sums in the angle
    atan(t / sqrt(degrees)); an error for other degrees."""
    whole = F.when((degrees >= 1) & (degrees == F.floor(degrees)), degrees.cast("long")).otherwise(F.raise_error(F.lit("degrees of freedom have to be a whole number from 1")).cast("long"))
    square = whole / (whole + t * t)  # of the cosine
    even = whole % 2 == 0
    first = F.when(even, 1.0).otherwise(F.sqrt(square))
    # term j is term j - 1 times the square and (2j - 1) / 2j, or 2j / (2j + 1) for odd degrees
    start = F.struct(first.alias("term"), F.when(even | (whole > 1), first).otherwise(0.0).alias("total"))
    more = F.when(even, whole / 2 - 1).otherwise((whole - 3) / 2).cast("int")

    def step(s: Column, j: Column) -> Column:
        term = s["term"] * square * F.when(even, (2 * j - 1) / (2 * j)).otherwise(2 * j / (2 * j + 1))
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    steps = F.when(more >= 1, F.sequence(F.lit(1), F.greatest(more, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, start, step, lambda s: s["total"])
    sine = F.sqrt(1 - square) * F.signum(t)
    middle = F.when(even, sine * total).otherwise((F.atan(t / F.sqrt(whole)) + sine * total) * (2 / math.pi))
    return F.when(t.isNotNull(), (1 - middle) / 2)


#: Fixed list: the second agency's letters from 1 to 21.
SECOND_RATINGS = ("Aaa", "Aa1", "Aa2", "Aa3", "A1", "A2", "A3", "Baa1", "Baa2", "Baa3", "Ba1", "Ba2", "Ba3", "B1", "B2", "B3", "Caa1", "Caa2", "Caa3", "Ca", "C")


def two_sided_p(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson interval of a proportion; null without trials."""
    p = F.try_divide(k, n)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - half)), F.when(some, F.least(F.lit(1.0), centre + half))


def rating_number(letters: Column, second: Column | bool = False) -> Column:
    """1 (best) to 22 of the first agency's letters, 1 to 21 of the ``second`` one's; null for not rated, withdrawn or
    unknown letters, which count as they are written."""
    number = lambda names: F.element_at(F.create_map(*[x for k, r in enumerate(names) for x in (F.lit(r), F.lit(k + 1))]), F.trim(letters))
    return F.when(second if isinstance(second, Column) else F.lit(second), number(SECOND_RATINGS)).otherwise(number(RATINGS))


def agency_label(**present: Column) -> Column:
    """Names of the agencies that hold, joined by +."""
    return F.concat_ws("+", *[F.when(c, F.lit(n)) for n, c in present.items()])


def first_exit(**dates: Column) -> tuple[Column, Column]:
    """The least of the dates and its label; of equal dates the label given first; nulls don't count."""
    found = F.array(*[F.struct(d.alias("day"), F.lit(k).alias("order"), F.lit(n).alias("label")) for k, (n, d) in enumerate(dates.items())])
    least = F.array_min(F.filter(found, lambda x: x["day"].isNotNull()))
    return least["day"], least["label"]


def guarded_ratio(a: Column, b: Column) -> Column:
    """a / b with the denominator moved off zero by 1e-10."""
    return a / (b + 1e-10)


def median(values: Column) -> Column:
    """The exact median of an array without nulls; null if it is empty."""
    ordered, n = F.array_sort(values), F.size(values)
    at = lambda k: F.get(ordered, k)
    return F.when(n > 0, (at(F.floor((n - 1) / 2).cast("int")) + at(F.floor(n / 2).cast("int"))) / 2)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, their norms moved off zero by 1e-12."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))) / ((norm(a) + 1e-12) * (norm(b) + 1e-12))
