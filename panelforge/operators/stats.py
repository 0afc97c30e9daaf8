"""Statistics on monthly series: summaries, HAC errors, alignment, costs, regimes, discovery rates, folds."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import normal_cdf, normal_inverse, student_upper, two_sided_p
from .guards import GuardError

EULER_GAMMA = 0.5772156649015329


def auto_lags(n: Column) -> Column:
    """floor(4 (n / 100) ** (2 / 9)), at most n - 1."""
    return F.when(n < 2, 0).otherwise(F.least(F.floor(4 * F.pow(n / 100.0, F.lit(2.0 / 9.0))), n - 1)).cast("int")


def summary(series: DataFrame, by: Sequence[str], date: str, value: str, lags: int | None = None, per_year: int = 12) -> DataFrame:
    """By series: months, mean, mean a year, deviation (ddof 1), Sharpe ratio, Newey-West lags and t of the mean.

    The kernel is Bartlett's, without a small-sample correction.  A series becomes one array, which a single shuffle
    brings together, and its autocovariances are sums of products of the array with itself moved: nothing is joined or
    collected.  A series has a value a month, so arrays are short.
    """
    rows = series.filter(F.col(value).isNotNull())
    told = rows.groupBy(*by).agg(
        F.count("*").alias("n_months"), F.avg(value).alias("average"), F.stddev_samp(value).alias("deviation"), F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        F.sort_array(F.collect_list(F.struct(F.col(date).alias("d"), F.col(value).cast("double").alias("v")))).alias("__s__"),
    )
    used = auto_lags(F.col("n_months")) if lags is None else F.greatest(F.lit(0), F.least(F.lit(lags), F.col("n_months").cast("int") - 1))
    told = told.withColumn("lags", used.cast("int")).withColumn("__u__", F.transform("__s__", lambda x: x["v"] - F.col("average")))
    n = F.col("n_months").cast("int")
    add = lambda total, x: total + x
    moved = lambda lag: F.zip_with(F.slice("__u__", lag + 1, n - lag), F.slice("__u__", F.lit(1), n - lag), lambda u, v: u * v)
    weight = lambda lag: F.when(lag == 0, 1.0).otherwise(2 * (1 - lag / (F.col("lags") + 1)))
    total = F.aggregate(F.sequence(F.lit(0), F.col("lags")), F.lit(0.0), lambda s, lag: s + weight(lag) * F.aggregate(moved(lag), F.lit(0.0), add))
    out = told.withColumn("__h__", F.when(n > 0, total))
    many = (F.col("n_months") >= 2) & (F.col("deviation") > 0)
    return out.select(
        *by,
        "n_months",
        "first_date",
        "last_date",
        "average",
        (F.col("average") * per_year).alias("annualised"),
        F.when(F.col("n_months") >= 2, F.col("deviation")).alias("deviation"),
        F.when(many, F.col("average") / F.col("deviation") * math.sqrt(per_year)).alias("sharpe"),
        F.when(many & (F.col("__h__") > 0), F.col("average") / (F.sqrt("__h__") / F.col("n_months"))).alias("t_stat"),
        "lags",
    )


def hac_regression(y: np.ndarray, x: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Least squares with a constant first: coefficients and Newey-West errors (NaN with under two degrees of freedom)."""
    n = len(y)
    x = np.column_stack([np.ones(n), x])
    k = x.shape[1]
    if n <= k:
        return np.full(k, np.nan), np.full(k, np.nan)
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    if n - k <= 1:
        return beta, np.full(k, np.nan)
    score = x * (y - x @ beta)[:, None]
    lags = max(0, min(lags, n - 1))
    meat = score.T @ score
    for lag in range(1, lags + 1):
        cross = score[lag:].T @ score[:-lag]
        meat += (1 - lag / (lags + 1)) * (cross + cross.T)
    bread = np.linalg.pinv(x.T @ x)
    spread = np.diag(bread @ meat @ bread)
    return beta, np.where(spread > 0, np.sqrt(np.abs(spread)), np.nan)


#: Rules for Newey-West lags by the number of months.
LAG_RULES = {"newey_west_auto": lambda n: math.floor(4 * (n / 100) ** (2 / 9)), "floor_t_pow_0.25": lambda n: math.floor(n**0.25 + 1e-12)}


def regress(series: DataFrame, date: str, value: str, factors: DataFrame, names: Sequence[str], lags: int | str | None = None) -> DataFrame:
    """(term, estimate, t_stat, n_months, lags) of a series on factors over shared complete months.  ``lags`` is a number
    or a rule of LAG_RULES.

    One row a month comes to the driver: at most a few hundred numbers, whatever the panel's size.
    """
    spark = series.sparkSession
    rows = series.select(date, value).join(factors.select(date, *names), date).dropna().orderBy(date).collect()
    y, x = np.array([r[1] for r in rows], float), np.array([list(r[2:]) for r in rows], float).reshape(len(rows), len(names))
    wanted = lags if isinstance(lags, int) else LAG_RULES[lags or "newey_west_auto"](len(y))
    used = min(wanted, max(len(y) - 1, 0)) if len(y) > 1 else 0
    beta, error = hac_regression(y, x, used)
    clean = lambda v: None if not np.isfinite(v) else float(v)
    out = [(n, clean(b), clean(b / e) if np.isfinite(e) and e else None, len(y), used) for n, b, e in zip(["alpha", *names], beta, error, strict=True)]
    return spark.createDataFrame(out, "term string, estimate double, t_stat double, n_months int, lags int")


def crowding(series: DataFrame, date: str, value: str, factors: DataFrame, names: Sequence[str], least: int = 60, lags: int | str = "floor_t_pow_0.25") -> DataFrame:
    """``regress`` on a fixed set of factors with few, whether there are fewer months than ``least``: an alpha next to
    nothing says that the factors already have the series.  It measures and refuses nothing; what can't be estimated is
    null.  With a model's out-of-sample factors (``factors.out_of_sample`` and ``factor_frame``) this is the second view."""
    return regress(series, date, value, factors, names, lags).withColumn("few", F.col("n_months") < least)


def factor_frame(spark: SparkSession, months: Sequence, values: np.ndarray, date: str, kind: str = "date", prefix: str = "factor_") -> tuple[DataFrame, list[str]]:
    """A table of factors by month from a T x K matrix, and the factors' names."""
    names = [f"{prefix}{k + 1}" for k in range(values.shape[1])]
    rows = [(m, *map(float, v)) for m, v in zip(months, values, strict=True)]
    return spark.createDataFrame(rows, ", ".join([f"`{date}` {kind}", *[f"{n} double" for n in names]])), names


def spanning(series: DataFrame, date: str, value: str, factors: DataFrame, names: Sequence[str]) -> dict[str, object]:
    """Alpha and its t with floor(n ** 0.25) lags, R2, variance inflation and largest correlation of the factors, and
    alpha with each factor left out."""
    rows = series.select(date, value).join(factors.select(date, *names), date).dropna().orderBy(date).collect()
    y, x = np.array([r[1] for r in rows], float), np.array([list(r[2:]) for r in rows], float).reshape(len(rows), len(names))
    lags = math.floor(len(y) ** 0.25) if len(y) else 0
    beta, error = hac_regression(y, x, lags)
    fit = np.column_stack([np.ones(len(y)), x]) @ beta if len(y) else y
    r2 = 1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum() if len(y) > 1 else float("nan")
    corr = np.corrcoef(x.T) if x.shape[1] > 1 else np.ones((1, 1))
    vif = np.diag(np.linalg.pinv(corr))
    without = {n: float(hac_regression(y, np.delete(x, k, 1), lags)[0][0]) for k, n in enumerate(names)}
    return {"alpha": float(beta[0]), "t_stat": float(beta[0] / error[0]), "r2": float(r2), "vif": dict(zip(names, vif.tolist(), strict=True)), "max_abs_corr": float(np.abs(corr - np.eye(len(names))).max()), "alpha_without": without, "n_months": len(y)}


def similarity(a: DataFrame, b: DataFrame, date: str, value: str) -> DataFrame:
    """Over shared months: how many, correlation, agreement of signs, mean difference (b - a), its deviation and
    greatest size."""
    both = a.select(date, F.col(value).alias("a")).join(b.select(date, F.col(value).alias("b")), date).dropna()
    d = F.col("b") - F.col("a")
    varied = (F.stddev_pop("a") > 0) & (F.stddev_pop("b") > 0)
    return both.agg(
        F.count("*").alias("n_overlap"), F.when(varied, F.corr("a", "b")).alias("correlation"), F.avg((F.signum("a") == F.signum("b")).cast("double")).alias("sign_agreement"),
        F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("tracking_error"), F.max(F.abs(d)).alias("max_abs_diff"),
    )


def paired_difference(a: DataFrame, b: DataFrame, date: str, value: str) -> DataFrame:
    """Means of both over their own months and over shared ones, and the mean of a - b there (null without any)."""
    both = a.filter(F.col(value).isNotNull()).select(date, F.col(value).alias("a")).join(b.filter(F.col(value).isNotNull()).select(date, F.col(value).alias("b")), date, "full")
    shared = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.agg(
        F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(shared).alias("n_common"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"),
        F.avg(F.when(shared, F.col("a"))).alias("mean_a_common"), F.avg(F.when(shared, F.col("b"))).alias("mean_b_common"), F.avg(F.col("a") - F.col("b")).alias("paired_difference"),
    )


def net_of_costs(gross: DataFrame, turnover: DataFrame, date: str, value: str, bps: float) -> DataFrame:
    """value - bps / 10,000 * turnover on shared months."""
    return gross.join(turnover, date).select(date, (F.col(value) - F.col("turnover") * (bps / 1e4)).alias("net"), F.col(value).alias("gross"), "turnover")


def break_even(gross: DataFrame, turnover: DataFrame, date: str, value: str) -> DataFrame:
    """The cost in bps at which the mean net return is nothing, or why there is none."""
    both = gross.join(turnover, date).agg(F.avg(value).alias("g"), F.avg("turnover").alias("t"), F.count("*").alias("n_months"))
    status = F.when((F.col("n_months") == 0) | (F.col("t") <= 0), "zero_turnover").when(F.col("g") <= 0, "non_positive_gross").otherwise("found")
    return both.select("n_months", status.alias("status"), F.when(status == "found", F.col("g") / F.col("t") * 1e4).alias("break_even_bps"))


def break_even_grid(gross: DataFrame, value: str, rates: Sequence[float]) -> DataFrame:
    """The break-even cost at each assumed constant turnover."""
    mean = gross.agg(F.avg(value).alias("g"))
    return mean.select(F.explode(F.array(*[F.lit(float(r)) for r in rates])).alias("turnover"), "g").select("turnover", F.when(F.col("turnover") > 0, F.try_divide(F.col("g"), F.col("turnover")) * 1e4).alias("break_even_bps"))


def break_even_alpha(gross: DataFrame, turnover: DataFrame, date: str, value: str, factors: DataFrame, names: Sequence[str], registered_bps: float | None = None) -> DataFrame:
    """One row: the cost in bps at which alpha is nothing, alpha of the gross returns over that of turnover, both on the
    same months and factors (alpha is linear in the cost, so there is one root at most), status, both alphas, months, and
    the multiple of a registered cost at which that is."""
    spark = gross.sparkSession
    both = gross.select(date, F.col(value).alias("__g__")).join(turnover.select(date, "turnover"), date).dropna()
    told = {}
    for name, column in (("gross", "__g__"), ("turnover", "turnover")):
        first = regress(both, date, column, factors, names).filter("term = 'alpha'").first()
        told[name], n = first.estimate, first.n_months
    g, t = told["gross"], told["turnover"]
    if g is None or t is None:
        status = "insufficient_observations" if n else "no_common_sample"
    else:
        status = "non_positive_gross" if g <= 0 else "non_positive_turnover_intercept" if t <= 0 else "found"
    bps = g / t * 1e4 if status == "found" else None
    multiple = g / t / (registered_bps / 1e4) if g is not None and t is not None and t > 0 and (registered_bps or 0) > 0 else None
    return spark.createDataFrame([(status, bps, g, t, n, multiple)], "status string, break_even_bps double, alpha_gross double, alpha_turnover double, n_months int, multiple double")


def cost_scenarios(gross: DataFrame, turnover: DataFrame, date: str, value: str, rates: DataFrame, per_year: int = 12) -> DataFrame:
    """(scenario, bps, mean, sharpe, drag_bps) for each row of ``rates`` (scenario, ig_bps, hy_bps): a scenario whose two
    rates are equal and known; others need turnover by rating and are left out.  The series meet a few rows of rates."""
    usable = rates.filter("ig_bps = hy_bps").select("scenario", F.col("ig_bps").cast("double").alias("bps"))
    both = gross.select(date, F.col(value).alias("g")).join(turnover.select(date, "turnover"), date).dropna()
    rows = both.join(F.broadcast(usable), F.lit(True)).withColumn("net", F.col("g") - F.col("bps") / 1e4 * F.col("turnover"))
    out = rows.groupBy("scenario", "bps").agg(F.avg("net").alias("mean"), F.stddev_samp("net").alias("s"), F.avg("turnover").alias("t"))
    return out.select("scenario", "bps", "mean", F.when(F.col("s") > 0, F.col("mean") / F.col("s") * math.sqrt(per_year)).alias("sharpe"), (F.col("bps") * F.col("t")).alias("drag_bps"))


def regime_split(series: DataFrame, states: DataFrame, date: str, value: str, state: str) -> DataFrame:
    """By state: months, mean and deviation of a series."""
    return series.join(states.select(date, state), date).groupBy(state).agg(F.count(value).alias("n_months"), F.avg(value).alias("average"), F.stddev_samp(value).alias("deviation"))


def prediction_contrast(extension: DataFrame, parent: DataFrame, states: DataFrame, date: str, value: str, state: str, predicted: int) -> DataFrame:
    """Mean of extension less parent in the target state and outside it, and whether its sign is the predicted one."""
    rows = extension.select(date, F.col(value).alias("e")).join(parent.select(date, F.col(value).alias("p")), date).join(states.select(date, state), date)
    d = F.col("e") - F.col("p")
    out = rows.agg(F.count_if(F.col(state)).alias("n_target"), F.count_if(~F.col(state)).alias("n_other"), F.avg(F.when(F.col(state), d)).alias("delta_target"), F.avg(F.when(~F.col(state), d)).alias("delta_other"))
    known = (F.col("n_target") > 0) & (F.col("n_other") > 0)
    return out.withColumn("hit", F.when(known, F.signum("delta_target") == predicted))


def benjamini_hochberg(df: DataFrame, p: str, order: Sequence[str], level: float) -> DataFrame:
    """``df`` with rank, adjusted_p and rejected by the step-up rule; a missing p is 1, ties stand by ``order``.

    The tests are one family, so ranks come from a single window: a family is small beside the data that it tests.
    """
    rows = df.withColumn("__p__", F.when(F.col(p).isNull() | F.isnan(p), 1.0).otherwise(F.col(p)))
    rows = rows.withColumn("rank", F.row_number().over(Window.orderBy("__p__", *order)))
    m = F.count("*").over(Window.partitionBy())
    from_top = Window.orderBy(F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__q__", F.col("__p__") * m / F.col("rank"))
    rows = rows.withColumn("adjusted_p", F.least(F.lit(1.0), F.min("__q__").over(from_top)))
    return rows.withColumn("rejected", F.col("adjusted_p") <= level).drop("__p__", "__q__")


def probabilistic_sharpe(sharpe: Column, n: Column, benchmark: Column, skew: Column, kurtosis: Column) -> Column:
    """The probability that the true per-period Sharpe ratio is over the benchmark; kurtosis is 3 for a normal."""
    variance = 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe
    return F.when((n >= 2) & (variance > 0), normal_cdf((sharpe - benchmark) * F.sqrt(n - 1) / F.sqrt(variance)))


def expected_max_sharpe(trials: Column, deviation: Column) -> Column:
    """The expected greatest Sharpe ratio of independent trials; 0 for a single one."""
    best = (1 - EULER_GAMMA) * normal_inverse(1 - 1 / trials) + EULER_GAMMA * normal_inverse(1 - 1 / (trials * math.e))
    return F.when(trials >= 2, deviation * best).otherwise(0.0)


def deflated_sharpe(sharpe: Column, n: Column, trials: Column, deviation: Column, skew: Column, kurtosis: Column) -> Column:
    return probabilistic_sharpe(sharpe, n, expected_max_sharpe(trials, deviation), skew, kurtosis)


def effect_band(value: Column, small: float, moderate: float, large: float) -> Column:
    v = F.abs(value)
    return F.when(v < small, "Negligible").when(v < moderate, "Small").when(v < large, "Moderate").otherwise("Large")


def fold_table(spark: SparkSession, n: int, groups: int, tests: int, purge: int, embargo: int) -> DataFrame:
    """(fold, pos, role): combinatorial folds over positions 0 to n - 1, whose groups differ in size by one at most.

    Train positions within ``purge`` of a test position, or up to ``embargo`` after the end of a run of them, have
    neither role.  The table is made in Spark from one row a fold.
    """
    sizes = [n // groups + (g < n % groups) for g in range(groups)]
    starts = [sum(sizes[:g]) for g in range(groups)]
    combos = list(itertools.combinations(range(groups), tests))
    folds = spark.createDataFrame([(f, [[starts[g], starts[g] + sizes[g] - 1] for g in c]) for f, c in enumerate(combos)], "fold int, blocks array<array<int>>")
    rows = folds.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    inside = F.exists("blocks", lambda b: F.col("pos").between(b[0], b[1]))
    near = F.exists("blocks", lambda b: F.col("pos").between(b[0] - purge, b[1] + purge))
    # the end of a run is a block's end that no other block continues
    after = F.exists("blocks", lambda b: ~F.exists("blocks", lambda c: c[0] == b[1] + 1) & (F.col("pos") > b[1]) & (F.col("pos") <= b[1] + embargo))
    return rows.select("fold", "pos", F.when(inside, "test").when(near | after, "dropped").otherwise("train").alias("role"))


def fold_sharpes(series: DataFrame, by: Sequence[str], date: str, value: str, folds: DataFrame, per_year: int = 12) -> DataFrame:
    """(by, fold, role, n, sharpe): Sharpe ratios of every series over the train and test months of every fold."""
    rows = series.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(date)) - 1)
    both = rows.join(F.broadcast(folds.filter("role <> 'dropped'")), "pos")
    out = both.groupBy(*by, "fold", "role").agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    return out.select(*by, "fold", "role", "n", F.when(F.col("s") > 0, F.col("m") / F.col("s") * math.sqrt(per_year)).alias("sharpe"))


def backtest_overfitting(sharpes: DataFrame, candidate: str) -> DataFrame:
    """(n_folds, pbo, median_rank): in each fold the best candidate in training (ties by name) has a rank among the
    tests' Sharpe ratios, equal ones sharing ranks; pbo is the share of folds where that is below the middle.  A fold's
    side with under two months, or without a Sharpe ratio, can't be ranked, and fewer than two candidates can't be
    compared: both are errors."""
    bad = F.col("sharpe").isNull() | F.isnan("sharpe") | (F.col("n") < 2)
    sharpes = sharpes.withColumn("sharpe", F.when(bad, F.raise_error(F.lit("a fold's side has no Sharpe ratio")).cast("double")).otherwise(F.col("sharpe")))
    first = Window.partitionBy("fold").orderBy(F.col("sharpe").desc(), candidate)
    best = sharpes.filter("role = 'train'").withColumn("__n__", F.row_number().over(first)).filter("__n__ = 1").select("fold", candidate)
    tests = sharpes.filter("role = 'test'")
    equal = Window.partitionBy("fold", "sharpe")
    ranked = tests.withColumn("__r__", F.rank().over(Window.partitionBy("fold").orderBy("sharpe")) + (F.count("*").over(equal) - 1) / 2)
    ranked = ranked.withColumn("__k__", F.count("*").over(Window.partitionBy("fold")))
    ranked = ranked.withColumn("omega", F.col("__r__") / (F.when(F.col("__k__") > 1, F.col("__k__")).otherwise(F.raise_error(F.lit("one candidate can't be compared")).cast("long")) + 1))
    found = best.join(ranked, ["fold", candidate]).withColumn("lambda", F.log(F.col("omega") / (1 - F.col("omega"))))
    return found.agg(F.count("*").alias("n_folds"), F.avg((F.col("lambda") < 0).cast("double")).alias("pbo"), F.median("omega").alias("median_rank"))


def posterior(estimate: Column, error: Column, prior_mean: float, prior_sd: float) -> tuple[Column, Column, Column]:
    """Mean, deviation and probability of being positive after a normal prior."""
    precision = 1 / (error * error) + 1.0 / prior_sd**2
    mean = (estimate / (error * error) + prior_mean / prior_sd**2) / precision
    sd = 1 / F.sqrt(precision)
    return mean, sd, normal_cdf(mean / sd)


def minimum_detectable(deviation: Column, n: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """The mean that a two-sided z test of n draws finds with the given power."""
    z = normal_inverse(F.lit(1 - alpha / 2)) + normal_inverse(F.lit(power))
    return z * deviation / F.sqrt(n)


def mean_p_value(t: Column) -> Column:
    return two_sided_p(t)


def binomial_band(n: int, p: float, level: float = 0.95) -> tuple[int, int]:
    """The equal-tailed acceptance band of a binomial count, exactly."""
    tail = (1 - level) / 2
    cdf = np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
    low = int(np.searchsorted(cdf, tail, side="right"))
    high = int(np.searchsorted(cdf, 1 - tail, side="left"))
    return low, high


def permutation_p(observed: float, draws: DataFrame, value: str) -> DataFrame:
    """(1 + draws at least as far from 0) / (draws + 1)."""
    return draws.agg(((F.count_if(F.abs(value) >= abs(observed)) + 1) / (F.count(value) + 1)).alias("p_value"))


def equivalence_family(df: DataFrame, candidate: str, alpha: str, error: str, n_months: str, margin: float, level: float, least_months: int = 60, regressors: int = 4) -> DataFrame:
    """``df`` with degrees, status, p_lower, p_upper, p_value, adjusted_p and equivalent: two one-sided t tests that alpha
    is inside (-margin, margin), and Benjamini-Hochberg over those that were tested.

    A window shorter than ``least_months`` is ``insufficient_window``: it isn't tested and takes no place in the family.
    Candidates with the same alpha, error and window (to 12 places) are one hypothesis: duplicate_of names the first by
    name, and distinct_p and distinct_equivalent are the family's with one of each, a sensitivity beside it."""
    if margin <= 0:
        raise GuardError("the margin has to be positive")
    rows = df.withColumn("degrees", F.col(n_months) - regressors - 1)
    if bad := rows.filter(~F.coalesce((F.col(error) > 0) & (F.col("degrees") > 0), F.lit(False))).select(candidate).head(3):
        raise GuardError(f"no positive error or no degrees of freedom: {[r[0] for r in bad]}")
    tested = F.col(n_months) >= least_months
    rows = rows.withColumn("status", F.when(tested, "tested").otherwise("insufficient_window"))
    t = lambda shift: F.when(tested, student_upper(shift / F.col(error), F.col("degrees")))
    rows = rows.withColumns({"p_lower": t(F.col(alpha) + margin), "p_upper": t(margin - F.col(alpha))}).withColumn("p_value", F.greatest("p_lower", "p_upper"))
    same = Window.partitionBy(F.round(alpha, 12), F.round(error, 12), n_months)
    first = F.min(candidate).over(same)
    rows = rows.withColumn("duplicate_of", F.when(F.col(candidate) > first, first))
    for out, hit, among in (("adjusted_p", "equivalent", tested), ("distinct_p", "distinct_equivalent", tested & F.col("duplicate_of").isNull())):
        family = benjamini_hochberg(rows.filter(among).select(F.col(candidate).alias("__c__"), "p_value"), "p_value", ["__c__"], level)
        family = family.select("__c__", F.col("adjusted_p").alias(out), F.col("rejected").alias(hit))
        rows = rows.join(family, F.col(candidate) == F.col("__c__"), "left").drop("__c__")
    return rows


def uniform_distance(df: DataFrame, value: str) -> DataFrame:
    """(n, distance, p_value): the Kolmogorov-Smirnov distance of a column of numbers from 0 to 1 from the uniform
    distribution, and Kolmogorov's limit at (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * distance.  Ranks come from counts of
    distinct values."""
    rows = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("k"))
    if rows.filter("v < 0 or v > 1").head(1):
        raise GuardError(f"{value} has numbers outside 0 to 1")
    order = Window.orderBy("v")
    rows = rows.withColumns({"upto": F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("k").over(Window.partitionBy())})
    gap = F.greatest(F.col("upto") / F.col("n") - F.col("v"), F.col("v") - (F.col("upto") - F.col("k")) / F.col("n"))
    out = rows.agg(F.max("n").alias("n"), F.max(gap).alias("distance")).filter("n is not null")
    root = F.sqrt("n")
    reach = (root + 0.12 + 0.11 / root) * F.col("distance")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * reach * reach))
    return out.withColumn("p_value", F.when(reach < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series))))


def robustness(series: DataFrame, date: str, value: str, factors: DataFrame, names: Sequence[str], trials: int, sharpe_deviation: float, information_span: int, holding: int, direction: int = 1, groups: int = 8, tests: int = 2, per_year: int = 12) -> DataFrame:
    """One row: qualified, whether the median Sharpe ratio of the combinatorial test folds has the sign ``direction``;
    folds, their median and the share that is positive; and, as measurements alone, the deflated Sharpe probability
    (``sharpe_deviation`` is that of monthly Sharpe ratios across trials) and alpha and its t on the factors.

    A series with fewer months than groups isn't qualified, which is a result, not an error."""
    if sharpe_deviation <= 0:
        raise GuardError("the deviation of Sharpe ratios across trials has to be a registered positive number")
    spark = series.sparkSession
    rows = series.select(date, value).dropna()
    n = rows.count()
    nothing = spark.createDataFrame([(0, None, None)], "n_folds long, median_sharpe double, share_positive double")
    if n >= groups:
        folds = fold_table(spark, n, groups, tests, information_span, max(1, holding)).filter("role = 'test'")
        sharpes = fold_sharpes(rows, [], date, value, folds, per_year)
        nothing = sharpes.agg(F.count("*").alias("n_folds"), F.median("sharpe").alias("median_sharpe"), F.avg((F.col("sharpe") > 0).cast("double")).alias("share_positive"))
    told = summary(rows, [], date, value, per_year=per_year)
    monthly = F.col("sharpe") / math.sqrt(per_year)
    deflated = deflated_sharpe(monthly, F.col("n_months"), F.lit(trials), F.lit(sharpe_deviation), F.lit(0.0), F.lit(3.0))
    told = told.select("n_months", "sharpe", deflated.alias("deflated_sharpe"))
    alpha = crowding(series, date, value, factors, names).filter("term = 'alpha'").select(F.col("estimate").alias("alpha"), F.col("t_stat").alias("alpha_t"), F.col("n_months").alias("n_shared"))
    out = nothing.join(F.broadcast(told), F.lit(True)).join(F.broadcast(alpha), F.lit(True))
    return out.withColumn("qualified", F.coalesce(F.col("median_sharpe") * direction > 0, F.lit(False)))
