"""Block bootstraps whose replicates run in parallel, each from its own seed."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .guards import GuardError


def circular_positions(n: int, block: int, rng: np.random.Generator) -> np.ndarray:
    """n positions in blocks of fixed length that start anywhere and wrap around."""
    starts = rng.integers(0, n, size=-(-n // block))
    return ((starts[:, None] + np.arange(block)) % n).ravel()[:n]


def stationary_positions(n: int, block: int, rng: np.random.Generator) -> np.ndarray:
    """The same with geometric lengths of mean ``block``: a position starts a new block with probability 1 / block."""
    new = rng.random(n) < 1.0 / block
    new[0] = True
    at = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    return (rng.integers(0, n, size=len(at))[which] + np.arange(n) - at[which]) % n


def months_matrix(series: DataFrame, by: str, date: str, value: str) -> tuple[list, np.ndarray]:
    """Names and values (months x series) on the months that all series have: a few hundred rows for the driver."""
    wide = series.groupBy(date).pivot(by).agg(F.first(value)).dropna().orderBy(date).toPandas()
    return list(wide.columns[1:]), wide.iloc[:, 1:].to_numpy(float)


def block_bootstrap(series: DataFrame, by: str, date: str, value: str, replicates: int = 1000, block: int = 6, seed: int = 0, scheme: str = "circular", least_blocks: int = 10, statistic: Callable[[np.ndarray], Sequence[float]] | None = None) -> DataFrame:
    """(replicate, series, value): a statistic of every series on resampled months, the same months for all series.

    The default statistic is the mean.  ``statistic`` gets the resampled matrix and returns a number a series.
    Replicate r draws from a stream of (seed, r), so results don't depend on how replicates are dealt to tasks.
    """
    if scheme not in ("circular", "stationary"):
        raise GuardError(f"unknown scheme {scheme!r}")
    names, matrix = months_matrix(series, by, date, value)
    n = len(matrix)
    if not n or block >= n or n // block < least_blocks:
        raise GuardError(f"{n} shared months are too few for blocks of {block}")
    draw = circular_positions if scheme == "circular" else stationary_positions
    find = statistic or (lambda m: m.mean(0))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [find(matrix[draw(n, block, np.random.default_rng([seed, int(r)]))]) for r in frame["id"]]
            yield pd.DataFrame({"replicate": np.repeat(frame["id"].to_numpy(), len(names)), "series": [str(x) for x in names] * len(rows), "value": np.concatenate(rows) if rows else np.zeros(0)})

    return series.sparkSession.range(replicates).mapInPandas(run, "replicate long, series string, value double")


def intervals(draws: DataFrame, level: float = 0.95) -> DataFrame:
    """By series: draws, mean, deviation, percentile interval and two-sided p of zero."""
    tail = (1 - level) / 2
    below = F.avg((F.col("value") <= 0).cast("double"))
    above = F.avg((F.col("value") >= 0).cast("double"))
    return draws.groupBy("series").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"), F.percentile("value", tail).alias("low"), F.percentile("value", 1 - tail).alias("high"), F.least(F.lit(1.0), 2 * F.least(below, above)).alias("p_value"))


def paired_bootstrap(a: DataFrame, b: DataFrame, date: str, value: str, **options: object) -> DataFrame:
    """Draws of the mean of a - b over shared months."""
    both = a.select(date, F.col(value).alias("a")).join(b.select(date, F.col(value).alias("b")), date)
    return block_bootstrap(both.select(date, F.lit("difference").alias("by"), (F.col("a") - F.col("b")).alias("value")), "by", date, "value", **options)


def alpha_bootstrap(series: DataFrame, date: str, value: str, factors: DataFrame, names: Sequence[str], **options: object) -> DataFrame:
    """Draws of the intercept of a series on factors, months resampled together."""
    rows = series.select(date, F.col(value).alias("y")).join(factors.select(date, *names), date).dropna()
    cells = [F.struct(F.lit(f"{k:02}").alias("by"), F.col(c).cast("double").alias("value")) for k, c in enumerate(["y", *names])]
    long = rows.select(date, F.inline(F.array(*cells)))

    def alpha(m: np.ndarray) -> list[float]:
        x = np.column_stack([np.ones(len(m)), m[:, 1:]])
        return [float(np.linalg.lstsq(x, m[:, 0], rcond=None)[0][0])] + [0.0] * (m.shape[1] - 1)

    return block_bootstrap(long, "by", date, "value", statistic=alpha, **options).filter("series = '00'")
