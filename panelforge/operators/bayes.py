"""Posteriors of effects: a normal prior over correlated estimates, and a population of effects with its prevalence.

Inputs are a few dozen numbers, one for each coordinate or strategy; draws are exact, not a chain."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .guards import GuardError


def floored_covariance(v: np.ndarray, floor: float) -> tuple[np.ndarray, int]:
    """The symmetric part of a matrix with eigenvalues of at least ``floor``, and how many were raised."""
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    return vectors @ np.diag(np.maximum(values, floor)) @ vectors.T, int((values <= floor).sum())


def beyond(mean: float, sd: float, threshold: float) -> float:
    """The probability of being farther from 0 than the threshold."""
    if sd <= 0:
        return float(abs(mean) > threshold)
    d = NormalDist(mean, sd)
    return min(1.0, max(0.0, d.cdf(-threshold) + 1 - d.cdf(threshold)))


@dataclass(frozen=True)
class Posterior:
    mean: np.ndarray
    covariance: np.ndarray
    raised: int
    shift_if_diagonal: float

    def table(self, names: Sequence[str], threshold: float) -> list[tuple]:
        sd = np.sqrt(np.maximum(np.diag(self.covariance), 0))
        z = NormalDist().inv_cdf(0.975)
        return [(n, float(m), float(s), float(m - z * s), float(m + z * s), 1 - NormalDist(m, s).cdf(0) if s > 0 else float(m > 0), beyond(m, s, threshold)) for n, m, s in zip(names, self.mean, sd, strict=True)]


def normal_posterior(estimate: np.ndarray, covariance: np.ndarray, prior_sd: float, floor: float) -> Posterior:
    """Estimates with a covariance and independent N(0, prior_sd ** 2) priors; with how far the means would move if
    the covariance were diagonal."""
    if not len(estimate):
        raise GuardError("no coordinates")
    safe, raised = floored_covariance(np.atleast_2d(covariance), floor)
    ridge = np.eye(len(estimate)) / prior_sd**2

    def solve(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        precision = np.linalg.inv(v)
        spread = np.linalg.inv(precision + ridge)
        return spread @ precision @ estimate, spread

    mean, spread = solve(safe)
    other, _ = solve(np.diag(np.diag(safe)))
    return Posterior(mean, spread, raised, float(np.abs(mean - other).max()))


@dataclass(frozen=True)
class Population:
    """Draws of a population's mean and deviation and of its members' effects."""

    mean: np.ndarray
    deviation: np.ndarray
    effects: np.ndarray
    runnable: int

    def prevalence(self, threshold: float) -> float:
        """The share of all runnable members whose effect is beyond the threshold; members known to be inert count as 0."""
        return float((np.abs(self.effects) > threshold).mean(0).sum() / self.runnable) if self.runnable else 0.0


def population(estimates: Sequence[float], variances: Sequence[float], inert: Sequence[bool], mean_sd: float = 1.0, deviation_scale: float = 1.0, draws: int = 2000, seed: int = 0) -> Population:
    """Effects from N(mean, deviation ** 2), measured with known variances; priors N(0, mean_sd ** 2) and half-normal.

    The deviation's posterior, the rest integrated out, is evaluated on a fine grid and sampled; mean and effects then
    have normal distributions, so the draws are independent.
    """
    live = ~np.asarray(inert, bool)
    y, v = np.asarray(estimates, float)[live], np.maximum(np.asarray(variances, float)[live], 1e-12)
    if not len(y):
        return Population(np.full(draws, np.nan), np.full(draws, np.nan), np.zeros((draws, 0)), len(live))
    top = max(10 * deviation_scale, 10 * float(np.std(y)))
    grid = np.exp(np.linspace(math.log(1e-5 * deviation_scale), math.log(top), 1200))
    w = 1 / (v + grid[:, None] ** 2)
    precision = w.sum(1) + 1 / mean_sd**2
    centre = (w * y).sum(1) / precision
    log = 0.5 * np.log(w).sum(1) - 0.5 * np.log(precision) - 0.5 * ((w * y**2).sum(1) - precision * centre**2) - grid**2 / (2 * deviation_scale**2) + np.log(grid)
    p = np.exp(log - log.max())
    rng = np.random.default_rng(seed)
    at = rng.choice(len(grid), size=draws, p=p / p.sum())
    tau = grid[at]
    mu = centre[at] + rng.standard_normal(draws) / np.sqrt(precision[at])
    shrink = 1 / (1 / v + 1 / tau[:, None] ** 2)
    effects = shrink * (y / v + (mu / tau**2)[:, None]) + rng.standard_normal((draws, len(y))) * np.sqrt(shrink)
    return Population(mu, tau, effects, len(live))


def joint_population(estimates: np.ndarray, covariances: Sequence[np.ndarray], present: np.ndarray, mean_sd: float = 1.0, deviation_scale: float = 1.0, draws: int = 1500, burn: int = 300, floor: float = 1e-10, seed: int = 0) -> dict[str, np.ndarray]:
    """Populations of all coordinates at once: strategies x coordinates of estimates, a full measurement covariance for
    each strategy over its present coordinates, independent populations.

    Each sweep draws every strategy's effects from their joint normal, then each coordinate's mean, and its deviation
    from its conditional on a grid.  Returns draws of means and deviations (draws x coordinates) and of effects
    (draws x strategies x coordinates, NaN where absent).
    """
    rng = np.random.default_rng(seed)
    count, coordinates = estimates.shape
    precisions = [np.linalg.inv(floored_covariance(np.atleast_2d(v), floor)[0]) if own.any() else None for v, own in zip(covariances, present, strict=True)]
    effects = np.where(present, np.nan_to_num(estimates), np.nan)
    mean = np.nan_to_num(np.nanmean(effects, 0)) if count else np.zeros(coordinates)
    deviation = np.full(coordinates, deviation_scale)
    grid = np.exp(np.linspace(math.log(1e-4 * deviation_scale), math.log(20 * deviation_scale), 400))
    out = {"mean": np.zeros((draws, coordinates)), "deviation": np.zeros((draws, coordinates)), "effects": np.full((draws, count, coordinates), np.nan)}
    for sweep in range(-burn, draws):
        for s in range(count):
            own = present[s]
            if precisions[s] is None:
                continue
            ridge = np.diag(1 / deviation[own] ** 2)
            spread = np.linalg.inv(precisions[s] + ridge)
            centre = spread @ (precisions[s] @ estimates[s, own] + ridge @ mean[own])
            effects[s, own] = centre + np.linalg.cholesky((spread + spread.T) / 2) @ rng.standard_normal(int(own.sum()))
        for c in range(coordinates):
            e = effects[present[:, c], c]
            precision = len(e) / deviation[c] ** 2 + 1 / mean_sd**2
            mean[c] = e.sum() / deviation[c] ** 2 / precision + rng.standard_normal() / math.sqrt(precision)
            log = -len(e) * np.log(grid) - ((e - mean[c]) ** 2).sum() / (2 * grid**2) - grid**2 / (2 * deviation_scale**2) + np.log(grid)
            p = np.exp(log - log.max())
            deviation[c] = grid[np.searchsorted(np.cumsum(p), rng.random() * p.sum())]
        if sweep >= 0:
            out["mean"][sweep], out["deviation"][sweep], out["effects"][sweep] = mean, deviation, effects
    return out


def variance_of_interval(low: float, high: float, level: float = 0.95) -> float:
    if high < low:
        raise GuardError("the interval is inverted")
    return ((high - low) / (2 * NormalDist().inv_cdf(0.5 + level / 2))) ** 2


def populations(effects: DataFrame, by: str, estimate: str, low: str, high: str, inert: str, threshold: float, draws: int = 2000, seed: int = 0) -> DataFrame:
    """By coordinate: members, live members, mean and deviation with intervals, prevalence.  Coordinates run in
    parallel, each with a row for every strategy."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = population(frame[estimate], [variance_of_interval(a, b) for a, b in zip(frame[low], frame[high], strict=True)], frame[inert], draws=draws, seed=seed)
        q = lambda x: np.percentile(x, [2.5, 97.5]) if found.effects.shape[1] else (np.nan, np.nan)
        return pd.DataFrame({by: [frame[by].iloc[0]], "n": [found.runnable], "n_live": [found.effects.shape[1]], "mean": [found.mean.mean()], "mean_low": [q(found.mean)[0]], "mean_high": [q(found.mean)[1]], "deviation": [found.deviation.mean()], "prevalence": [found.prevalence(threshold)]})

    kind = effects.schema[by].dataType.simpleString()
    return effects.groupBy(by).applyInPandas(run, f"`{by}` {kind}, n long, n_live long, mean double, mean_low double, mean_high double, deviation double, prevalence double")


def calibrate(spark, magnitudes: Sequence[float], seeds: int, trial) -> DataFrame:
    """(magnitude, seed, effect, detected) of a trial at every magnitude and seed, in parallel.

    ``trial(magnitude, rng)`` makes data with an effect of that size and returns the estimate and whether it is found;
    the share found at magnitude 0 is the false positive rate."""
    grid = spark.createDataFrame([(float(m), s) for m in magnitudes for s in range(seeds)], "magnitude double, seed int")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [trial(m, np.random.default_rng([s, int(m * 1e9)])) for m, s in zip(frame["magnitude"], frame["seed"], strict=True)]
            yield frame.assign(effect=[float(e) for e, _ in found], detected=[bool(d) for _, d in found])

    return grid.repartition(min(len(magnitudes) * seeds, 32)).mapInPandas(run, "magnitude double, seed int, effect double, detected boolean")


def least_detected(records: DataFrame, power: float = 0.8) -> DataFrame:
    """By magnitude the share found, and whether it is the least one from which all larger ones reach the power."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rate = records.groupBy("magnitude").agg(F.avg(F.col("detected").cast("double")).alias("rate"), F.count("*").alias("n"))
    onward = F.min("rate").over(Window.orderBy(F.col("magnitude").desc()).rowsBetween(Window.unboundedPreceding, 0))
    ok = rate.withColumn("ok", onward >= power)
    return ok.withColumn("least", F.col("ok") & (F.col("magnitude") == F.min(F.when(F.col("ok"), F.col("magnitude"))).over(Window.partitionBy()))).drop("ok")
