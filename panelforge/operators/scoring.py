"""Scores of extraction and agreement: pooled rates, agreement of raters, coverage, funnels, merges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import two_sided_p, wilson
from .guards import GuardError, require_unique
from .stats import benjamini_hochberg


def pooled(df: DataFrame, group: str, numerator: str, denominator: str) -> DataFrame:
    """By group: its rate, the pooled rate of all others, and for all groups the pooled rate and the mean of the rates."""
    per = df.groupBy(group).agg(F.sum(numerator).alias("k"), F.sum(denominator).alias("n"))
    whole = per.agg(F.sum("k").alias("all_k"), F.sum("n").alias("all_n"), F.avg(F.try_divide("k", "n")).alias("macro"))
    rows = per.join(F.broadcast(whole), F.lit(True))
    return rows.select(group, "k", "n", F.try_divide("k", "n").alias("rate"), F.try_divide("all_k", "all_n").alias("micro"), "macro", F.try_divide(F.col("all_k") - F.col("k"), F.col("all_n") - F.col("n")).alias("without"))


def proportion(df: DataFrame, by: Sequence[str], hit: Column, least: int = 1) -> DataFrame:
    """By group: hits, rows, rate, Wilson interval, and whether there are enough rows to report it."""
    out = df.groupBy(*by).agg(F.count_if(hit).alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return out.withColumns({"rate": F.try_divide("k", "n"), "low": low, "high": high, "reportable": F.col("n") >= least})


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, observed, expected, kappa) of two raters' labels; kappa is null with one category or chance agreement 1.
    Silence, a null label, is a category of its own.

    Only counts by label are joined, so the size of the table doesn't matter after one aggregation."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("silent"))
    cells = pairs.groupBy(named(a).alias("a"), named(b).alias("b")).agg(F.count("*").alias("n"))
    rows, columns = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = rows.join(columns, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("chance"))
    labels = cells.select(F.explode(F.array("a", "b")).alias("x")).agg(F.count_distinct("x").alias("labels"))
    whole = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agree"))
    every = whole.join(F.broadcast(chance), F.lit(True)).join(F.broadcast(labels), F.lit(True))
    every = every.select("n", F.try_divide("agree", "n").alias("observed"), F.try_divide(F.col("chance").cast("double"), F.col("n").cast("double") * F.col("n")).alias("expected"), "labels")
    defined = (F.col("labels") > 1) & (F.abs(1 - F.col("expected")) >= 1e-12)
    return every.select("n", "observed", "expected", F.when(defined, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).alias("kappa"))


def funnel(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """(step, stage, n): rows that pass each stage and all before it."""
    passed, columns = F.lit(True), []
    for name, condition in stages.items():
        passed = passed & F.coalesce(condition, F.lit(False))
        columns.append(F.count_if(passed).alias(name))
    wide = df.agg(*columns)
    return wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("step"), F.lit(n).alias("stage"), F.col(n).alias("n")) for k, n in enumerate(stages)])))


def coverage(df: DataFrame, layers: Mapping[str, Column]) -> DataFrame:
    """(layer, n): rows by the first layer that fails them, ``covered`` if none does."""
    first = reduce(lambda acc, kv: acc.when(~F.coalesce(kv[1], F.lit(False)), kv[0]), list(layers.items())[1:], F.when(~F.coalesce(next(iter(layers.values())), F.lit(False)), next(iter(layers))))
    return df.groupBy(first.otherwise("covered").alias("layer")).agg(F.count("*").alias("n"))


def merge_raters(df: DataFrame, answer_a: str, answer_b: str, found_a: str, found_b: str, quote_a: str, quote_b: str, start_a: str, start_b: str) -> DataFrame:
    """``df`` with verdict, value and quote of two raters' answers (null: silent).

    Both silent: not_stated.  An answer whose quote isn't found: quote_match_failure.  One answer: single_response.
    Different answers, blanks and case aside: disagreement.  Else accepted, with the quote that starts first."""
    a, b = F.col(answer_a), F.col(answer_b)
    key = lambda c: F.lower(F.trim(c))
    lost = (a.isNotNull() & ~F.coalesce(F.col(found_a), F.lit(False))) | (b.isNotNull() & ~F.coalesce(F.col(found_b), F.lit(False)))
    verdict = F.when(a.isNull() & b.isNull(), "not_stated").when(lost, "quote_match_failure").when(a.isNull() | b.isNull(), "single_response").when(key(a) != key(b), "disagreement").otherwise("accepted")
    accepted = F.col("verdict") == "accepted"
    earlier = F.when(F.col(start_b) < F.col(start_a), F.col(quote_b)).otherwise(F.col(quote_a))
    return df.withColumn("verdict", verdict).withColumns({"value": F.when(accepted, a), "quote": F.when(accepted, earlier)})


def distribution(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """By group: rows, least, median and greatest value."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.median(value).alias("middle"), F.max(value).alias("most"))


def stratum(value: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """The name of the half-open interval that holds a value."""
    out = F.when(value < edges[0], names[0])
    for edge, name in zip(edges[1:], names[1:-1], strict=True):
        out = out.when(value < edge, name)
    return out.when(value.isNotNull(), names[-1])


def unique_proposals(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """``df`` with duplicate: whether an earlier row has the same canonical key."""
    return df.withColumn("duplicate", F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1)


def completion(arms: DataFrame, arm: str, completed: str, refused: str) -> DataFrame:
    """``arms`` with conservative, the share that completed where a refusal is a failure, and permissive, the share where
    refusals don't count.  Arms count different things, so there is no pooled rate.  An arm with a negative count, or
    with nothing completed and nothing refused, is an error."""
    done, no = F.col(completed), F.col(refused)
    if bad := arms.filter(~F.coalesce((done >= 0) & (no >= 0) & (done + no > 0), F.lit(False))).select(arm).head(3):
        raise GuardError(f"there is no rate to take for {[r[0] for r in bad]}")
    return arms.withColumns({"conservative": done / (done + no), "permissive": (done > 0).cast("double")})


def in_listed_order(df: DataFrame, key: str, listed: DataFrame, position: str) -> DataFrame:
    """``df`` with ``position``, its key's place in a frozen list (``listed`` has key and position); an error if the list
    names a key twice or lacks one."""
    if listed.groupBy(key).count().filter("count > 1").head(1):
        raise GuardError("the list names a key twice")
    rows = df.join(listed.select(key, position), key, "left")
    if lost := rows.filter(F.col(position).isNull()).select(key).head(3):
        raise GuardError(f"not in the list: {[r[0] for r in lost]}")
    return rows


def select_arms(df: DataFrame, key: str, refused: Column, listed: DataFrame, position: str, most: int) -> DataFrame:
    """(key, position, arm): arm a has every refused member, arm b the first of the others in listed order, as many as arm
    a has and ``most`` at most."""
    rows = in_listed_order(df, key, listed, position).withColumn("__a__", F.coalesce(refused, F.lit(False)))
    rows = rows.withColumn("__n__", F.row_number().over(Window.partitionBy("__a__").orderBy(position)))
    size = rows.agg(F.count_if("__a__").alias("__size__"))
    both = rows.join(F.broadcast(size), F.lit(True))
    return both.filter(F.col("__a__") | (F.col("__n__") <= F.least("__size__", F.lit(most)))).select(key, position, F.when(F.col("__a__"), "a").otherwise("b").alias("arm"))


def draw(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement: those with the least hashes of seed and key, the same on every run and cluster."""
    return df.withColumn("__h__", F.xxhash64(F.lit(seed), F.col(key))).orderBy("__h__", key).limit(n).drop("__h__")


def match_legs(expected: DataFrame, found: DataFrame, spec: str, leg: str, signal: str, control: str) -> DataFrame:
    """(spec, expected leg, found leg): for each spec the pairing of legs, in any order, that agrees in most signals, then
    in most controls; of equal ones the first in the found legs' order.  A single leg on either side is paired as it
    stands.  A spec has a handful of legs, so each spec's pairings are tried where it is."""

    def legs(df: DataFrame, out: str) -> DataFrame:
        return df.groupBy(spec).agg(F.sort_array(F.collect_list(F.struct(F.col(leg).alias("leg"), F.col(signal).alias("s"), F.col(control).alias("c")))).alias(out))

    @F.pandas_udf("array<struct<expected:int,found:int>>")
    def pairs(a: pd.Series, b: pd.Series) -> pd.Series:
        def best(x: Sequence[dict], y: Sequence[dict]) -> list[tuple[int, int]]:
            agree = lambda p, q, n: p[n] is not None and p[n] == q[n]
            worth = lambda p, q: 100 * agree(p, q, "s") + 10 * agree(p, q, "c")
            ways = permutations(range(len(y))) if min(len(x), len(y)) > 1 else [range(len(y))]
            order = max(ways, key=lambda way: sum(worth(p, y[k]) for p, k in zip(x, way, strict=False)))
            return [(int(p["leg"]), int(y[k]["leg"])) for p, k in zip(x, order, strict=False)]

        return pd.Series([best(x, y) for x, y in zip(a, b, strict=True)])

    both = legs(expected, "__a__").join(legs(found, "__b__"), spec)
    out = both.select(spec, F.explode(pairs("__a__", "__b__")).alias("p"))
    return out.select(spec, F.col("p.expected").alias("expected_leg"), F.col("p.found").alias("found_leg"))


def pair_fields(expected: DataFrame, found: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Every expected field with its expected and found value: what the run never gave stays, with null, and what nobody
    expects doesn't appear.  A field that is expected twice is an error."""
    require_unique(expected, keys)
    given = found.select(*keys, F.col(value).alias("found"))
    return expected.select(*keys, F.col(value).alias("expected")).join(given, list(keys), "left")


#: What each step of a proposal's way needs, in order, and the outcome where it is missing.
GATES = (
    ("invalid_proposal", ("schema_valid", "mechanism_authorised", "template_supported", "toggles_preserved", "inputs_available", "not_duplicate")),
    ("execution_failure", ("compiled", "execution_verified")),
    ("audit_failure", ("audit_clean",)),
    ("no_development_evidence", ("bh_survived",)),
    ("not_advanced", ("cpcv_qualified",)),
)


def outcome(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The first of GATES that a row doesn't pass, or ``advanced``; null is not passed."""
    told = F.lit("advanced")
    for name, needs in reversed(GATES):
        passed = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(False)) for c in needs if columns is None or c in columns], F.lit(True))
        told = F.when(~passed, name).otherwise(told)
    return told


def gate_stack(proposals: DataFrame, key: str, signature: Column, alpha: str, t_stat: str, level: float, direction: int = 1) -> DataFrame:
    """``proposals`` with not_duplicate (the first by key of those that compile to one ``signature``), p_value, adjusted_p
    and bh_survived, and outcome.

    One Benjamini-Hochberg family has all proposals that are valid, executed and clean; a survivor is rejected there and
    has an alpha in the strategy's direction.  Proposals that fall before it take no place in the family."""
    first = F.row_number().over(Window.partitionBy(signature).orderBy(key)) == 1
    rows = proposals.withColumn("not_duplicate", first & signature.isNotNull())
    clean = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(False)) for _, needs in GATES[:3] for c in needs])
    rows = rows.withColumn("__clean__", clean).withColumn("p_value", F.when(F.col("__clean__"), two_sided_p(F.col(t_stat))))
    family = benjamini_hochberg(rows.filter("__clean__").select(F.col(key).alias("__k__"), "p_value"), "p_value", ["__k__"], level)
    rows = rows.join(family.select("__k__", "adjusted_p", "rejected"), F.col(key) == F.col("__k__"), "left")
    rows = rows.withColumn("bh_survived", F.coalesce(F.col("rejected") & (F.col(alpha) * direction > 0), F.lit(False)))
    return rows.withColumn("outcome", outcome(rows)).drop("__clean__", "__k__", "rejected")


def mismatches(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """(spec, leg, field, value, detail): stated values that a table of rules (field, value, detail) calls incompatible,
    all of them.  Values that were inferred, designed or not found never mismatch."""
    stated = fields.filter("tag = 'STATED'")
    return stated.join(F.broadcast(rules), ["field", "value"]).select("spec", "leg", "field", "value", "detail")
