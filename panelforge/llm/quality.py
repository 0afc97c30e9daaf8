"""A quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

Statistics of the whole text are written once as a narrow table.  The random features approximate a Gaussian kernel
over them; every partition sums its part of the normal equations, and a solution of FEATURES unknowns on the driver
gives the ridge weights.  Labelled rows that the regression doesn't see, as a histogram of its outputs, calibrate
them: pooled neighbours (the isotonic fit) turn an output into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import durable, small_batches
from ._text import codepoints, filled, flat, lists, numbered, pieces_of, tidied

STATISTICS = (
    "log_points", "log_words", "word_length", "letters", "capitals", "digits", "stops", "marks", "symbols", "bangs",
    "bars", "blanks", "lines", "line_length", "word_symbols", "word_capitals", "short_words", "distinct_words",
    "distinct_lines", "entropy", "long_words",
)
FEATURES = 256
#: Of the Gaussian kernel over standardised statistics; the ridge's share of the diagonal.
WIDTH, RIDGE = 6.0, 1e-4
#: Bins of the calibration's histogram, and how many parts of the normal equations one task adds up.
BINS, GROUPS = 2048, 32
RUN_BYTES = 1 << 20

_BLANK, _SMALL, _CAPITAL, _DIGIT, _STOP, _MARK, _SYMBOL, _BANG, _BAR, _LINE, _OTHER = range(11)


def _classes() -> np.ndarray:
    table = np.full(256, _SYMBOL, np.uint8)
    for kind, members in ((_SMALL, "abcdefghijklmnopqrstuvwxyz"), (_CAPITAL, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_DIGIT, "0123456789"), (_STOP, ".?;:"), (_MARK, ",'\"()-"), (_BANG, "!"), (_BAR, "|"), (_BLANK, " \t\x0b\x0c\r"), (_LINE, "\n")):
        table[[ord(c) for c in members]] = kind
    table[0x80:] = _SYMBOL
    table[0xC0:] = _SMALL
    table[0xC0:0xDE] = _CAPITAL
    table[[0xD7, 0xF7]] = _SYMBOL
    return table


_KIND = _classes()


def statistics(column: pa.Array) -> np.ndarray:
    """STATISTICS of each text, a row a text; all zero for an empty one."""
    data, rows = flat(column)
    raw = bytes(data)
    points = codepoints(raw)
    sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(sizes)
    at = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(n), sizes)
    kinds = np.where(points < 256, _KIND[np.minimum(points, 255)], np.where((points >= 0x2000) & (points < 0x3000), _SYMBOL, _SMALL)).astype(np.uint8)
    count = np.bincount(owner * 11 + kinds, minlength=n * 11).reshape(n, 11).astype(float)
    solid = (kinds != _BLANK) & (kinds != _LINE)
    first = np.zeros(len(points) + 1, bool)
    first[at] = True
    before = np.concatenate(([False], solid[:-1])) & ~first[:-1]
    after = np.concatenate((solid[1:], [False])) & ~first[1:]
    begins, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after)
    of_word, length = owner[begins], ends - begins + 1
    per = lambda mask: np.bincount(of_word, weights=mask, minlength=n)
    words = per(np.ones(len(begins)))
    last = kinds[ends]
    capital = np.concatenate(([0], np.cumsum(kinds == _CAPITAL)))
    all_capital = capital[ends + 1] - capital[begins] >= np.maximum(2, 0.6 * length)
    ratio = lambda a, b: a / np.maximum(b, 1)
    letters = count[:, _SMALL] + count[:, _CAPITAL]
    lines, words_apart, entropy = np.zeros((n, 2)), np.zeros(n), np.zeros(n)
    for k, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
        if a < b:
            text = raw[a:b]
            apart = text.split(b"\n")
            lines[k] = len(apart), len(set(apart))
            words_apart[k] = len(set(text.split()))
            bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=1)
            share = bytes_[bytes_ > 0] / (b - a)
            entropy[k] = -(share * np.log2(share)).sum()
    out = np.stack(
        [
            np.log1p(sizes), np.log1p(words), ratio(per(length), words), ratio(letters, sizes), ratio(count[:, _CAPITAL], letters),
            ratio(count[:, _DIGIT], sizes), ratio(count[:, _STOP], words), ratio(count[:, _MARK], words), ratio(count[:, _SYMBOL], sizes), ratio(count[:, _BANG], words),
            ratio(count[:, _BAR], words), ratio(count[:, _BLANK], sizes), ratio(lines[:, 0], words), np.log1p(ratio(sizes, lines[:, 0])), ratio(per((last >= _SYMBOL) & (last <= _BAR)), words),
            ratio(per(all_capital), words), ratio(per(length <= 3), words), ratio(words_apart, words), ratio(lines[:, 1], lines[:, 0]), entropy, ratio(per(length > 12), words),
        ],
        1,
    )
    out[sizes == 0] = 0
    return out


def with_statistics(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` of every row with ``statistics``, an array in the order of STATISTICS; null texts count as empty."""
    small_batches(df.sparkSession)
    source, names, keep = numbered(df, keep, F.col(f"`{text}`").alias("__text__"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "__text__", RUN_BYTES):
                found = statistics(filled(part.column("__text__")))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], lists(found.ravel(), np.arange(part.num_rows + 1) * len(STATISTICS))], [*keep, "statistics"])

    return source.mapInArrow(tidied(run), T.StructType([*[source.schema[c] for c in keep], T.StructField("statistics", T.ArrayType(T.DoubleType()))])).toDF(*names, "statistics")


@dataclass
class Model:
    """Standardisation, random directions, ridge weights, and the calibration's knots."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    low: float
    high: float
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """The random Fourier features, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.directions + self.phases
        return np.concatenate([np.cos(z) * np.sqrt(2 / z.shape[1]), np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Places of the raw outputs in the histogram."""
        return np.clip((self.raw(x) - self.low) / (self.high - self.low) * BINS, 0, BINS - 1).astype(np.int32)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp((self.raw(x) - self.low) / (self.high - self.low) * BINS, self.knots, self.values), 0, 1)


def isotonic(counts: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The monotone fit to the share of ones in bins: middle and value of each pool of bins."""
    pools: list[list[float]] = []  # rows, ones, first bin, last bin
    for k in np.flatnonzero(counts):
        pools.append([counts[k], ones[k], k, k])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n, s, _, b = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + s, pools[-1][2], b]
    knots, values = [], []
    for n, s, a, b in pools:
        knots += [a + 0.5, b + 0.5] if b > a else [a + 0.5]
        values += [s / n] * (1 + (b > a))
    return np.array(knots), np.array(values)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("statistics").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def train(rows: DataFrame, label: str = "label", calibrate: str = "calibrate", seed: int = 0) -> Model | None:
    """A model from rows with ``statistics``, a label 0 or 1 and whether the row calibrates (else it fits the ridge).

    All rows count.  Rows with a null label are left out; None if nothing is left to fit.  If no row calibrates, the
    ridge's output itself, kept from 0 to 1, is the probability.
    """
    rows = rows.filter(F.col(label).isNotNull()).select("statistics", F.col(label).cast("double").alias("y"), F.col(calibrate).alias("c"))
    fitted = rows.filter("not c")
    column = lambda k: F.col("statistics")[k]
    told = fitted.agg(F.count("*"), *[f(column(k)) for k in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]).first()
    if not told[0]:
        return None
    mean, scale = np.array(told[1::2], float), np.array(told[2::2], float)
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((len(STATISTICS), FEATURES)) / WIDTH
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), directions, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), -0.5, 1.5, np.array([0.25 * BINS, 0.75 * BINS]), np.array([0.0, 1.0]))
    d = FEATURES + 1

    def part_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                phi = model.features(_matrix(part))
                total += phi.T @ np.concatenate([phi, part.column("y").to_numpy(zero_copy_only=False)[:, None]], 1)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), lists(total.ravel(), np.array([0, total.size]))], ["g", "sums"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [frame["g"].iloc[0] // GROUPS], "sums": [np.sum(np.stack(frame["sums"].to_numpy()), 0)]})

    parts = durable(fitted.select("statistics", "y").mapInArrow(tidied(part_sums), "g int, sums array<double>"), "sums")
    last = parts.agg(F.max("g")).first()[0]
    while last >= GROUPS:  # a tree: no task, nor the driver, adds up more than GROUPS parts
        parts = durable(parts.groupBy(F.floor(F.col("g") / GROUPS)).applyInPandas(add, "g int, sums array<double>"), "sums")
        last //= GROUPS
    sums = sum(np.array(r.sums) for r in parts.collect()).reshape(d, d + 1)
    gram, right = sums[:, :d], sums[:, d]
    model.weights = np.linalg.solve(gram + RIDGE * gram.trace() / d * np.eye(d), right)

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.bins(_matrix(batch))), batch.column("y")], ["bin", "y"])

    binned = rows.filter("c").select("statistics", "y").mapInArrow(tidied(outputs), "bin int, y double")
    counts, ones = np.zeros(BINS), np.zeros(BINS)
    for r in binned.groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect():  # BINS rows at most
        counts[r.bin], ones[r.bin] = r.n, r.s
    if counts.sum():
        model.knots, model.values = isotonic(counts, ones)
    return model


def score(rows: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` of every row of a table with ``statistics``, and score, the probability of label 1 (0.5 without a model)."""
    source, names, keep = numbered(rows, keep, F.col("statistics"))
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            out = np.full(len(x), 0.5) if shipped.value is None else shipped.value.probability(x)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out)], [*keep, "score"])

    return source.mapInArrow(tidied(run), T.StructType([*[source.schema[c] for c in keep], T.StructField("score", T.DoubleType())])).toDF(*names, "score")


def classify(df: DataFrame, labels: DataFrame, fold: str, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """``doc_id``, ``fold`` and score of every row of ``df``, learned from ``labels`` (doc_id, label).

    ``fold`` is an integer column of ``df``: rows with 0 teach nothing, those with 1 calibrate, the others fit.  Null
    texts count as empty, null and repeated ids stay rows of their own, labels without a document and null labels
    teach nothing, an empty table gives an empty one.
    """
    rows = durable(with_statistics(df, text, [doc_id, fold]), "statistics")
    taught = labels.filter(F.col(f"`{label}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("__id__"), F.col(f"`{label}`").alias("label"))
    taught = rows.filter(F.col(f"`{fold}`") != 0).join(taught, F.col(f"`{doc_id}`") == F.col("__id__"))
    model = train(taught.withColumn("calibrate", F.col(f"`{fold}`") == 1))
    return score(rows, model, [doc_id, fold])
