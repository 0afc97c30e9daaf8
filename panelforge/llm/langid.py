"""Language identification by a bidirectional gated recurrent network over bytes.

A text's letters (ASCII ones as small letters, all bytes of other characters) and single blanks for what stands between
them are cut into windows of at most WINDOW bytes, at blanks where there are any and never inside a character.  Over
each window one network runs forwards and one backwards, across its words, so every byte gets probabilities of the
languages from what stands before and after it; a document's probabilities are the mean over all its letters' bytes.
numpy trains the network by backpropagation through time: a bounded sample of the labelled rows gives the values from
which it starts, then every window of every labelled text takes part in ROUNDS steps (``learn``).
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import durable, small_batches
from ._text import filled, flat, lists, numbered, pieces_of, tidied

WINDOW = 64
HIDDEN = 16
#: The bound of the sample: documents of a language, characters of such a document, and characters of all languages.
#: Of a longer text as many are taken in PIECES spread over all of it; with many languages each has less.
SAMPLE_DOCUMENTS, SAMPLE_POINTS, SAMPLE_TOTAL, PIECES = 300, 20_000, 24_000_000, 20
STEPS, BATCH, RATE = 400, 96, 0.02
#: Steps over all labelled rows, each row in one of them; the tasks whose sums come to the driver, at most; windows that go
#: through the gradients together; and bins of the scores whose median gives the limit.
ROUNDS, TASKS, LEARNED_ROWS, BINS = 8, 256, 256, 10_000
#: The mean probability of its language over a window's letters from which the loss of the steps over all rows is flat.
CERTAIN = 0.9
RUN_BYTES = 1 << 19
#: Windows that go through the network together, and the most probabilities that they have.
ROWS, OUTPUTS = 384, 8 << 20
#: Languages up to which their shares of the rows are broadcast, so that texts are sampled before any shuffle.
BROADCAST_LANGUAGES = 10_000
UNKNOWN = "und"

BLANK = 32
#: Capitals to small letters, other ASCII characters than letters to blanks.
_FOLD = np.array([b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else BLANK for b in range(256)], np.uint8)
_NO_LETTER = bytes(b for b in range(256) if b >= 0x80 or not chr(b).isalpha())


def folded(raw: bytes) -> tuple[bytes, np.ndarray]:
    """What the network reads of UTF-8 bytes, and where each byte of it stands in them."""
    data = _FOLD[np.frombuffer(raw, np.uint8)]
    solid = data != BLANK
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # a blank stays after a letter
    at = np.flatnonzero(keep)
    return data[at].tobytes(), at


def cuts(data: bytes) -> list[int]:
    """Where the windows of folded bytes begin, and their end."""
    found, start, n = [0], 0, len(data)
    while n - start > WINDOW:
        stop = data.rfind(b" ", start + 1, start + WINDOW) + 1
        if not stop:
            stop = start + WINDOW
            while stop > start + WINDOW - 4 and data[stop] & 0xC0 == 0x80:
                stop -= 1
        found.append(stop)
        start = stop
    return [*found, n] if n else [0]


def windows(raw: bytes) -> np.ndarray:
    """The windows of a text as a matrix of bytes, blanks after the shorter ones."""
    data, _ = folded(raw)
    at = cuts(data)
    return _padded([data[a:b] for a, b in zip(at, at[1:], strict=False)])


def _padded(found: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(WINDOW) for x in found), np.uint8).reshape(-1, WINDOW)


_LENT = threading.local()


def _space(name: str, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
    """An array without values, the same memory at each call of this thread: fresh memory costs more than what is put there."""
    need = int(np.prod(shape)) * np.dtype(kind).itemsize
    if (held := getattr(_LENT, name, None)) is None or len(held) < need:
        setattr(_LENT, name, held := np.empty(need, np.uint8))
    return held[:need].view(kind).reshape(shape)


@dataclass
class Model:
    """Parameters by name; ``symbols`` has the network's input for each byte, 0 for those that weren't learned."""

    languages: list[str]
    symbols: np.ndarray
    p: dict[str, np.ndarray]
    #: The score from which a text counts as one of the languages.
    least: float = 0.0
    #: Mean squares of the gradients of the sample's steps, by parameter: the scale of the steps over all rows.
    second: dict[str, np.ndarray] | None = None

    def _gates(self) -> tuple[np.ndarray, np.ndarray]:
        """Inputs (gates x directions x symbols) x HIDDEN and recurrent weights gates x directions x HIDDEN x HIDDEN.  The
        logistic gates are half of 1 + tanh of half: the halves are in these weights, and r's in those of what it meets."""
        hidden = self.p["uf"].shape[0]
        cut = lambda v: v.reshape(len(v), 3, hidden).transpose(1, 0, 2)
        w = np.stack([cut(self.p[f"w{s}"] + self.p[f"b{s}"]) for s in "fb"], 1)
        w[:2] *= 0.5
        return w.reshape(-1, hidden), np.stack([cut(self.p[f"u{s}"]) for s in "fb"], 1) * w.dtype.type(0.5)

    def _states(self, x: np.ndarray, trace: list[np.ndarray] | None = None) -> np.ndarray:
        """States of windows (steps x rows of symbols): directions x steps x rows x HIDDEN, the backward direction's from
        the last step on.  Both go together and each gate's values lie in one piece, which numpy is fastest with.
        ``trace`` gets what the gradients need: the slopes of z and r, r itself, the slope of c, and z.  All of these are
        lent, until the next call in this thread."""
        w, u = self._gates()
        hidden, (steps, rows) = u.shape[-1], x.shape
        out = _space("states", (2, steps, rows, hidden), u.dtype)
        if trace is not None:
            trace.append(_space("trace", (5, *out.shape), u.dtype))
        a, g = (np.empty((3, 2, rows, hidden), u.dtype) for _ in range(2))
        h, c, d = (np.zeros((2, rows, hidden), u.dtype) for _ in range(3))
        base, both = np.arange(6).reshape(3, 2, 1) * (len(w) // 6), np.stack([x, x[::-1]])
        at = np.empty((3, 2, rows), np.intp)
        for t in range(steps):
            np.add(base, both[:, t], out=at)
            np.take(w, at, axis=0, out=a, mode="clip")
            np.matmul(h, u, out=g)
            zr, rg = a[:2], g[2]
            zr += g[:2]
            np.tanh(zr, out=zr)
            zr += 1
            z = a[0]
            z *= 0.5
            rg *= a[1]
            np.add(a[2], rg, out=c)
            np.tanh(c, out=c)
            np.subtract(h, c, out=d)
            d *= z
            h = out[:, t]
            np.add(d, c, out=h)
            if trace is not None:
                of_z, of_r, kept_r, of_c, kept_z = trace[0][:, :, t]
                kept_z[...] = z
                np.multiply(a[1], 0.5, out=kept_r)
                np.subtract(1, z, out=z)
                np.multiply(d, z, out=of_z)
                c *= c
                np.subtract(1, c, out=c)
                np.multiply(c, z, out=of_c)
                np.subtract(1, kept_r, out=d)
                np.multiply(rg, d, out=of_r)
        return out

    def _probabilities(self, states: np.ndarray) -> np.ndarray:
        """Of the languages at each byte of windows, from their states: languages x steps x rows."""
        _, steps, rows, hidden = states.shape
        o = np.ascontiguousarray(self.p["o"].T)
        out = (o[:, :hidden] @ states[0].reshape(-1, hidden).T).reshape(-1, steps, rows)
        out += (o[:, hidden:] @ states[1].reshape(-1, hidden).T).reshape(-1, steps, rows)[:, ::-1]
        out += self.p["c"][:, None, None]
        out -= out.max(0)
        np.exp(out, out=out)
        out /= out.sum(0)
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at each byte of windows (steps x rows of symbols): steps x rows x languages."""
        return self._probabilities(self._states(x)).transpose(1, 2, 0)

    def sums(self, found: np.ndarray) -> np.ndarray:
        """Probabilities summed over the letters' bytes of each window; bytes that weren't learned have none."""
        out = np.empty((len(found), len(self.languages)), np.float32)
        for start in range(0, len(found), self.rows):
            part = found[start : start + self.rows]
            x = self.symbols[part.T]
            counted = ((x > 0) & (part.T != BLANK)).astype(np.float32)
            told = self._probabilities(self._states(x))
            told *= counted
            out[start : start + self.rows] = told.sum(1).T
        return out

    @property
    def rows(self) -> int:
        """Windows at once: fewer with many languages."""
        return max(8, min(ROWS, OUTPUTS // (WINDOW * max(1, len(self.languages)))))

    def score(self, text: str) -> float | None:
        """The greatest mean probability over the bytes of a text's letters."""
        found = windows(text.encode())
        n = int((found != BLANK).sum())
        return float(self.sums(found).sum(0).max()) / n if n else None

    def gradients(self, x: np.ndarray, y: np.ndarray, counted: np.ndarray, told: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """The mean loss over the ``counted`` bytes of the windows ``x`` (steps x rows of symbols) in languages ``y``,
        and its gradients.  ``told`` (rows x languages) gets each window's sums as in ``sums``."""
        kept: list[np.ndarray] = []
        states = self._states(x, kept)
        probs = self._probabilities(states)
        if told is not None:
            told[:] = (probs * ((counted > 0) & (x > 0))).sum(1).T
        share = (counted / max(1, counted.sum())).astype(probs.dtype)
        steps, rows = x.shape
        own = y, slice(None), np.arange(rows)
        loss = -float((np.log(probs[own] + 1e-9) * share.T).sum())
        probs[own] -= 1
        probs *= share
        hidden, flat_states = states.shape[-1], states.reshape(2, steps * rows, -1)
        wrong = [probs.reshape(len(probs), -1), probs[:, ::-1].reshape(len(probs), -1)]
        grads = {"o": np.concatenate([flat_states[k].T @ wrong[k].T for k in range(2)]), "c": wrong[0].sum(1)}
        back = _space("back", states.shape, states.dtype)
        for k in range(2):
            np.matmul(wrong[k].T, self.p["o"][k * hidden : (k + 1) * hidden].T, out=back[k].reshape(-1, hidden))
        u = np.stack([self.p[f"u{s}"].reshape(hidden, 3, hidden).transpose(1, 2, 0) for s in "fb"], 1).copy()
        into, z = kept[0][:4], kept[0][4]  # becomes what goes into z, into r and, behind r, into c; then into c itself
        dh, g = np.zeros_like(states[:, 0]), np.empty((3, *states[:, 0].shape), states.dtype)
        for t in range(steps - 1, -1, -1):
            dh += back[:, t]
            of_z, of_r, of_g, of_c = into[:, :, t]
            of_c *= dh
            of_z *= dh
            of_r *= of_c
            of_g *= of_c
            np.matmul(into[:3, :, t], u, out=g)
            dh *= z[:, t]
            for part in g:
                dh += part
        for k, side in enumerate("fb"):
            before = states[k, :-1].reshape(-1, hidden).T
            grads[f"u{side}"] = np.concatenate([before @ into[n, k, 1:].reshape(-1, hidden) for n in range(3)], 1)
            met = (x[::-1] if k else x).astype(np.uint16).ravel()
            order = np.argsort(met, kind="stable")
            met = met[order]
            first = np.flatnonzero(np.diff(met, prepend=-1))
            gw = np.zeros_like(self.p[f"w{side}"])
            gw[met[first]] = np.concatenate([np.add.reduceat(np.take(into[n, k].reshape(-1, hidden), order, axis=0), first) for n in (0, 1, 3)], 1)
            grads |= {f"w{side}": gw, f"b{side}": gw.sum(0)}
        return loss, grads


def fit(texts: list[tuple[str, str]], steps: int = STEPS, seed: int = 0, more: frozenset[int] = frozenset()) -> Model:
    """A network for texts and their languages: each step takes windows drawn alike from all languages, half of them
    cut short, since short texts fill no window.  ``more``: folded bytes that it has inputs for beside the texts' own."""
    languages = sorted({lang for _, lang in texts})
    place = {lang: k for k, lang in enumerate(languages)}
    found: list[list[np.ndarray]] = [[] for _ in languages]
    for text, lang in sorted(texts):
        found[place[lang]].append(windows(text.encode()))
    pools = [np.concatenate(x) for x in found]
    rng = np.random.default_rng(seed)
    used = sorted({BLANK} | more | {int(b) for x in pools for b in np.unique(x)})
    symbols = np.zeros(256, np.int64)
    symbols[used] = 1 + np.arange(len(used))
    scale = lambda a, *shape: (rng.standard_normal(shape) * a).astype(np.float32)
    p = {"o": scale(0.2, 2 * HIDDEN, len(languages)), "c": scale(0, len(languages))}
    for side in "fb":
        p |= {f"w{side}": scale(0.3, len(used) + 1, 3 * HIDDEN), f"u{side}": scale(HIDDEN**-0.5, HIDDEN, 3 * HIDDEN), f"b{side}": scale(0, 3 * HIDDEN)}
    model = Model(languages, symbols, p)
    taught = np.array([k for k, x in enumerate(pools) if len(x)])
    if not len(taught):
        return model
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(steps):
        y = taught[rng.integers(0, len(taught), BATCH)]
        x = np.stack([pools[k][rng.integers(0, len(pools[k]))] for k in y])
        lengths = np.where(rng.random(BATCH) < 0.5, WINDOW, rng.integers(3, WINDOW + 1, BATCH))
        x = np.where(np.arange(WINDOW) < lengths[:, None], x, BLANK).T
        _, grads = model.gradients(symbols[x], y, x != BLANK)
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = RATE * min(1, 2 * (1 - step / steps))
        for k, g in grads.items():
            g = g * min(1, 1 / (size + 1e-9))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            p[k] -= rate * (first[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(second[k] / (1 - 0.99 ** (step + 1))) + 1e-6)
    model.second = {k: v / (1 - 0.99 ** max(1, steps)) for k, v in second.items()}
    return model


def _seen(rows: DataFrame) -> tuple[dict[str, int], frozenset[int]]:
    """Of all rows with l and t: the bytes of letters by language, and the folded bytes that there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column("l").to_pylist()
            raw, at = flat(filled(batch.column("t")))
            data = np.frombuffer(raw, np.uint8)
            for name, a, b in zip(names, at[:-1].tolist(), at[1:].tolist(), strict=True):
                if name not in found:
                    found[name] = np.zeros(256, np.int64)
                found[name] += np.bincount(data[a:b], minlength=256)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([x.tolist() for x in found.values()], pa.list_(pa.int64()))], ["l", "n"])

    told = rows.select("l", "t").mapInArrow(tidied(run), "l string, n array<bigint>")
    sums = told.groupBy("l").agg(F.array(*[F.sum(F.col("n")[k]) for k in range(256)]).alias("n")).collect()
    letters = {r.l: sum(n for k, n in enumerate(r.n) if _FOLD[k] != BLANK) for r in sums}
    return letters, frozenset(int(_FOLD[k]) for r in sums for k, n in enumerate(r.n) if n)


def learn(rows: DataFrame, model: Model, letters: dict[str, int], known: np.ndarray) -> tuple[Model, np.ndarray]:
    """Steps over all rows with l, t and the hash i: each text goes whole into one of ROUNDS steps, whose gradient is summed
    over the windows of all its texts, every language weighing alike.  The loss has a margin: it is flat, without a slope,
    where a window's letters already have their language with a mean probability of CERTAIN, so that every window goes
    through the network, and back through it those that it doesn't tell that well.  The sums don't depend on how rows are dealt to
    tasks but for rounding.  Returns the network, and how many texts, those with a hash in ``known`` aside, had
    which score (in BINS) before they were learned."""
    place = {lang: k for k, lang in enumerate(model.languages)}
    mean = sum(letters.values()) / len(place)
    weights = np.array([mean / max(1, letters.get(lang, 0)) for lang in model.languages])
    names = sorted(model.p)
    at_once = max(8, min(LEARNED_ROWS, OUTPUTS // (8 * WINDOW * len(place))))
    bins = np.zeros(BINS + 1, np.int64)
    kinds = "task int, weight double, sums array<double>, bins array<bigint>"
    for k in range(ROUNDS):
        shipped = rows.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            net, weight, scores = shipped.value, 0.0, np.zeros(BINS + 1, np.int64)
            sums = {n: np.zeros(v.shape) for n, v in net.p.items()}
            doubted: list[tuple[np.ndarray, np.ndarray]] = []

            def add_gradients(least: int) -> None:
                x, y = (np.concatenate(part) for part in zip(*doubted, strict=True))
                ready = len(x) - len(x) % least  # the others wait for more
                doubted[:] = [(x[ready:], y[ready:])]
                for start in range(0, ready, at_once):
                    own, lang = x[start : start + at_once], y[start : start + at_once]
                    counted = ((own != BLANK) * weights[lang][:, None]).T.astype(np.float32)
                    _, grads = net.gradients(net.symbols[own.T], lang, counted)
                    for n, g in grads.items():
                        sums[n] += g * max(1.0, float(counted.sum()))

            for batch in batches:
                for part in pieces_of(batch, "t", RUN_BYTES):
                    _, _, data, _, owner, begins, ends = _cut_rows(filled(part.column("t")))
                    y = np.array([place[x] for x in part.column("l").to_pylist()], np.int64)
                    told, count = np.zeros((part.num_rows, len(place))), np.zeros(part.num_rows, np.int64)
                    for start in range(0, len(owner), ROWS):
                        x = _padded([data[a:b] for a, b in zip(begins[start : start + ROWS], ends[start : start + ROWS], strict=True)])
                        own = owner[start : start + ROWS]
                        lang, letters, heard = y[own], (x != BLANK).sum(1), net.sums(x)
                        weight += float((letters * weights[lang]).sum())
                        np.add.at(told, own, heard)
                        np.add.at(count, own, letters)
                        if len(doubt := np.flatnonzero(heard[np.arange(len(own)), lang] < CERTAIN * letters)):
                            doubted.append((x[doubt], lang[doubt]))
                            if sum(len(x) for x, _ in doubted) >= at_once:
                                add_gradients(at_once)
                    new = (count > 0) & ~np.isin(part.column("i").to_numpy(zero_copy_only=False), known)
                    np.add.at(scores, np.minimum(BINS, (told[new].max(1) / count[new] * BINS).astype(np.int64)), 1)
            if doubted:
                add_gradients(1)
            if weight:
                flat_sums = np.concatenate([sums[n].ravel() for n in names])
                task = TaskContext.get()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task.partitionId() if task else 0], pa.int32()), pa.array([weight]), pa.array([flat_sums.tolist()], pa.list_(pa.float64())), pa.array([scores.tolist()], pa.list_(pa.int64()))],
                    ["task", "weight", "sums", "bins"],
                )

        own = rows.filter(F.pmod(F.xxhash64("i", F.lit("round")), F.lit(ROUNDS)) == k).coalesce(TASKS)
        found = sorted(own.mapInArrow(tidied(run), kinds).collect(), key=lambda r: r.task)
        shipped.unpersist()
        if not found:
            continue
        total = sum(np.array(r.sums) for r in found) / sum(r.weight for r in found)
        bins += sum(np.array(r.bins) for r in found)
        rate, at, p = RATE / 2 * (1 - k / ROUNDS), 0, {}
        for n in names:
            v = model.p[n]
            g = total[at : at + v.size].reshape(v.shape)
            p[n] = (v - rate * np.clip(g / (np.sqrt(model.second[n]) + 1e-6), -1, 1)).astype(v.dtype)
            at += v.size
        model = replace(model, p=p)
    return model, bins


def held_out_scores(texts: list[tuple[str, str]]) -> list[float]:
    """Scores of texts held out of a network for the others (a fifth of each language), of the learned texts if there are
    too few to hold any out."""
    seen: dict[str, int] = {}
    folds = []
    for text, lang in sorted(texts):
        seen[lang] = seen.get(lang, 0) + 1
        folds.append((text, lang, seen[lang] % 5 == 0))
    held = [t for t, _, out in folds if out]
    model = fit([(t, lang) for t, lang, out in folds if not out])
    return [x for t in held or [t for t, _ in texts] if (x := model.score(t)) is not None]


def least_score(texts: list[tuple[str, str]], bins: np.ndarray | None = None) -> float:
    """Halfway from chance to the median of held-out scores: those of ``texts`` (``held_out_scores``), and those counted in
    ``bins``, of texts that were scored before they were learned."""
    scores = held_out_scores(texts)
    languages = len({lang for _, lang in texts})
    chance = 1 / languages if languages > 1 else 0.0
    if bins is None or not bins.sum():
        return chance + (float(np.median(scores)) - chance) / 2 if scores else 0.0
    bins = bins + np.bincount((np.array(scores) * BINS).astype(np.int64).clip(0, BINS), minlength=BINS + 1)
    median = (np.searchsorted(np.cumsum(bins), (bins.sum() + 1) // 2) + 0.5) / BINS
    return chance + (min(1.0, float(median)) - chance) / 2


def accepted(model: Model, score: Column, letters: Column) -> Column:
    """Whether a text with this score and so many bytes of letters counts as one of the languages: the limit is the
    model's for long texts and falls to chance for short ones, which tell less."""
    chance = 1 / len(model.languages) if len(model.languages) > 1 else 0.0
    return score >= F.lit(chance) + F.lit(max(0.0, model.least - chance)) * letters / (letters + WINDOW // 2)


def train(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", limit: bool = False) -> Model | None:
    """A network from the rows of ``df`` whose ``lang`` isn't null, None if there are none.

    Every window of every such row is learned from (``learn``), in steps that begin at a network for a bounded sample; all
    bytes of the rows have inputs.  The sample: of each language at most SAMPLE_DOCUMENTS texts, those with the least hashes of ``doc_id``
    and text, of each at most SAMPLE_POINTS characters, spread over the whole text, and of all languages together about
    SAMPLE_TOTAL, which many languages share alike.  So texts of any length and rows without an id are drawn like all
    others; rows that repeat both id and text are drawn together, null texts never.  A language's share of the rows is
    counted first, so that only about twice that many rows are sorted for it.  With ``limit`` the network has the score
    that ``least_score`` gives, from all rows outside the sample and the sample's own held-out texts.
    """
    rows = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"), F.col(doc_id).alias("i"))
    small_batches(df.sparkSession)
    rows = rows.withColumn("i", F.xxhash64("i", "t", F.lit("sample")))
    every = rows
    counts = durable(rows.groupBy("l").agg(F.count("*").alias("n")), "languages")
    each = SAMPLE_TOTAL // max(1, counts.count())
    documents = min(SAMPLE_DOCUMENTS, max(1, each // 200))
    points = min(SAMPLE_POINTS, max(200, each // documents))
    shares = counts.select(F.col("l").alias("l2"), (F.lit(2.0 * documents + 60) / F.col("n")).alias("share"))
    shares = F.broadcast(shares) if counts.count() <= BROADCAST_LANGUAGES else shares
    draw = F.pmod(F.col("i"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = rows.withColumn("draw", draw).join(shares, F.col("l") == F.col("l2")).filter("draw < share")
    size = max(1, points // PIECES)
    start = lambda k: F.floor(F.char_length("t") * F.lit(k / PIECES)).cast("int") + 1
    pieces = F.concat_ws(" ", *[F.substring(F.col("t"), start(k), F.lit(size)) for k in range(PIECES)])
    rows = rows.select("l", "draw", "i", F.xxhash64("t").alias("h"), F.when(F.char_length("t") <= points, F.col("t")).otherwise(pieces).alias("t"))
    order = Window.partitionBy("l").orderBy("draw", "h", "t")
    found = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= documents).select("t", "l", "i").collect()
    if not found:
        return None
    texts = [(r.t, r.l) for r in found]
    letters, used = _seen(every)
    model = fit(texts, more=used)
    if model is None:
        return None
    model, bins = learn(every, model, letters, np.array([r.i for r in found], np.int64))
    if limit:
        model.least = least_score(texts, bins)
    return model


def _has_letter(raw: bytes) -> bool:
    return any(map(str.isalpha, raw.decode("utf-8")))


def _cut_rows(column: pa.Array) -> tuple[bytes, np.ndarray, bytes, np.ndarray, np.ndarray, list[int], list[int]]:
    """Of a text column: its bytes and each row's first one; the folded bytes and where they stand; and for each window
    its row, its first folded byte and its end."""
    data, at = flat(column)
    raw = bytes(data)
    owner, begins, ends, parts, places, total = [], [], [], [], [], 0
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        own, where = folded(raw[a:b])
        found = cuts(own)
        owner += [k] * (len(found) - 1)
        begins += [total + x for x in found[:-1]]
        ends += [total + x for x in found[1:]]
        parts.append(own)
        places.append(where + a)
        total += len(own)
    return raw, at, b"".join(parts), np.concatenate([*places, np.zeros(0, np.int64)]), np.array(owner, np.int64), begins, ends


def predict(df: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, letters: str | None = None) -> DataFrame:
    """``keep`` (default: all columns) of every row with lang_pred and score, the mean probability of that language
    over all bytes of the whole text's letters, whose number is the column ``letters``, if it has a name.

    A null text, an empty one and one without a letter give ``und`` and 0, as any text does without a model.  Each row
    stands for itself: repeated rows agree, an empty table gives an empty one.  Columns with the new names give way.
    """
    small_batches(df.sparkSession)
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField(letters, T.LongType())] if letters else [])]
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in {f.name.lower() for f in new}]
    source, names, keep = numbered(df, keep, F.col(f"`{text}`").alias("__text__"))
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shipped.value
        for batch in batches:
            for part in pieces_of(batch, "__text__", RUN_BYTES):
                told, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                count = np.zeros(part.num_rows, np.int64)
                if net is not None:
                    raw, at, data, _, owner, begins, ends = _cut_rows(filled(part.column("__text__")))
                    total = np.zeros((part.num_rows, len(net.languages)))
                    for start in range(0, len(owner), ROWS):
                        found = _padded([data[a:b] for a, b in zip(begins[start : start + ROWS], ends[start : start + ROWS], strict=True)])
                        own = owner[start : start + ROWS]
                        np.add.at(total, own, net.sums(found))
                        np.add.at(count, own, (found != BLANK).sum(1))
                    for k in np.flatnonzero(count).tolist():
                        own = raw[at[k] : at[k + 1]]
                        if own.translate(None, _NO_LETTER) or _has_letter(own):
                            best = int(total[k].argmax())
                            told[k], scores[k] = net.languages[best], min(1.0, total[k, best] / count[k])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(told, pa.string()), pa.array(scores), *([pa.array(count)] if letters else [])], [*keep, *[f.name for f in new]])

    return source.mapInArrow(tidied(run), T.StructType([*[source.schema[c] for c in keep], *new])).toDF(*names, *[f.name for f in new])


def label_positions(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` of every row with ``labels``: for each UTF-8 byte of the text the place of its likeliest language in
    ``model.languages``, -1 for ASCII bytes that are no letters."""
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != "labels"]
    source, names, keep = numbered(df, keep, F.col(f"`{text}`").alias("__text__"))
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shipped.value
        for batch in batches:
            for part in pieces_of(batch, "__text__", RUN_BYTES):
                raw, at, data, where, owner, begins, ends = _cut_rows(filled(part.column("__text__")))
                out = np.full(len(raw), -1, np.int32)
                for start in range(0, len(owner), net.rows):
                    spans = list(zip(begins[start : start + net.rows], ends[start : start + net.rows], strict=True))
                    found = _padded([data[a:b] for a, b in spans])
                    best = net.positions(net.symbols[found.T]).argmax(-1).T
                    for k, (a, b) in enumerate(spans):
                        out[where[a:b]] = np.where(found[k, : b - a] != BLANK, best[k, : b - a], -1)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], lists(out, at)], [*keep, "labels"])

    return source.mapInArrow(tidied(run), T.StructType([*[source.schema[c] for c in keep], T.StructField("labels", T.ArrayType(T.IntegerType()))])).toDF(*names, "labels")
