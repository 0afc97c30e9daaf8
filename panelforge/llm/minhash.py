"""Near-duplicates by ProbMinHash signatures, banding and verification.

A text is a weighted set of its runs of SHINGLE words: a shingle weighs as often as it occurs.  Each shingle with weight
w is a Poisson process of rate w: its arrivals visit the signature's places one after another, in a random order of its
own, after exponential waits.  A place keeps the shingle that arrives first; a shingle stops as soon as it comes later
than every place's first.  Two texts agree in a place with the probability Jaccard similarity of their weighted
shingles (``similarity``), which is the Jaccard similarity itself where all weights are one.

Places are joined into bands; texts that agree in a band are in one bucket.  Buckets are compared by stars: a central
member with the others, until each bucket's members are either in one component or have been compared, so no link
between members of a bucket is lost and a bucket of copies costs as many comparisons as it has members.  A link counts
when the weighted shingles of the whole texts have at least the similarity.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._graph import components
from ._prefix import attach, dealt_totals
from ._store import durable, small_batches
from ._text import filled, flat, lists, pieces_of, tidied

SHINGLE, SIMILARITY = 5, 0.8
#: Places of a signature at first, and how often all bands may miss a pair of the least similarity.
PLACES, MISSED = 128, 1 / 20_000
#: A pair isn't verified if its signatures agree in fewer places than expected by so many standard deviations.
DEVIATIONS = 4
#: Texts up to which a shingle is scarce.
SCARCE = 8
RUN_BYTES = 1 << 19
CACHE_WORDS = 100_000
#: Rows of ids up to which they are broadcast to pick texts (some 16 MB), and pairs with a signature each (some 10 MB).
BROADCAST_ROWS, CLOSE_ROWS = 250_000, 50_000
#: Texts of a bucket from which they are dealt to parts to meet its size.
HOT_ROWS = 10_000
#: Parts to which a bucket's members are dealt to meet its centres.
DEALS = 16

_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that looks random."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[bytes]:
    """The words that count: small letters, between characters [\\x20\\x09-\\x0D]."""
    return text.lower().encode().split()


def weighted_shingles(texts: list[list[bytes]], weigh: str = "count") -> list[dict[bytes, int]]:
    """Shingles of lists of words with their weights; fewer words than SHINGLE are one shingle, no word is none."""
    made = ([b" ".join(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))] if w else [] for w in texts)
    return [Counter(x) if weigh == "count" else dict.fromkeys(x, 1) for x in made]


def similarity(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """Probability Jaccard similarity of weighted sets: the sum over what both have of 1 / sum of max(a[j] / a[i],
    b[j] / b[i]) over all j, which is the Jaccard similarity if all weights are equal; of two empty sets 1."""
    if not a or not b:
        return float(not a and not b)
    both = a.keys() & b.keys()
    if len(a) == sum(a.values()) and len(b) == sum(b.values()):
        return len(both) / (len(a) + len(b) - len(both))
    kinds = Counter((a[x], b[x]) for x in both)
    kinds.update((n, 0) for x, n in a.items() if x not in both)
    kinds.update((0, n) for x, n in b.items() if x not in both)
    x, y, n = np.array([(*k, n) for k, n in kinds.items()], float).T
    return float(sum(n[k] / (n * np.maximum(x / x[k], y / y[k])).sum() for k in np.flatnonzero((x > 0) & (y > 0))))


class Bands(NamedTuple):
    """How signatures are cut for a least similarity: places, bands, places of a band, and the agreeing places from
    which a pair is verified."""

    places: int
    bands: int
    rows: int
    agree: int


def bands_for(least: float) -> Bands:
    """The longest bands that fit into the places and miss a pair of similarity ``least`` no oftener than MISSED."""
    if not 0.02 <= least <= 1:
        raise ValueError("the least similarity has to be from 0.02 to 1")
    places = PLACES
    while True:
        for rows in range(32, 0, -1):
            caught = least**rows
            bands = 1 if caught >= 1 else math.ceil(math.log(MISSED) / math.log1p(-caught))
            if bands * rows <= places:
                return Bands(places, bands, rows, max(1, math.floor(least * places - DEVIATIONS * math.sqrt(places * least * (1 - least)))))
        places *= 2


def shingles(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts given as word hashes: the text's place, the shingle's hash, how often it occurs."""
    sizes = np.array([len(r) for r in rows], np.int64)
    short = (sizes > 0) & (sizes < SHINGLE)
    counts = np.where(short, 1, np.maximum(sizes - SHINGLE + 1, 0))
    owner = np.repeat(np.arange(len(rows)), counts)
    flat = np.concatenate([*rows, np.zeros(SHINGLE, np.uint64)])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else np.zeros(0, np.int64)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[owner] + within
    left = np.minimum(sizes[owner] - within, SHINGLE)
    value = np.zeros(len(owner), np.uint64)
    for k in range(SHINGLE):
        value = np.where(k < left, _mixed(value * _GOLDEN + flat[at + np.where(k < left, k, 0)] + np.uint64(k + 1)), value)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    begin = np.flatnonzero(new)
    return owner[begin], value[begin], np.diff(np.append(begin, len(owner)))


def signatures(n: int, owner: np.ndarray, element: np.ndarray, weight: np.ndarray, places: int = PLACES) -> np.ndarray:
    """ProbMinHash signatures of ``n`` weighted sets, n x places: the element that arrives first at each place, 0 at
    the places of an empty set.  ``places`` is a power of two."""
    first = np.full(n * places, np.inf)
    who = np.zeros(n * places, np.uint64)
    seed = _mixed(element + _GOLDEN)
    time = np.zeros(len(element))
    order = _mixed(seed ^ _M1)  # of an element's places
    for k in range(places):
        seed = _mixed(seed + _GOLDEN)
        wait = -np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        time = time + wait / (weight * (places - k))
        if k:
            open_ = time < first.reshape(n, places).max(1)[owner]
            if not open_.all():
                owner, element, weight, seed, order, time = (x[open_] for x in (owner, element, weight, seed, order, time))
            if not len(owner):
                break
        place = owner * places + _place(order, k, places)
        np.minimum.at(first, place, time)
        won = first[place] == time
        who[place[won]] = element[won]
    return who.reshape(n, places)


def _place(order: np.ndarray, k: int, places: int) -> np.ndarray:
    """The k-th place that each element visits: odd factors, sums and shifts drawn from ``order`` are bijections of the
    numbers below ``places``, so that all of them come in an order that differs from element to element."""
    bits = places.bit_length() - 1
    x, mask = np.full(len(order), k, np.uint64), np.uint64(places - 1)
    for turn in range(3):
        own = order >> np.uint64(20 * turn)
        x = (x * (own | np.uint64(1)) + (own >> np.uint64(10))) & mask
        x ^= x >> np.uint64((bits + 1) // 2)
    return x.astype(np.int64)


def buckets(signature: np.ndarray, cut: Bands) -> np.ndarray:
    """A 64-bit name for each band of each signature; bands don't share names."""
    value = np.tile(np.arange(1, cut.bands + 1, dtype=np.uint64), (len(signature), 1))
    grid = signature[:, : cut.bands * cut.rows].reshape(len(signature), cut.bands, cut.rows)
    for k in range(cut.rows):
        value = _mixed(value * _GOLDEN + grid[:, :, k])
    return value.view(np.int64)


def _digests(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a matrix of bytes."""
    at = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(rows.tobytes())])


def sign(df: DataFrame, text: str, keep: list[str], weigh: str = "count", least: float = SIMILARITY) -> DataFrame:
    """``keep`` of every row with uid (a number of the row), wordkey (a digest of the words), signature (a byte a
    place) and buckets (none for a text without words), cut for the similarity ``least``.  ``weigh``: "count" gives each
    distinct shingle as much weight as it has occurrences, "presence" one.  Null texts count as empty."""
    small_batches(df.sparkSession)
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text__"))
    cut = bands_for(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in pieces_of(batch, "__text__", RUN_BYTES):
                if len(known) > CACHE_WORDS:
                    known.clear()
                rows, keys = [], []
                for t in filled(part.column("__text__")):
                    own = words(t.as_py())
                    keys.append(hashlib.blake2b(b" ".join(own), digest_size=16).digest())
                    for w in own:
                        if w not in known:
                            known[w] = xxhash.xxh3_64_intdigest(w)
                    rows.append(np.fromiter((known[w] for w in own), np.uint64, len(own)))
                n = part.num_rows
                owner, element, count = shingles(rows)
                weight = np.ones(len(owner)) if weigh == "presence" else count.astype(float)
                signature = signatures(n, owner, element, weight, cut.places)
                full = np.array([len(own) > 0 for own in rows], bool)
                names = buckets(signature[full], cut)
                at = np.concatenate(([0], np.cumsum(full * cut.bands)))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array(uid + np.arange(n)), pa.array(keys, pa.binary()), _digests(signature.astype(np.uint8)), lists(names.ravel(), at)],
                    [*keep, "uid", "wordkey", "signature", "buckets"],
                )
                uid += n

    more = [T.StructField("uid", T.LongType()), T.StructField("wordkey", T.BinaryType()), T.StructField("signature", T.BinaryType()), T.StructField("buckets", T.ArrayType(T.LongType()))]
    return source.mapInArrow(tidied(run), T.StructType([*[source.schema[c] for c in keep], *more]))


def _close(pairs: DataFrame, signed: DataFrame, cut: Bands, n: int) -> DataFrame:
    """The pairs (a, b), ``n`` of them, of which enough places of the signatures agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                x, y = (np.frombuffer(flat(part.column(c))[0], np.uint8).reshape(-1, cut.places) for c in ("sa", "sb"))
                yield part.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= cut.agree))

    of = lambda side: signed.select(F.col("uid").alias(side), F.col("signature").alias(f"s{side}"))
    found = of("b").join(F.broadcast(of("a").join(F.broadcast(pairs), "a")), "b") if n <= CLOSE_ROWS else pairs.join(of("a"), "a").join(of("b"), "b")
    return found.select("a", "b", "sa", "sb").mapInArrow(tidied(run), "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, least: float, weigh: str, n: int) -> DataFrame:
    """The pairs (a, b), ``n`` at most, whose whole texts are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[object, dict[bytes, int]] = (None, {})
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                keep = []
                for a, x, y in zip(part.column("a").to_pylist(), part.column("ta"), part.column("tb"), strict=True):
                    if a != last[0]:
                        last = (a, weighted_shingles([words(x.as_py())], weigh)[0])
                    keep.append(similarity(last[1], weighted_shingles([words(y.as_py())], weigh)[0]) >= least - 1e-12)
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda side: texts.select(F.col("uid").alias(side), F.col("text").alias(f"t{side}"))
    return of("b").join(F.broadcast(pairs) if n <= BROADCAST_ROWS else pairs, "b").join(of("a"), "a").select("a", "b", "ta", "tb").mapInArrow(tidied(run), "a long, b long")


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has few enough rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = SIMILARITY, weigh: str = "count") -> DataFrame:
    """Every row's ``doc_id`` with class_id (the least doc_id of its group of near-duplicates), copy_id (the least
    doc_id of the rows with the same words), group_size, n_links (the links that were verified of its distinct words), kept
    (exactly one row of each group, one with the least doc_id) and row_hash (xxhash64 of the text).

    Rows are in one group if a chain of links joins them, a link being a ``similarity`` of ``least`` or more of their
    shingles weighed as ``weigh`` says (see ``sign``); bands follow from ``least``.  Rows with
    the same words are one text, so copies aren't compared; texts without words, null ones included, are one group.
    Null ids are last; repeated rows are copies; an empty table gives an empty one.

    Rows of one text, and texts of one bucket or group, meet what is known of them in parts (``attach``), so a text, a
    bucket or a group that a third of all rows belong to is no task's burden.
    """
    cut = bands_for(least)
    source = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("row_hash", F.xxhash64("text"))
    signed = durable(sign(source, "text", ["doc_id", "row_hash"], weigh, least), "signed")
    n = signed.count()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    rows = signed.select("doc_id", "row_hash", "uid", "wordkey")
    rows = durable(dealt_totals(rows, ["wordkey"], "uid", {"of": F.min(order), "n": F.count("*")}, {"of": F.min("of"), "copies": F.sum("n")}).drop("wordkey"), "rows", n)
    reps = rows.filter(F.col("uid") == F.col("of.uid")).select("uid", "doc_id", "row_hash", "copies")
    texts_of = durable(signed.select("uid", "signature", "buckets").join(reps, "uid"), "reps", n)

    members = texts_of.select("uid", F.explode("buckets").alias("bucket"))
    # those that share most buckets with others are the most central
    sizes = durable(members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    shared = members.join(sizes.filter(F.col("n") <= HOT_ROWS), "bucket")
    hot = sizes.filter(F.col("n") > HOT_ROWS)
    m = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    members = durable(shared if hot.isEmpty() else shared.unionByName(attach(members, hot, ["bucket"], "uid")), "members", m)
    members = members.join(members.groupBy("uid").agg(F.sum("n").alias("score")), "uid").drop("n")
    head = F.max(F.struct("score", (-F.col("uid")).alias("u")))
    members = dealt_totals(members, ["bucket"], "uid", {"top": head}, {"top": F.max("top")})
    members = durable(members.withColumn("head", -F.col("top.u")).drop("top"), "members", m)

    picked = _small(members.select("uid").distinct().join(texts_of.select("uid", F.col("doc_id").alias("d"), F.col("row_hash").alias("h")), "uid"))
    texts = source.join(picked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_hash") == F.col("h"))).select("uid", "text")
    texts = durable(texts.dropDuplicates(["uid"]) if _repeated(rows) else texts, "texts")

    edges, labels = _linked(members, m, texts_of.select("uid", "signature"), texts, least, weigh, cut)
    links = edges.select(F.explode(F.array("a", "b")).alias("uid")).groupBy("uid").agg(F.count("*").alias("n_links"))
    of_texts = texts_of.select("uid", "doc_id", "copies").join(links, "uid", "left").join(labels.select(F.col("node").alias("uid"), "label"), "uid", "left")
    of_texts = of_texts.withColumn("group", F.coalesce("label", "uid")).drop("label")
    of_texts = dealt_totals(of_texts, ["group"], "uid", {"first": F.min(order), "n": F.sum("copies")}, {"first": F.min("first"), "group_size": F.sum("n")})
    of_texts = durable(of_texts.select(F.col("uid").alias("rep"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "first", "group_size"), "groups", n)
    found = attach(rows.withColumn("rep", F.col("of.uid")), of_texts, ["rep"], "uid")
    return found.select("doc_id", F.col("first.doc_id").alias("class_id"), F.col("of.doc_id").alias("copy_id"), "group_size", "n_links", (F.col("first.uid") == F.col("uid")).alias("kept"), "row_hash")


def _repeated(rows: DataFrame) -> bool:
    return not rows.groupBy("doc_id", "row_hash").count().filter("count > 1").isEmpty()


def _shingles(texts: DataFrame, weigh: str) -> DataFrame:
    """(uid, shingle, weight): a hash of each distinct shingle of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text", RUN_BYTES):
                sets = [weighted_shingles([words(t.as_py())], weigh)[0] for t in part.column("text")]
                uids = np.repeat(part.column("uid").to_numpy(), [len(s) for s in sets])
                names = np.fromiter((xxhash.xxh3_64_intdigest(x) for s in sets for x in s), np.uint64, len(uids)).view(np.int64)
                weights = np.fromiter((n for s in sets for n in s.values()), np.int64, len(uids))
                yield pa.RecordBatch.from_arrays([pa.array(uids), pa.array(names), pa.array(weights)], ["uid", "shingle", "weight"])

    return texts.select("uid", "text").mapInArrow(tidied(run), "uid long, shingle long, weight long")


def _frequencies(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (uid, shingle, weight): (uid, common, distinct, peak), of each text the part of its weight in shingles that
    more than SCARCE texts have, how many of those it has, and the greatest part that one shingle has; and the rows of
    shingles that 2 to SCARCE texts have.  No more than SCARCE rows of a shingle come together."""
    counts = durable(every.groupBy("shingle").agg(F.count("*").alias("k"), F.min(F.struct("uid", "weight")).alias("of")).filter(F.col("k") <= SCARCE), "scarce")
    few = durable(every.join(counts.filter("k > 1").select("shingle"), "shingle"), "few")
    scarce = counts.filter("k = 1").select(F.col("of.uid").alias("u"), F.col("of.weight").alias("weight")).union(few.select("uid", "weight"))
    scarce = scarce.groupBy("u").agg(F.sum("weight").alias("scarce"), F.count("*").alias("k"))
    sizes = every.groupBy("uid").agg(F.sum("weight").alias("n"), F.count("*").alias("m"), F.max("weight").alias("top"))
    sizes = sizes.join(scarce, F.col("uid") == F.col("u"), "left").na.fill(0, ["scarce", "k"])
    return sizes.select("uid", ((F.col("n") - F.col("scarce")) / F.col("n")).alias("common"), (F.col("m") - F.col("k")).alias("distinct"), (F.col("top") / F.col("n")).alias("peak")), few


def _linked(members: DataFrame, size: int, signatures_: DataFrame, texts: DataFrame, least: float, weigh: str, cut: Bands) -> tuple[DataFrame, DataFrame]:
    """All links (a, b) that were verified, and the components' labels, which no link inside a bucket crosses; ``size``
    is the number of members' rows.

    First each bucket's most central member meets the others.  Where that leaves members of a bucket in different
    components, the shingles of those buckets' texts are counted.  Texts that share a shingle that few have are
    compared (a copy with many edits of its own shares some of them with a closer copy of itself).  Of texts that don't,
    with the parts p and q of their weights in what both have, the similarity is at most pq / (p + q - pq); p is at
    most the part in common shingles, and at most the number of those that both can have times the greatest part of one
    shingle.  For most that is too little for a link with any text of the bucket; they are done.  The others go on by stars: in
    round k a bucket's left-over members are dealt into 8 * 32 ** k parts by a hash, the most central of each part meets
    those members of the bucket outside its component that the same bound admits, and is done.
    """
    spark = members.sparkSession
    edges = seen = spark.createDataFrame([], "a long, b long")
    labels = components(edges)

    def meet(pairs: DataFrame, most: int | None = None) -> None:
        nonlocal seen, edges, labels
        fresh = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct().select(F.col("x").alias("a"), F.col("y").alias("b"))
        fresh = durable(fresh.join(seen, ["a", "b"], "left_anti"), "pairs", most)
        n = fresh.count()
        seen = seen.union(fresh)
        linked = durable(_verified(_close(fresh, signatures_, cut, n), texts, least, weigh, n), "links", n)
        if not linked.isEmpty():
            edges = edges.union(linked)
            labels = components(linked, labels)

    def labelled(rows: DataFrame, node: str, out: str) -> DataFrame:
        of = labels.select(F.col("node").alias("n_"), F.col("label").alias("l_"))
        return rows.join(of, F.col(node) == F.col("n_"), "left").withColumn(out, F.coalesce("l_", node)).drop("n_", "l_")

    def admits(*other: str) -> Column:
        """Whether the bound allows a link with a text of these parts, number and greatest part."""
        common, distinct, peak = map(F.col, other)
        both = F.least("distinct", distinct)
        p, q = F.least(F.col("common"), both * F.col("peak")), F.least(common, both * peak)
        return p * q >= (p + q - p * q) * (least - 1e-9)

    meet(members.filter("uid <> head").select(F.col("head").alias("a"), F.col("uid").alias("b")), size)
    low, high = F.min("label"), F.max("label")
    open_ = dealt_totals(labelled(members, "uid", "label"), ["bucket"], "uid", {"l": low, "h": high}, {"l": F.min("l"), "h": F.max("h")})
    open_ = durable(open_.filter("l <> h").drop("l", "h", "label"), "open", size)
    if open_.isEmpty():
        return edges, labels
    every = durable(_shingles(texts.join(_small(open_.select("uid").distinct()), "uid"), weigh), "shingles")
    frequencies, few = _frequencies(every)
    few = durable(labelled(few, "uid", "label"), "few")
    across = few.groupBy("shingle").agg(low.alias("p"), high.alias("q")).filter("p <> q").select("shingle")
    few = durable(few.join(across, "shingle"), "across")
    other = few.select("shingle", F.col("uid").alias("b"), F.col("label").alias("m"))
    meet(few.join(other, "shingle").filter("uid < b and label <> m").select(F.col("uid").alias("a"), "b"))
    open_ = open_.join(durable(frequencies, "frequencies", size), "uid")
    open_ = durable(dealt_totals(open_, ["bucket"], "uid", *[{f"most_{n}": F.max(k + n) for n in ("common", "distinct", "peak")} for k in ("", "most_")]), "open", size)
    done, step = spark.createDataFrame([], "bucket long, uid long"), 0
    while True:
        live = labelled(open_.join(done, ["bucket", "uid"], "left_anti"), "uid", "label")
        heads = labelled(open_.select("bucket", "head").distinct(), "head", "main").drop("head")
        live = durable(attach(live, heads, ["bucket"], "uid"), "live", size)
        left = live.filter(admits("most_common", "most_distinct", "most_peak") & (F.col("label") != F.col("main")))
        if left.isEmpty():
            return edges, labels
        parts = left.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(step)), F.lit(1 << (3 + 5 * step))))
        centre = parts.groupBy("bucket", "part").agg(F.max(F.struct("score", (-F.col("uid")).alias("u"), "label", "common", "distinct", "peak")).alias("c"))
        centre = durable(centre.select(F.col("bucket").alias("of"), (-F.col("c.u")).alias("a"), F.col("c.label").alias("own"), *[F.col(f"c.{n}").alias(f"its_{n}") for n in ("common", "distinct", "peak")]), "centres")
        # a bucket's members are dealt to a few parts, each of which meets a copy of the bucket's centres
        dealt = live.withColumn("deal", F.pmod(F.xxhash64("uid"), F.lit(DEALS)).cast("int"))
        places = dealt.select(F.col("bucket").alias("of"), F.col("deal").alias("at")).distinct().join(centre, "of")
        stars = dealt.join(places, [F.col("bucket") == F.col("of"), F.col("deal") == F.col("at"), F.col("label") != F.col("own"), admits("its_common", "its_distinct", "its_peak")])
        meet(stars.select("a", F.col("uid").alias("b")))
        done = durable(done.union(centre.select("of", "a")), "done")
        step += 1


def kept_rows(df: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = SIMILARITY, weigh: str = "count") -> DataFrame:
    """The rows of ``df``, with all columns, less all but one of each group of near-duplicates."""
    from .exact import stay_rows

    decided = near_duplicates(df, text, doc_id, least, weigh)
    return stay_rows(df, decided.select(F.col("doc_id").alias("id"), F.col("row_hash").alias("h"), "kept"), text, doc_id, null_text="")
