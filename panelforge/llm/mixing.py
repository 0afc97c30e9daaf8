"""Mixing sources to target weights, in DataFrame operations alone.

Every document gets a hash-random key.  Within its source the keys' order is a random order of the documents, and the
prefix sums of the word counts in that order say where each source's budget ends: whole epochs first, then a cut at
the very word.  Hash keys make the order the same in every run and on every cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._prefix import KEYS, _join, hash_key, prefix_sums
from ._store import durable

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]


def word_count(text: Column) -> Column:
    """Runs of other characters than [\\x20\\x09-\\x0D]; a null text has none."""
    edge = lambda at: F.substring(text, at, 1).isin(BLANKS).cast("int")
    return F.when(text.isNull() | (text == ""), 0).otherwise(F.size(F.split(text, BLANK)) - edge(1) - edge(-1)).cast("long")


def targets(totals: DataFrame, source: str, size: str, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``totals`` (a row for each source) with its target in words.

    Sources by code point, null last, weigh as ``weights`` say, which repeat; they share ``share`` times all words by
    weight, and a target stops at ``most`` times its source's words, the excess going to the others by weight until
    none is above.  With the sources by limit over weight, those that stop come first, so running sums find the level
    that the rest gets for each unit of weight.  The windows take one row a source.
    """
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    rows = totals.withColumn("__w__", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    rows = rows.withColumn("__cap__", F.col(size) * F.lit(float(most)))
    by_limit = Window.orderBy(F.col("__cap__") / F.col("__w__"), F.col(source).asc_nulls_last())
    every = Window.partitionBy()
    capped = F.coalesce(F.sum("__cap__").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight = F.sum("__w__").over(by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("__level__", (F.sum(size).over(every) * F.lit(float(share)) - capped) / weight)
    level = F.max(F.when(F.col("__level__") * F.col("__w__") <= F.col("__cap__"), F.col("__level__"))).over(every)
    target = F.when(level.isNull(), F.col("__cap__")).otherwise(F.least(F.col("__cap__"), level * F.col("__w__")))
    return rows.withColumn("target", target).drop("__w__", "__cap__", "__level__")


def mix(df: DataFrame, size: str, source: str = "source", doc_id: str = "doc_id", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """``df`` with source_size, target and taken: the words that the mix takes of each document, repeats counted.

    A source whose target is e times its words and some more takes each document e times, and then documents in the
    order of their keys up to the target's last whole word; so the taken words of a source are its target rounded
    down, and at most one document of a source is taken in part.  Ties of the key stand by ``doc_id`` and ``size``;
    rows that are equal in all of these are interchangeable.  Null sources are one source; documents without words
    take none; an empty table gives an empty one.  Columns of ``df`` with the new names give way.
    """
    names = [c for c in df.columns if c.lower() not in ("source_size", "target", "taken")]
    own = [f"c{k}" for k in range(len(names))]
    source, doc_id, size = (own[[c.lower() for c in names].index(n.lower())] for n in (source, doc_id, size))
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, own, strict=True)], hash_key(seed, F.col(f"`{names[own.index(doc_id)]}`")).alias("key"))
    totals = targets(rows.groupBy(source).agg(F.sum(size).alias("source_size")), source, "source_size", weights, share, most)
    rows = prefix_sums(rows, [source], [F.col("key"), F.col(doc_id), F.col(size)], "key", size, "before")
    rows = _join(rows, totals, [source])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target")) - epochs * F.col("source_size") - F.col("before")
    taken = epochs * F.col(size) + F.greatest(F.lit(0), F.least(F.col(size), rest))
    return rows.select(*[F.col(k).alias(c) for c, k in zip(names, own, strict=True)], "source_size", "target", taken.cast("long").alias("taken"))


def mix_documents(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options: object) -> DataFrame:
    """``df`` with ``size`` (words of the whole text) and what ``mix`` adds, without the text: sizes are written once,
    so that the texts are read once."""
    sized = durable(df.select(F.col(doc_id), F.col(source), word_count(F.col(text)).alias("size")), "sizes")
    return mix(sized, "size", source, doc_id, **options)


def mixed_rows(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options: object) -> DataFrame:
    """The mix as rows of ``df``: each document as often as it is taken, one that is taken in part once more whole, so
    a source passes its target by less than one document.  Rows that share ``doc_id``, source and text (null ids are one
    id) share what is taken of them alike, and those with the least hashes of a number of the row have one more.
    Columns of ``df`` may have any names; an empty table gives an empty one."""
    names = list(df.columns)
    own = [f"c{k}" for k in range(len(names))]
    of_text, of_source, of_id = (F.col(own[[c.lower() for c in names].index(n.lower())]) for n in (text, source, doc_id))
    marked = df.toDF(*own).withColumn("key", F.xxhash64(of_text))
    sized = durable(marked.select(of_id.alias("id"), of_source.alias("of"), F.col("key").alias("h"), word_count(of_text).alias("size")), "sizes")
    times = F.when(F.col("taken") > 0, F.ceil(F.try_divide("taken", "size"))).otherwise(0)
    rows = mix(sized, "size", "of", "id", **options)
    copies = rows.groupBy("id", "of", "h").agg(F.sum(times).alias("copies"), F.count("*").alias("n_rows"))
    copies = durable(copies.filter("copies > 0"), "copies")
    found = marked.join(copies, [of_id.eqNullSafe(F.col("id")), of_source.eqNullSafe(F.col("of")), F.col("key").eqNullSafe(F.col("h"))])
    every = found.filter("n_rows = 1").select(*own, F.col("copies").alias("times"))
    if not copies.filter("n_rows > 1").isEmpty():
        # of r equal rows that are taken n times together, each stands for n / r, the rest spread by a counter
        twins = durable(found.filter("n_rows > 1").select(*own, "id", "of", "h", "copies", "n_rows", F.monotonically_increasing_id().alias("uid"), F.lit(1).alias("one")), "twins")
        twins = twins.withColumn("key", F.xxhash64("uid").bitwiseAND(F.lit(KEYS - 1)))
        twins = prefix_sums(twins, ["id", "of", "h"], [F.col("key"), F.col("uid")], "key", "one", "before")
        spread = F.floor(F.col("copies") / F.col("n_rows")) + (F.col("before") < F.col("copies") % F.col("n_rows")).cast("long")
        every = every.unionByName(twins.select(*own, spread.alias("times")))
    every = every.filter("times > 0")
    return every.select(*own, F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).drop("copy").toDF(*names)
