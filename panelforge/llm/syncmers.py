"""Document fingerprints by closed syncmers, in DataFrame operations alone.

A text is a sequence of tokens: its words, and the code points of runs without blanks longer than TOKEN_POINTS, so that
no cut depends on where a run begins.  Of the K tokens from any place on,
every run of S tokens has a hash; the K tokens are an anchor if the least of these hashes is that of the first or of
the last run.  Whether they are depends on those K tokens alone, so two texts that share a passage share its anchors,
wherever it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import durable

#: Tokens of an anchor and of its inner runs: of K - S + 1 = 5 runs two are at an edge, so 2 of 5 places are anchors.
K, S = 6, 2
TOKEN_POINTS = 24
_SOLID = r"[^\x20\x09-\x0D]"
TOKENS = r"(?<!%s)%s{1,%d}(?!%s)|%s" % (_SOLID, _SOLID, TOKEN_POINTS, _SOLID, _SOLID)
#: Documents of a window when the next document of each is looked up, and windows that one task puts in a row.
WINDOW_ROWS, LEVEL_ROWS = 2_000, 4_096
QUANTILES = 64
#: Ids that hold so large a part of the rows (and HOT_ROWS at least) get windows of their own.
HOT_SHARE, HOT_ROWS = 1_000, 16_000
#: Rows of 24 bytes up to which the windows' first documents are broadcast.
HEADS_BROADCAST = 400_000


def anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the anchors of the whole text in their order, each a place (of its first token, from 1) and
    a hash of 32 bits.  A text of fewer than K tokens, or without an anchor, has one for all its tokens; a text
    without tokens, or null, has none.  Equal texts have equal anchors; nothing depends on other rows."""
    h, s = f"__h_{out}", f"__s_{out}"
    hashed = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKENS), F.lit(0)), lambda t: F.xxhash64(t))
    df = df.withColumn(h, hashed)
    later = lambda k: F.slice(F.col(h), k + 1, F.greatest(F.size(h) - (S - 1), F.lit(0)))
    df = df.withColumn(s, F.zip_with(later(0), later(1), lambda a, b: F.xxhash64(a, b)))
    runs = K - S + 1

    def closed(i: Column) -> Column:
        value = [F.get(F.col(s), i + (k - 1)) for k in range(runs)]
        return F.least(value[0], value[-1]) <= F.least(*value[1:-1])

    def name(tokens: Column) -> Column:
        return F.xxhash64(tokens).bitwiseAND(F.lit(0xFFFFFFFF))

    found = f"__p_{out}"
    df = df.withColumn(found, F.when(F.size(h) >= K, F.filter(F.sequence(F.lit(1), F.greatest(F.size(h) - (K - 1), F.lit(1))), closed)).otherwise(F.expr("array()").cast("array<int>")))
    every = F.transform(F.col(found), lambda i: F.struct(i.alias("place"), name(F.slice(F.col(h), i, K)).alias("hash")))
    whole = F.array(F.struct(F.lit(1).alias("place"), name(F.col(h)).alias("hash")))
    none = F.expr("array()").cast("array<struct<place:int,hash:bigint>>")
    return df.withColumn(out, F.when(F.size(h) == 0, none).when(F.size(found) == 0, whole).otherwise(every)).drop(h, s, found)


def as_string(found: Column) -> Column:
    """The anchors' hashes in hexadecimal, in their order, joined by commas."""
    return F.concat_ws(",", F.transform(found["hash"], lambda x: F.hex(x)))


def likeness(left: str, right: str) -> Column:
    """The shared part of all distinct hashes of two arrays; 1 if both are empty."""
    both = F.size(F.array_intersect(left, right))
    every = F.size(F.array_distinct(left)) + F.size(F.array_distinct(right)) - both
    return F.when(every == 0, 1.0).otherwise(both / every)


def dense_rank(df: DataFrame, order: str) -> DataFrame:
    """(``order``, rank) of the distinct values that aren't null, from 0: a global sort, then numbers within its
    partitions, whose sizes come to the driver."""
    part, row = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    at = durable(df.select(order).filter(F.col(order).isNotNull()).distinct().orderBy(order).select(order, part.alias("part"), row.alias("row")), "ranks")
    sizes = sorted(tuple(r) for r in at.groupBy("part").count().collect())
    before, total = {}, 0
    for k, n in sizes:
        before[k], total = total, total + n
    start = F.create_map(*[F.lit(x).cast("long") for k in before for x in (k, before[k])]) if before else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    return at.select(order, (F.element_at(start, F.col("part").cast("long")) + F.col("row")).alias("rank"))


def with_next(df: DataFrame, order: str, columns: list[str]) -> tuple[DataFrame, object, object]:
    """``df`` dealt out in windows of consecutive rows by descending ``order`` (null last), so that the next row is at hand.

    Returns the rows, the window to look ahead in, and the condition that holds for the rows of ``df``: the last row
    of each window is a copy of the first row of the next window (of the first one, at the end).  ``columns`` orders
    rows with equal ``order`` by a hash of these columns.  Windows come from quantiles of ``order``, each cut into equal
    ranges; rows without ``order``, and those of a value that a large part of the rows have, are dealt to windows by
    that hash.  Rows go through one shuffle; where ``order`` isn't a number, a join with its ranks comes before it.
    """
    rows = df.withColumn("__tie__", F.xxhash64(*columns)).withColumn("__at__", F.col(order))
    if not isinstance(df.schema[order].dataType, T.NumericType):
        ranks = dense_rank(df, order).withColumnsRenamed({order: "__of__", "rank": "__rank__"})
        rows = rows.join(ranks, F.col(order) == F.col("__of__"), "left").withColumn("__at__", F.col("__rank__")).drop("__of__", "__rank__")
    at, tie = F.col("__at__"), F.col("__tie__")
    bounds = rows.agg(F.count("*").alias("n"), F.count(at).alias("some"), F.min(at).alias("low"), F.max(at).alias("high"), F.percentile_approx(at, [k / QUANTILES for k in range(1, QUANTILES)], 10_000).alias("q")).first()
    edges = sorted({bounds.low, *(bounds.q or []), bounds.high}) if bounds.low is not None else [0]
    parts = max(1, -(-bounds.n // (WINDOW_ROWS * QUANTILES)))
    most = max(HOT_ROWS, bounds.n // HOT_SHARE)
    hot = sorted((tuple(r) for r in rows.filter(at.isNotNull()).groupBy(at).count().filter(F.col("count") > most).collect()), reverse=True) if bounds.n > most else []
    lows = F.array(*[F.lit(x).cast("double") for x in edges])
    widths = F.array(*[F.lit(max(b - a, 1)).cast("double") for a, b in zip(edges, [*edges[1:], edges[-1] + 1], strict=True)])
    piece = (sum((at >= F.lit(x)).cast("int") for x in edges[1:]) if edges[1:] else F.lit(0)) + F.lit(1)
    part = F.least(F.floor((at.cast("double") - F.element_at(lows, F.col("__piece__"))) / F.element_at(widths, F.col("__piece__")) * parts), F.lit(parts - 1))
    # within a window: what is above a hot value, the value, and what is below it, each in its turn
    turn = sum(((at <= F.lit(h)).cast("int") + (at < F.lit(h)).cast("int") for h, _ in hot), F.lit(0))
    own = F.when(at.isNull(), F.lit(-(-(bounds.n - bounds.some) // WINDOW_ROWS)))
    for h, n in hot:
        own = own.when(at == F.lit(h), F.lit(-(-n // WINDOW_ROWS)))
    deal = F.coalesce(F.least(F.floor((0.5 - tie / F.lit(2.0**64)) * own), own - 1), F.lit(0)).cast("long")
    rows = rows.withColumn("__piece__", piece).withColumn("__number__", F.coalesce(-(F.col("__piece__") * parts + part), F.lit(1)).cast("long")).drop("__piece__")
    rows = rows.withColumn("__window__", F.struct(F.col("__number__").alias("number"), F.coalesce(turn, F.lit(0)).alias("turn"), deal.alias("deal"))).drop("__number__")
    first = rows.groupBy("__window__").agg(F.max(F.struct(at.isNotNull().alias("some"), at.alias("at"), tie.alias("tie"))).alias("head"))
    first = durable(first.withColumn("__level__", F.floor(F.col("__window__.number") / LEVEL_ROWS)), "heads")
    ends = first.groupBy("__level__").agg(F.max("__window__").alias("end"))
    ends = ends.select("__level__", F.coalesce(F.lag("end").over(Window.orderBy("__level__")), F.max("end").over(Window.partitionBy())).alias("__before__"))
    heads = first.join(ends, "__level__").withColumn("__to__", F.coalesce(F.lag("__window__").over(Window.partitionBy("__level__").orderBy("__window__")), F.col("__before__")))
    heads = heads.select("__to__", F.col("head.at").alias("__head__"), F.col("head.tie").alias("__head_tie__"))
    heads = F.broadcast(heads) if bounds.n // WINDOW_ROWS < HEADS_BROADCAST else heads
    copies = rows.join(heads, [at.eqNullSafe(F.col("__head__")), tie == F.col("__head_tie__")]).dropDuplicates(["__to__"])
    copies = copies.withColumn("__window__", F.col("__to__")).select(*rows.columns, F.lit(1).alias("__copy__"))
    rows = rows.withColumn("__copy__", F.lit(0)).unionByName(copies)
    ahead = Window.partitionBy("__window__").orderBy("__copy__", at.desc_nulls_last(), tie.desc())
    return rows, ahead, F.col("__copy__") == 0


def compare_with_edits(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """For every row: n_chars, edited_sha256, its anchors and those of the edited text, and near_edited and near_next,
    the likeness of its fingerprint to the edited text's and to the next document's.

    The edited text has, in the place of the last floor(n_chars / 2) code points, the first as many (or all) of the next
    document by descending ``doc_id``, of any type that has an order; after the last comes the first.  Null texts count
    as empty; of rows with equal ids the order is that of a hash of the text (rows that repeat both are interchangeable),
    null ids are last, a single row is its own next, an empty table gives an empty one.
    """
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows, ahead, own = with_next(rows, "doc_id", ["text"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("next", F.lead("text").over(ahead)).withColumn("n_chars", F.char_length("text"))
    rows = rows.withColumn("edited", F.when(own, F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - half), F.substring(F.col("next"), F.lit(1), half)))).drop("next")
    rows = anchors(anchors(rows, "text", "found"), "edited", "edited_found").drop("text")
    rows = rows.withColumn("next_hashes", F.lead(F.col("found")["hash"]).over(ahead)).filter(own)
    rows = rows.withColumn("__a__", F.col("found")["hash"]).withColumn("__b__", F.col("edited_found")["hash"])
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "found",
        "edited_found",
        likeness("__a__", "__b__").alias("near_edited"),
        likeness("__a__", "next_hashes").alias("near_next"),
    )
