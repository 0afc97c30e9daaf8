"""Sharding by balanced label propagation, in DataFrame operations alone.

Documents with equal texts are linked; a link is cut if its ends are in different shards.  Labels start from the order
of the documents' hashes cut into equal stretches, which knows nothing of links.  In each round, by joins, every linked
document sees how much of its group each shard holds and, unless it is there, asks to move to the shards that hold most,
as many as have room for the group; a shard admits as many as its quota has room for, in the order of their hashes, so
no shard outgrows its quota and every admitted move leaves fewer links cut.  Rounds go on until no document moves.
Documents without links then fill all shards up to their quotas exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._prefix import attach, hash_key, prefix_sums
from ._store import durable

SHARDS = 40
#: Bytes that a row has besides its text.
ROW_BYTES = 16


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (none if it is null), and those of the row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def _pick(values: Sequence[float], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place + 1).cast("int"))


def _stretch(position: Column, widths: Sequence[float]) -> Column:
    """The place of the stretch that holds a position, the stretches standing one after another; the last at most."""
    ends, total = [], 0
    for width in widths[:-1]:
        total += width
        ends.append(total)
    return sum((position >= F.lit(e)).cast("int") for e in ends) if ends else F.lit(0)


def _loads(state: DataFrame, shards: int) -> list[int]:
    """Weight that each shard holds: as many numbers as there are shards."""
    found = dict(state.groupBy("shard").agg(F.sum("weight")).collect())
    return [found.get(k) or 0 for k in range(shards)]


def _moved(state: DataFrame, quotas: Sequence[int], whole: bool, rows: int | None = None) -> DataFrame | None:
    """``state`` after one round, None if no row moves.  With ``whole`` a group prefers shards that have room for all of
    it to those that hold more of it.  ``rows``: how many there are, if that is known."""
    group = Window.partitionBy("link")
    room = [max(0, q - n) for q, n in zip(quotas, _loads(state, len(quotas)), strict=True)]
    votes = state.groupBy("link", "shard").agg(F.sum("weight").alias("votes"), F.max("weight").alias("most"))
    votes = votes.withColumn("total", F.sum("votes").over(group)).withColumn("most", F.greatest(F.max("most").over(group), F.lit(1))).filter(F.col("votes") < F.col("total"))
    # a group keeps the shards that hold most of it, as many as have room for all of it, in whole rows
    free = _pick(room, F.col("shard"))
    votes = votes.withColumn("free", free - free % F.col("most"))
    fits = F.when(F.lit(whole) & (F.col("votes") + F.col("free") >= F.col("total")), 0).otherwise(1)
    by_votes = group.orderBy(fits, F.desc("votes"), F.pmod(F.xxhash64("link", "shard"), F.lit(1 << 30)), "shard")
    before = by_votes.rowsBetween(Window.unboundedPreceding, -1)
    votes = votes.withColumn("stays", F.coalesce(F.sum(F.col("votes") + F.col("free")).over(before), F.lit(0)) < F.col("total"))
    votes = votes.withColumn("end", F.sum("free").over(by_votes.rowsBetween(Window.unboundedPreceding, 0)))
    kept = F.collect_list(F.when(F.col("stays") & (F.col("free") > 0), F.struct("end", "shard"))).over(group)
    wish = durable(votes.withColumn("ends", F.array_sort(kept)).filter(~F.col("stays")).select("link", "shard", "ends"), "wishes", rows)
    if wish.isEmpty():
        return None
    movers = attach(state, wish, ["link", "shard"], "uid")
    movers = prefix_sums(movers, ["link"], [F.col("key"), F.col("uid")], "key", "weight", "at")
    movers = movers.withColumn("to", F.get(F.filter("ends", lambda e: e["end"] > F.col("at")), F.lit(0))["shard"]).filter("to is not null").drop("ends", "at")
    movers = durable(movers, "movers", rows)
    movers = prefix_sums(movers, ["to"], [F.col("key"), F.col("uid")], "key", "weight", "before")
    movers = durable(movers.filter(F.col("before") + F.col("weight") <= _pick(room, F.col("to"))).select("uid", "to"), "moves", rows)
    if movers.isEmpty():
        return None
    return durable(state.join(movers, "uid", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"), "state", rows)


def _together(state: DataFrame) -> int:
    """How much of each group is together: the squares of what each shard holds of it."""
    held = state.groupBy("link", "shard").agg(F.sum("weight").cast("decimal(38,0)").alias("n"))
    return held.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0


def propagate(state: DataFrame, quotas: Sequence[int], rounds: int | None = None, rows: int | None = None) -> DataFrame:
    """Linked rows (uid, link, key, weight, shard) after label propagation under quotas of weight, until no row moves
    or for ``rounds`` at most.  ``rows``: how many there are, if that is known, so that small tables are few files.

    Rows move to shards that hold more of their group, so that comes to an end.  Groups that are apart then because the
    shards that hold most of them are full go on to those that have room for them, as long as each round brings more
    together."""
    done = 0
    while rounds is None or done < rounds:
        moved = _moved(state, quotas, False, rows)
        if moved is None:
            break
        state, done = moved, done + 1
    best = _together(state)
    while rounds is None or done < rounds:
        moved = _moved(state, quotas, True, rows)
        if moved is None or (now := _together(moved)) <= best:
            break
        state, best, done = moved, now, done + 1
    return state


def cut_links(df: DataFrame, link: str, shard: str) -> DataFrame:
    """One row: ``links``, the pairs of rows with equal ``link`` (not null), and ``cut``, those of them in different
    shards.  Counted from the groups' sizes, without a pair."""
    pairs = lambda n: F.coalesce(F.sum(F.col(n) * (F.col(n) - 1) / 2), F.lit(0)).cast("long")
    held = df.filter(F.col(f"`{link}`").isNotNull()).groupBy(F.col(f"`{link}`").alias("l"), F.col(f"`{shard}`").alias("s")).agg(F.count("*").alias("n"))
    groups = held.groupBy("l").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("whole"))
    return groups.agg(pairs("m").alias("links"), (pairs("m") - F.coalesce(F.sum("whole"), F.lit(0)).cast("long")).alias("cut"))


def balanced_shards(df: DataFrame, link: Column, doc_id: str = "doc_id", size: str = "size", shards: int = SHARDS, law: str = "rows", rounds: int | None = None) -> DataFrame:
    """``df`` with law, shard (from 0), slot (from 0 in each shard, without gaps) and start_shard (where label
    propagation found the row; null for a row without links).

    Rows with equal ``link`` (null is one value) are linked.  ``law``: "rows" makes the shards' row counts differ by one
    at most, "bytes" their sums of ``size`` by about one row's size.  The order of rows is that of hashes of ``doc_id``,
    so reruns agree; null ids hash like empty strings, and rows that repeat an id are told apart by a number.  A group
    larger than a shard is cut into as few shards as the quotas allow, or nearly.  An empty table gives an empty one.
    Columns of ``df`` with the new names give way.
    """
    weight = F.lit(1).cast("long") if law == "rows" else F.col(size).cast("long")
    names = [c for c in df.columns if c.lower() not in ("law", "shard", "slot", "start_shard")]
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]
    linked = F.coalesce(link.cast("long"), F.lit(-1).cast("long"))
    rows = df.select(*own, F.monotonically_increasing_id().alias("uid"), linked.alias("link"), hash_key("shard", F.col(doc_id)).alias("key"), weight.alias("weight"))
    rows = durable(rows, "rows")
    total, n = rows.agg(F.sum("weight"), F.count("*")).first()
    total = total or 0
    groups = durable(rows.groupBy("link").agg(F.count("*").alias("n")).filter("n > 1"), "groups", n).select("link")
    quotas = [total // shards + (k < total % shards) for k in range(shards)]

    linked = durable(attach(rows.select("uid", "link", "key", "weight"), groups, ["link"], "uid"), "linked", n)
    held, n_linked = linked.agg(F.sum("weight"), F.count("*")).first()
    held = held or 0
    widths = [q * held / total if total else 0.0 for q in quotas]
    state = prefix_sums(linked, [], [F.col("key"), F.col("uid")], "key", "weight", "at")
    state = durable(state.select("uid", "link", "key", "weight", _stretch(F.col("at"), widths).cast("int").alias("shard")), "state", n_linked)
    start = state.select("uid", F.col("shard").alias("start_shard"))
    state = propagate(state, quotas, rounds, n_linked)

    # what stands past a shard's quota leaves it, and fills gaps with the rows without links
    state = durable(prefix_sums(state, ["shard"], [F.col("key"), F.col("uid")], "key", "weight", "before"), "state", n_linked)
    stays = state.filter(F.col("before") + F.col("weight") <= _pick(quotas, F.col("shard"))).select("uid", "shard", "weight")
    gaps = [max(0, q - n) for q, n in zip(quotas, _loads(stays, shards), strict=True)]
    rest = durable(rows.join(stays.select("uid"), "uid", "left_anti").select("uid", "key", "weight"), "rest", n)
    rest = prefix_sums(rest, [], [F.col("key"), F.col("uid")], "key", "weight", "before")
    rest = rest.select("uid", _stretch(F.col("before"), gaps).cast("int").alias("shard"))
    placed = rows.drop("weight", "link").join(stays.select("uid", "shard").unionByName(rest), "uid").join(start, "uid", "left")
    placed = durable(placed.withColumn("one", F.lit(1)), "placed", n)
    slots = prefix_sums(placed, ["shard"], [F.col("key"), F.col("uid")], "key", "one", "slot")
    return slots.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "start_shard")


def text_link(text: Column) -> Column:
    """A name of 60 bits for equal texts (null and empty alike), from their digest."""
    return F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 15), 16, 10).cast("long")


def shard_documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **options: object) -> DataFrame:
    """doc_id, size, text_crc32 (0 for a null text), law, shard, slot and start_shard of every row; equal texts, null and
    empty alike, are linked."""
    rows = df.select(F.col(doc_id), text_size(F.col(text)).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"), text_link(F.col(text)).alias("__link__"))
    return balanced_shards(rows, F.col("__link__"), doc_id, **options).drop("__link__")
