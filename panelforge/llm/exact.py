"""Exact dedup by deterministic block naming.

A text without its blanks is cut into blocks of fixed size.  Equal blocks, and only they, get the same integer: the
blocks are dealt out by a hash, sorted, and named in their order, and names are given by comparing whole blocks.  Then
adjacent pairs of a document's names are named in the same way, level by level, until each document has one name;
documents that end at the same level with the same name have equal texts.  No step trusts a hash.

Each run of rows (a bounded chunk of a task's input) first merges its own equal items, so an item reaches the
naming task once per chunk, however many rows hold it.  Blocks that very many rows hold are merged by map-side
aggregation instead, named apart, and meet their names in parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._prefix import KEYS, attach, dealt_totals, prefix_sums
from ._store import durable, small_batches
from ._text import BLANKS, filled, flat, lists, pieces_of, tidied

BLOCK_BYTES = 4096
#: Texts of one chunk, and its rows.
CHUNK_BYTES, CHUNK_ROWS = 4 << 20, 4096
#: Rows from which a block that they hold is named apart.
HOT_ROWS = 1 << 20

_OWN = [("chunk", T.LongType()), ("uid", T.LongType())]


def _emit(part: pa.RecordBatch, keep: list[str], more: list[pa.Array], chunk: int, items: list[list[bytes]]) -> pa.RecordBatch:
    """One row for each row of the chunk, with places in the chunk's list of distinct items, and one for each of those."""
    place: dict[bytes, int] = {}
    refs = [[place.setdefault(x, len(place)) for x in row] for row in items]
    n, m = len(refs), len(place)
    at = np.concatenate(([0], np.cumsum([len(r) for r in refs], dtype=np.int64)))
    of_rows = lists(np.array([x for r in refs for x in r], np.int32), at)
    block = list(place)
    route = np.array([xxhash.xxh64_intdigest(x, 42) for x in block], np.uint64).view(np.int64)  # as Spark's xxhash64
    none = lambda kind: pa.nulls(m, kind)
    columns = [pa.concat_arrays([c if isinstance(c, pa.Array) else c.combine_chunks(), none(c.type)]) for c in [*[part.column(k) for k in keep], *more]]
    return pa.RecordBatch.from_arrays(
        [
            *columns,
            pa.array(np.full(n + m, chunk, np.int64)),
            pa.concat_arrays([pa.array(chunk * CHUNK_ROWS + np.arange(n)), none(pa.int64())]),
            pa.concat_arrays([of_rows, none(of_rows.type)]),
            pa.array(np.concatenate((np.full(n, chunk * 0x9E3779B97F4A7C15 % (1 << 63), np.int64), route))),
            pa.array([None] * n + list(range(m)), pa.int32()),
            pa.array([None] * n + block, pa.binary()),
        ],
        [f"c{k}" for k in range(len(columns))] + ["chunk", "uid", "refs", "route", "place", "item"],
    )


def _chunks(batches: Iterator[pa.RecordBatch], cut: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Chunks of a task's rows with numbers that no other chunk has."""
    number = TaskContext.get().partitionId() << 26
    for batch in batches:
        for part in cut(batch):
            for start in range(0, part.num_rows, CHUNK_ROWS):
                yield number, part.slice(start, CHUNK_ROWS)
                number += 1


def _hot_blocks(source: DataFrame, text: str) -> DataFrame | None:
    """The routes of blocks that more than HOT_ROWS rows hold, None if there are none: a pass of built-in functions over
    the texts, whose counts are added up before they are shuffled."""
    bare = F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS.decode(), "").cast("binary")
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.octet_length("b") - 1) / BLOCK_BYTES), F.lit(0)).cast("int"))
    blocks = F.transform(starts, lambda k: F.xxhash64(F.substring(F.col("b"), k * BLOCK_BYTES + 1, F.lit(BLOCK_BYTES))))
    routes = source.select(bare.alias("b")).select(F.explode(F.array_distinct(blocks)).alias("route"))
    found = durable(routes.groupBy("route").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_ROWS).select("route"), "hot")
    return None if found.isEmpty() else found


def _named(parts: DataFrame, carried: list[T.StructField], level: int, hot: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Names for the items of ``parts``; rows that have one name now, and rows that have several.  Items of the routes in
    ``hot`` are named apart."""
    fields = T.StructType([*carried, *[T.StructField(n, k) for n, k in _OWN], T.StructField("refs", T.ArrayType(T.IntegerType())), T.StructField("place", T.IntegerType()), T.StructField("name", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last = (TaskContext.get().partitionId() << 40) - 1, None
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                names = []
                for item in part.column("item"):
                    if (item := item.as_py()) is not None and item != last:
                        name, last = name + 1, item
                    names.append(None if item is None else name)
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in fields.fields[:-1]], pa.array(names, pa.int64())], fields.names)

    apart = None
    if hot is not None:
        busy = attach(parts.filter("uid is null").select("route", "chunk", "place", "item"), hot, ["route"], "chunk")
        known = busy.groupBy("route", "item").agg(F.count("*").alias("n"))
        own = durable(known.select("route", F.col("item").alias("same"), (-1 - F.row_number().over(Window.orderBy("route", "item"))).cast("long").alias("name")), "apart")
        apart = attach(busy, own, ["route"], "chunk").filter("item = same").select("chunk", "place", "name")
        parts = parts.join(hot.withColumn("busy", F.lit(True)), "route", "left").filter("uid is not null or busy is null").drop("busy")
    table = durable(parts.repartition("route").sortWithinPartitions("route", "item").mapInArrow(tidied(run), fields), f"names{level}")
    rows, names = table.filter("uid is not null").drop("place", "name"), table.filter("uid is null").select("chunk", "place", "name")
    names = names if apart is None else names.union(apart)
    own = [f.name for f in carried] + ["uid"]
    one = rows.filter(F.size("refs") == 1).withColumn("place", F.col("refs")[0]).join(names, ["chunk", "place"]).select(*own, F.lit(level).alias("level"), "name")
    many = rows.filter(F.size("refs") > 1).select(*own, "chunk", F.posexplode("refs").alias("pos", "place")).join(names, ["chunk", "place"])
    many = many.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("names"))
    return one, many.select(*own, F.col("names.name").alias("names"))


def identities(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns but ``text``) of every row, with n_points (code points of the text),
    text_sha256 (of the text without blanks), row_uid (a number of the row), and level and name: rows have the same
    pair exactly if their texts are equal without the characters [\\x20\\x09-\\x0D].

    Null texts count as empty, empty texts are equal to each other, repeated rows are rows, an empty table gives an
    empty one.  A column of ``df`` with one of the new names gives way.
    """
    small_batches(df.sparkSession)
    new = {"n_points", "text_sha256", "row_uid", "level", "name"}
    keep = [c for c in (df.columns if keep is None else keep) if c != text and c.lower() not in new]
    source = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], F.col(f"`{text}`").alias("t"))
    own = [f"c{k}" for k in range(len(keep) + 2)]
    carried = [*[T.StructField(f"c{k}", source.schema[f"c{k}"].dataType) for k in range(len(keep))], T.StructField(own[-2], T.LongType()), T.StructField(own[-1], T.StringType())]
    made = T.StructType([*carried, *[T.StructField(n, k) for n, k in _OWN], T.StructField("refs", T.ArrayType(T.IntegerType())), T.StructField("route", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("item", T.BinaryType())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part in _chunks(batches, lambda b: pieces_of(b, "t", CHUNK_BYTES)):
            column = filled(part.column("t"))
            data, at = flat(column)
            bare = [bytes(data[a:b]).translate(None, BLANKS) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            items = [[x[k : k + BLOCK_BYTES] for k in range(0, max(len(x), 1), BLOCK_BYTES)] for x in bare]
            more = [pc.utf8_length(column).cast(pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in bare], pa.string())]
            yield _emit(part, [f"c{k}" for k in range(len(keep))], more, chunk, items)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part in _chunks(batches, lambda b: iter([b])):
            rows = [np.array(x, "<i8") for x in part.column("names").to_pylist()]
            rows = [np.append(x, -1) if len(x) % 2 else x for x in rows]
            raw = [x.astype("<i8").tobytes() for x in rows]
            yield _emit(part, own, [], chunk, [[x[k : k + 16] for k in range(0, len(x), 16)] for x in raw])

    done, left = _named(source.mapInArrow(tidied(blocks), made), carried, 0, _hot_blocks(source, "t"))
    found, level = [done], 0
    while True:
        left = durable(left, f"left{level}")
        if left.isEmpty():
            break
        level += 1
        done, left = _named(left.mapInArrow(tidied(pairs), made), carried, level)
        found.append(done)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    names = [*keep, "n_points", "text_sha256"]
    return every.select(*[F.col(c).alias(n) for c, n in zip(own, names, strict=True)], F.col("uid").alias("row_uid"), "level", "name")


def exact_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Every row of ``identities`` with keep_id, group_size and kept.

    Of rows with equal texts, that with the most code points stays, then that with the smallest ``doc_id`` (null
    last), then, of repeated rows, any one: exactly one row of each group has kept = true.  A column of ``df`` with one
    of these names gives way.
    """
    keep = [c for c in (df.columns if keep is None else [doc_id, *keep]) if c != text and c.lower() not in ("keep_id", "group_size", "kept", "best")]
    rows = identities(df, text, list(dict.fromkeys(keep)))
    best = F.struct((-F.col("n_points")).alias("n"), F.col(f"`{doc_id}`").isNull().alias("none"), F.col(f"`{doc_id}`").alias("id"), F.col("row_uid").alias("uid"))
    out = dealt_totals(rows, ["level", "name"], "row_uid", {"best": F.min(best), "group_size": F.count("*")}, {"best": F.min("best"), "group_size": F.sum("group_size")})
    return out.withColumn("keep_id", F.col("best.id")).withColumn("kept", F.col("best.uid") == F.col("row_uid")).drop("best", "level", "name")


def kept_rows(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that stay, with all of its columns, whatever their names."""
    marked = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t"), F.xxhash64(F.col(f"`{text}`")).alias("h"))
    decided = exact_dedup(marked, "t", "id")
    return stay_rows(df, decided.select("id", "h", "kept"), text, doc_id)


def place_of(df: DataFrame, name: str) -> int:
    """The place of a column, by its name as Spark compares names."""
    return [c.lower() for c in df.columns].index(name.lower())


def stay_rows(df: DataFrame, decided: DataFrame, text: str, doc_id: str, null_text: str | None = None) -> DataFrame:
    """The rows of ``df`` for which ``decided`` (id, h: xxhash64 of the text, kept) says so.

    Of rows that share both id and hash, equal texts that is, as many stay as are kept: rows that are equal in all
    columns count as one with a number, those stand in the order of hashes of all columns, and the first ones stay.
    ``null_text``: what a null text counted as when it was hashed.  Columns of ``df`` may have any names.
    """
    names = list(df.columns)
    own = [f"c{k}" for k in range(len(names))]
    plain = df.toDF(*own)
    of_text, of_id = (F.col(own[place_of(df, n)]) for n in (text, doc_id))
    hashed = F.xxhash64(of_text) if null_text is None else F.xxhash64(F.coalesce(of_text, F.lit(null_text)))
    counts = decided.groupBy("id", "h").agg(F.sum(F.col("kept").cast("int")).alias("stay"), F.count("*").alias("n_rows"))
    counts = durable(counts.filter("stay > 0"), "stay")
    rows = plain.withColumn("key", hashed).join(counts, of_id.eqNullSafe(F.col("id")) & (F.col("key") == F.col("h"))).drop("key")
    alone = rows.filter("n_rows = stay").select(*own)
    if not counts.filter("n_rows > stay").isEmpty():
        same = rows.filter("n_rows > stay").groupBy(*own, "id", "h", "stay").agg(F.count("*").alias("n"))
        same = durable(same.withColumn("key", F.xxhash64(*own).bitwiseAND(F.lit(KEYS - 1))), "same")
        same = prefix_sums(same, ["id", "h"], [F.col("key"), *own], "key", "n", "before")
        same = same.withColumn("times", F.least("n", F.col("stay") - F.col("before")).cast("int")).filter("times > 0")
        alone = alone.unionByName(same.select(*own, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).drop("copy"))
    return alone.toDF(*names)
