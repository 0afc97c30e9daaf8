"""Nearest vectors by cosine similarity, against a stated set of queries."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .guards import GuardError
from .ranks import top_k

#: Query vectors that are shipped at once, and vectors that meet them in one product.
QUERY_BLOCK, ROWS = 20_000, 2_048
#: Products that a task holds at once.
PRODUCTS = 4 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of numbers, of unit length but for 1e-12."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    rows = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    return rows / (np.sqrt((rows * rows).sum(1, keepdims=True)) + 1e-12)


def nearest(queries: DataFrame, vectors: DataFrame, query_id: str, vector_id: str, embedding: str, k: int, digits: int = 9, most_queries: int = 1_000_000) -> DataFrame:
    """(query, neighbour, similarity): each query's k most similar vectors, itself aside, ties by id; rows with a null
    embedding are left out.

    Exact: every vector meets every query.  Blocks of queries are shipped to the tasks as unit vectors, and batches of
    vectors meet them in matrix products; a task keeps k neighbours a query, so what is shuffled is k rows a query and
    task, whatever the number of vectors.  The queries are a stated set: more than ``most_queries`` are refused.
    """
    n = queries.count()
    if n > most_queries:
        raise GuardError(f"{n} queries are more than {most_queries}")
    spark = queries.sparkSession
    every = vectors.filter(F.col(embedding).isNotNull()).select(F.col(vector_id).alias("neighbour"), F.col(embedding).cast("array<double>").alias("v"))
    wanted = queries.filter(F.col(embedding).isNotNull()).select(F.col(query_id).alias("query"), F.col(embedding).cast("array<double>").alias("v"), F.pmod(F.xxhash64(query_id), F.lit(max(1, -(-n // QUERY_BLOCK)))).alias("b"))
    schema = T.StructType([T.StructField("query", wanted.schema["query"].dataType), T.StructField("neighbour", every.schema["neighbour"].dataType), T.StructField("similarity", T.DoubleType())])
    found = None
    for b in range(max(1, -(-n // QUERY_BLOCK))):
        block = wanted.filter(F.col("b") == b).toArrow()
        shipped = spark.sparkContext.broadcast((block.column("query").to_pylist(), _matrix(block.column("v").combine_chunks())))
        part = every.mapInArrow(_searcher(shipped, k, digits), schema)
        found = part if found is None else found.unionByName(part)
    return top_k(found, ["query"], [F.col("similarity").desc(), F.col("neighbour")], k)


def _searcher(shipped: object, k: int, digits: int):  # noqa: ANN202
    """The neighbours of the shipped queries among a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, units = shipped.value
        if not names:
            return
        own = np.array(names, object)
        heaps: list[list[tuple[float, object]]] = [[] for _ in names]
        limit = np.full(len(names), -np.inf)
        step = max(1, PRODUCTS // len(names))
        kind = None
        for batch in batches:
            kind = batch.schema.field("neighbour").type
            for start in range(0, batch.num_rows, min(step, ROWS)):
                part = batch.slice(start, min(step, ROWS))
                ids = np.array(part.column("neighbour").to_pylist(), object)
                products = np.round(units @ _matrix(part.column("v")).T, digits)
                products[own[:, None] == ids] = -np.inf
                for q in np.flatnonzero(products.max(1) >= limit):
                    for at in np.flatnonzero(products[q] >= limit[q]):
                        if products[q, at] > -np.inf:
                            heaps[q].append((products[q, at], ids[at]))
                    if len(heaps[q]) > k:
                        heaps[q] = heapq.nsmallest(k, heaps[q], key=lambda x: (-x[0], x[1]))
                        limit[q] = heaps[q][-1][0]
        rows = [(name, i, float(s)) for name, heap in zip(names, heaps, strict=True) for s, i in heap]
        for start in range(0, len(rows), 50_000):
            q, i, s = zip(*rows[start : start + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i, kind), pa.array(s, pa.float64())], ["query", "neighbour", "similarity"])

    return run
