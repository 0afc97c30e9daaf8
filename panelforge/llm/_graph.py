"""Connected components by joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import durable
from ._text import tidied

#: Edges up to which one task finds the components, in about 100 MB; the distributed rounds give the same labels.
ONE_TASK_EDGES = 300_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, label) by merging sets, for a number of edges that was checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
        nodes = list(parent)
        for k in range(0, len(nodes), 50_000):
            part = nodes[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([top(x) for x in part], pa.int64())], ["node", "label"])

    return edges.select("a", "b").coalesce(1).mapInArrow(tidied(run), "node long, label long")


def components(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(node, label) for all nodes of ``edges`` (a, b: long) and those of ``start`` that aren't alone: the least node of
    each component.

    Every round each node takes the least label among its own and its neighbours', then the label of its label, so a
    component of n nodes needs about log n rounds; each round's labels are written and the lineage ends there.  Only
    the number of changes comes to the driver.  ``start`` has labels from fewer edges.
    """
    links = edges.select("a", "b")
    if start is not None:  # a component that is known is a star around its label
        links = links.union(start.filter("node <> label").select("node", "label"))
    if links.count() <= ONE_TASK_EDGES:
        return durable(_in_one_task(links), "labels")
    both = links.union(links.select("b", "a")).filter("a <> b").distinct()
    both = durable(both, "edges")
    labels = durable(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        least = durable(least, "least")
        onward = least.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = durable(least.join(onward, "label", "left").select("node", "old", F.coalesce("next", "label").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.filter("old <> label").isEmpty():
            return labels
