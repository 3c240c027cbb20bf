"""Connected components of a graph given by its links, with Spark joins alone."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphstream.llm.common import cut, release

#: So many links are joined in one task: 2 MB of links, 4 MB of nodes and roots at most.
TASK_LINKS = 1 << 17


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links (a, b) in batches, which are few."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(find, nodes), pa.int64())], ["node", "root"])


def connected_components(edges: DataFrame, most: int = TASK_LINKS) -> DataFrame:
    """(node, root) for each node of the links (a, b) between longs; the root is its component's smallest node.

    Up to `most` different links are joined in one task, and the result is marked for broadcast.  More alternate two steps
    until nothing changes: every node links its larger neighbours to the
    smallest of its neighbourhood, then every node links its smaller neighbours and itself to the
    smallest.  Links never become more; each round is cut off from the one before.  Nodes must not be null;
    a link of a node to itself is ignored.  No links give no rows.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if e.count() <= most:
        return F.broadcast(cut(e.coalesce(1).mapInArrow(joined, "node bigint, root bigint")))
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        e = cut(small)
        del both, least, large, small
        release(e.sparkSession)
