"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import settled

#: Up to so many edges are solved in one task; beyond, by rounds of stars over all tasks.
ONE_TASK = 20_000


def _forest(batches):
    """The edges of one partition as stars: (node, smallest node it reaches here)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [*parent]
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.array([root(x) for x in part], np.int64))], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node it is connected to.

    Each partition first shrinks its edges to stars. A small rest is solved in one task. A large one goes through
    alternating large-star and small-star rounds, each a grouped minimum that is combined before the
    shuffle, until nothing changes; their number grows with the logarithm of the longest path.
    Nulls are left out; an empty table gives an empty one.
    """
    stars = settled(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna().mapInArrow(_forest, "a long, b long"))
    if stars.count() <= ONE_TASK:
        return stars.coalesce(1).mapInArrow(_forest, "node long, root long")
    now = stars
    while True:
        both = now.where("a <> b").select("a", "b").union(now.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: bigger neighbours of a node hang on its least neighbour
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        # small star: smaller neighbours, and the node itself, hang on the least of them
        low = large.where("b < a").groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").union(low.select(F.col("a").alias("x"), "m")).where("x > m").groupBy("x", "m").count().select(F.col("x").alias("a"), F.col("m").alias("b"))
        nxt = settled(small)
        # done when every node has one parent and no parent has a parent
        open_ = nxt.groupBy("a").count().where("count > 1").limit(1).union(nxt.select(F.col("b").alias("a")).join(nxt.select("a"), "a", "left_semi").withColumn("count", F.lit(0).cast("long")).limit(1))
        if open_.isEmpty():
            roots = nxt.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return nxt.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        now = nxt
