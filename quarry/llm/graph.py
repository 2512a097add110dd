"""Connected components of an edge table by alternating large stars and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_scratch, materialise

FOREST = 1 << 18  # edges that one task joins by itself


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _stars_of(batches: list, centres: bool):
    """The edges of some batches as stars: every node with the smallest of its component, that one itself only with `centres`."""
    a, b = (pa.chunked_array([x.column(c) for x in batches]).combine_chunks() for c in ("a", "b"))
    both = pa.concat_arrays([a, b]).dictionary_encode()
    order = pc.sort_indices(both.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    ends = rank[both.indices.to_numpy()]
    f = Forest(len(order))
    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist()):
        f.join(x, y)
    root = np.array([f.find(x) for x in range(len(order))], np.int64)
    leaf = np.arange(len(order)) if centres else np.flatnonzero(root != np.arange(len(order)))
    nodes = both.dictionary.take(order)
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(root[leaf])), nodes.take(pa.array(leaf))], ["a", "b"])


def _local(centres: bool):
    def run(it):
        held, n = [], 0
        for b in it:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= FOREST:
                yield _stars_of(held, centres)
                held, n = [], 0
        if held:
            yield _stars_of(held, centres)

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges (a, b): the label is the smallest node of the component.

    Tasks of up to FOREST edges first make stars of what they hold; what fits one task is done then. Else
    each round joins every node's larger neighbours with the smallest node around it (large star), then
    every node's smaller neighbours and itself with the smallest of these (small star), until every
    component is one star; the number of rounds grows with the square of the logarithm of the nodes at
    most. Nothing is collected, and what a round has read is deleted. A hub's minimum is pre-aggregated
    map-side and written: AQE splits the hub's edges where they meet it, as it would not beside an aggregate.
    """
    spark, old = edges.sparkSession, []
    rest = materialise(edges.filter("a <> b").select("a", "b"), "edges", old)
    tasks = -(-rest.count() // (FOREST // 2))  # files are not of one size
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema)
    rest = rest.coalesce(max(1, tasks)).mapInArrow(_local(tasks <= 1), kind)
    if tasks <= 1:  # all in one piece
        out = materialise(rest.select(F.col("b").alias("node"), F.col("a").alias("label")), "labels")
        drop_scratch(spark, old)
        return out
    new = []
    rest = materialise(rest.distinct(), "edges", new)
    drop_scratch(spark, old)
    old = new
    while not _stars(rest):
        new = []
        both = rest.select(F.col("a").alias("node"), F.col("b").alias("to")).union(rest.select("b", "a"))
        least = materialise(both.groupBy("node").agg(F.least("node", F.min("to")).alias("a")), "least", old)
        large = both.join(least, "node").filter("to > node").select("a", F.col("to").alias("b"))
        large = materialise(large.distinct(), "large", old)
        least = materialise(large.groupBy("b").agg(F.min("a").alias("least")), "least", old)
        small = large.join(least, "b")
        small = small.select(F.col("least").alias("a"), "b").union(small.filter("a <> least").select("least", "a"))
        rest = materialise(small.distinct(), "edges", new)
        drop_scratch(spark, old)
        old = new
    out = rest.select(F.col("b").alias("node"), F.col("a").alias("label")).union(rest.select("a", "a").distinct())
    out = materialise(out, "labels")
    drop_scratch(spark, old)
    return out


def _stars(edges: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or smaller and larger ones."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("a", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").limit(1).count()
