"""Connected components of a graph given as a table of edges, for graphs of any size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwright.session import write_table

#: Edges a task holds in its union-find before it hands on what it has.
EDGES_HELD = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of a task: each node seen, with the least node it is joined to."""
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        top = node
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[node] != top:
            parent[node], node = top, parent[node]
        return top

    def drain() -> pa.RecordBatch:
        pairs = [(node, root(node)) for node in list(parent)]
        parent.clear()
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_pydict(
            {"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())}
        )

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > EDGES_HELD:
            yield drain()
    yield drain()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (two long columns ``a, b``; no nulls).

    The component is its least node. Tasks first reduce their edges to forests by union-find;
    then rounds of large stars and small stars (every node tells its neighbours of the least
    node it knows) go on until nothing changes. Minima are taken before the shuffle, so a node
    with very many neighbours is no burden. No edges give an empty table.
    """
    links = write_table(edges.mapInArrow(_forest, "a long, b long").distinct(), "links")
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("low"))
        large = (
            both.filter("b > a")
            .join(least, "a")
            .select(F.col("b").alias("a"), F.least("low", "a").alias("b"))
        )
        large = large.distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(lower, "a")
            .select(F.when(F.col("b") != F.col("low"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("low").alias("b"))
            .distinct()
        )
        after = write_table(small, "links")
        state = [
            t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            for t in (links, after)
        ]
        links = after
        if state[0] == state[1]:
            break
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(links.select("b", "b").distinct())
