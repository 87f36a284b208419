"""Connected components by contraction of edge chunks, and large-star and small-star rounds on written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeclock.shared import materialise


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v).  Minima are written first, so a join on a node with very many edges can be split."""
    least = materialise(pairs.groupBy("u").agg(F.min("v").alias("m")), "minima")
    joined = pairs.join(least.withColumn("m", F.least("u", "m")), "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


#: Edges that one task contracts at most: a fixed bound, so no task grows with the graph.
CHUNK = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a chunk's edges by an edge from every node to the smallest node it is connected to within the chunk."""
    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    top = np.array([find(i) for i in range(len(nodes))])
    inner = top != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[inner]), pa.array(nodes[top[inner]])], names=["u", "v"])


def components(links: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node, root) for every node of an undirected link table (a, b), root being the smallest node of its component.

    Each round contracts chunks of at most about ``chunk`` edges on their own, then takes a large-star and a small-star step over all of
    them.  A graph within one chunk is done after its contraction; otherwise the rounds end when the edges stay as they
    are.  Edges only ever move towards smaller nodes of the same component.  ``links`` is read more than once: pass
    a written table.  Each round reads files alone and survives lost executors.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = materialise(edges, "edges"), None
    while True:
        size, mix = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if size == 0 or (size, mix) == before:
            break
        before = (size, mix)
        chunks = -(-size // chunk)
        edges = materialise(edges.repartition(chunks).mapInArrow(_contract, "u long, v long"), "contracted")
        if chunks == 1:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialise(_star(both, True).where("u != v").distinct(), "large")
        edges = materialise(_star(large, False).where("u != v").distinct(), "small")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
