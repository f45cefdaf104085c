"""Connected components of an edge table: union-find in bounded blocks, then alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Edges of one block at most on average; a task holds the nodes of one block.
BLOCK_EDGES = 1_000_000


def contract(edges: DataFrame, blocks: int) -> DataFrame:
    """(u, v): each block's nodes with the least node of their component in that block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for batch in batches:
            for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                a, b = top(a), top(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        rows = [(x, top(x)) for x in list(up)]
        for at in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 50_000])], names=["u", "v"])

    return edges.select("u", "v").coalesce(blocks).mapInArrow(run, "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, block_edges: int = BLOCK_EDGES, most: int = 60) -> DataFrame:
    """(node, component) for every node of a checkpointed edge table; the component is its least node.

    Blocks of edges are contracted by union-find in memory that ``block_edges``
    bounds. Where there is more than one block, large and small stars join what
    the blocks found; aggregates come before every join there, so a hub's edges
    never meet in one group, and each round is checkpointed in the shared folder.
    """
    blocks = max(1, -(-edges.count() // block_edges))
    at = checkpoint(contract(edges, blocks))
    if blocks > 1:
        before, at = None, at.filter("u <> v").distinct()
        for _ in range(most):
            at = checkpoint(_small_star(_large_star(at)))
            now = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if before == now:
                break
            before = now
        else:
            raise RuntimeError("components did not settle")
    return at.select(F.col("u").alias("node"), F.col("v").alias("component"))
