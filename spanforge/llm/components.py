"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.runtime import drop_staged, stage

#: Tasks that a hub's links are spread over in each join.
SALTS = 8
#: Links (16 bytes each) that one task may finish.
FEW = 1 << 19


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a star forest that connects what the links (a, b) connect: each node to the smallest of its part."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A star forest of a task's links, or several where even what is left of them is long."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return forest(*(np.concatenate(x) for x in zip(*held, strict=True)))

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size > 2 * FEW:
            held = [merged()]
            size = len(held[0][0])
            if size > FEW:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["u", "v"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["u", "v"])


def _with_lowest(edges: DataFrame, low: DataFrame) -> DataFrame:
    """edges (u, v) with m of (u, m), joined by u and a salt from v, so that no task gets all links of a hub."""
    salted = low.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return edges.withColumn("salt", F.pmod(F.hash("v"), F.lit(SALTS))).join(salted, ["u", "salt"]).drop("salt")


def _settled(edges: DataFrame) -> bool:
    """Whether links (u, v), u > v, are stars already: no u has two v, and no v is a u."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR out + into > 1").isEmpty()


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) for every node of links (a long, b long), root the smallest node reachable; roots included.

    Links are replaced by star forests, of each task's links first. Once at most `few` are left, which is
    counted, one task's forest is the result. While there are more, every round sends each node's larger
    neighbours, and then its smaller ones, to the smallest of them; minima are pre-aggregated and rounds
    are staged, so neither a hub's links nor the links as a whole meet in one place. The rounds end when
    all links are stars, after O(log^2) of them at most. An empty table gives an empty one.
    """
    a, b = links.columns
    light = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = stage(light.mapInArrow(_contract, "u long, v long"), "links")
    first = True
    while True:
        count = edges.count()
        if first or count <= few:
            old, edges = edges, stage(edges.coalesce(max(1, -(-count // few))).mapInArrow(_contract, "u long, v long"), "links")
            drop_staged(old)
        if count <= few or _settled(edges):
            break
        first = False
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _with_lowest(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_lowest(large, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        old, edges = edges, stage(small.distinct(), "links")
        drop_staged(old)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
