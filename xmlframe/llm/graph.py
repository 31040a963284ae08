"""Connected components by alternating large-star and small-star steps, each a grouping and a join.

Up to AT_ONCE edges are joined up in one task instead, whose work and memory that number bounds: a round of steps has a dozen
shuffles, and what the driver keeps of their plans and tasks was more than the edges of a small graph.

Nothing is collected: the driver sees one row of counts per round.  Nodes with very many neighbours are dealt out by a salt,
so that no task gets all their edges; how many such nodes there can be is bounded, so they are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, as_batch

#: Edges that one task joins up (about 100 bytes each with numbers as nodes).
AT_ONCE = 1_000_000
#: Parts that the edges of a hot node are dealt to.
SALTS = 16
#: A node is hot with more than HOT_LEAST edges, and more than 2 / HOT_MOST of all: there are fewer than HOT_MOST.
HOT_LEAST, HOT_MOST = 256, 1000


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """``edges`` (u, v), of any type that has an order, to (node, root): the smallest node reachable.

    Nodes without an edge, and edges of a node to itself, give no row.
    """
    u, v = F.col("u"), F.col("v")
    both = edges.where(u != v).select(F.when(u > v, u).otherwise(v).alias("u"), F.when(u > v, v).otherwise(u).alias("v"))
    now, before = tables.put(both.distinct()), None
    if now.count() <= AT_ONCE:
        roots = tables.put(now.coalesce(1).mapInArrow(_joined, now.schema))
        tables.drop(now)
        return roots.select(u.alias("node"), v.alias("root"))
    while True:
        hashed = now.withColumn("x", F.xxhash64("u", "v").cast("decimal(20,0)"))
        degrees = hashed.unionByName(hashed.select(v.alias("u"), u.alias("v"), "x")).groupBy("u").agg(F.count("*").alias("n"), F.sum("x").alias("x"))
        *seen, most = degrees.agg(F.sum("n"), F.sum("x"), F.max("n")).first()
        if seen == before or not seen[0]:
            break
        before = seen
        least = max(HOT_LEAST, 2 * (seen[0] // 2) // HOT_MOST)
        # A node has no more smaller neighbours after the large star than before, so both steps share the hot nodes.
        hot = degrees.where(F.col("n") > least).select("u", F.lit(SALTS).alias("salts")) if most > least else None
        # Large star: every larger neighbour of a node is linked to the node's smallest.
        sides = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        large = _linked(sides.where(v > u), sides, hot).distinct()
        # Small star: every smaller neighbour, and the node itself, is linked to its smallest.
        smallest = large.groupBy("u").agg(F.min("v").alias("v"))
        small = _linked(large, large, hot).where(u != v)
        after = tables.put(small.unionByName(smallest).distinct())
        tables.drop(now)
        now = after
    return now.select(u.alias("node"), v.alias("root"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest reachable node) of all edges (u, v) at once, the smallest themselves left out."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    u, v = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(apart := np.flatnonzero(root[a] != root[b])):
        a, b = a[apart], b[apart]
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    for i in range(0, len(below), 100_000):
        part = below[i : i + 100_000]
        yield as_batch({"u": pa.array(nodes[part], held[0].schema[0].type), "v": pa.array(nodes[root[part]], held[0].schema[1].type)}, held[0].schema)


def _linked(pairs: DataFrame, among: DataFrame, hot: DataFrame | None) -> DataFrame:
    """For each pair (u, v): v linked to the smallest of u and its neighbours in ``among``."""
    least = among.groupBy("u").agg(F.min("v").alias("m")).select("u", F.when(F.col("m") < F.col("u"), F.col("m")).otherwise(F.col("u")).alias("m"))
    on = ["u"]
    if hot is not None:
        salts = F.coalesce("salts", F.lit(1))
        pairs = pairs.join(F.broadcast(hot), "u", "left").withColumn("salt", F.pmod(F.xxhash64("v"), salts).cast("int"))
        least = least.join(F.broadcast(hot), "u", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        on.append("salt")
    return pairs.join(least, on).select(F.col("v").alias("u"), F.col("m").alias("v"))
