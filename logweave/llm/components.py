"""Connected components of a graph of links: contraction in each task, then alternating large and small stars."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

ROWS = 1 << 19  # of a graph's table in a task, about


def contract(batches):
    """The links (u, v) of a partition as stars: each node with the smallest one that they join it to."""
    root = {}

    def find(x):
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = np.array([x for x in root if find(x) != x], np.int64)
    tops = np.array([root[x] for x in nodes.tolist()], np.int64)
    for i in range(0, len(nodes), 10_000):
        yield pa.RecordBatch.from_pydict({"u": pa.array(nodes[i : i + 10_000]), "v": pa.array(tops[i : i + 10_000])})


def state(edges):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (u, v) but those linked only to themselves; a component's name is its
    smallest node.

    Each task first contracts the links that it holds.  Stars: each node's larger neighbours are linked to its smallest
    neighbour, then each node's smaller neighbours.  The number of turns grows with the logarithm of the longest path.
    The smallest neighbours are written to the checkpoint folder before they meet the edges, so that both sides of the
    join are dealt out and Spark may split a hub's rows.
    """
    # a turn runs several small jobs: the tables lie in as many parts as their rows need, or the driver drowns in tasks
    parts = links.count() // ROWS + 1
    edges = checkpointed(links.select("u", "v").coalesce(parts).mapInArrow(contract, "u long, v long"))
    if parts == 1:  # one task has held all links: its stars are the components
        return named_roots(edges)
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts))
        large = checkpointed(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(parts))
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
        after = state(edges)
        if after == before:
            break
        before = after
    return named_roots(edges)


def named_roots(edges):
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def renamed(known: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) of a graph after further links: only the names that they join are worked out."""
    of = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    named = links.join(of("u"), "u", "left").join(of("v"), "v", "left")
    moved = checkpointed(components(checkpointed(named.select(F.coalesce("of_u", "u").alias("u"), F.coalesce("of_v", "v").alias("v")))))
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = known.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return checkpointed(old.unionByName(moved.join(known, "node", "left_anti")))
