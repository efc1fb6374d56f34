"""Connected components of an edge table: union-find inside tasks, large-star and small-star steps between them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Edges that a task joins at a time.
LOCAL = 500_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges ``(u, v)`` but the least of its component, and that least one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (root[root] != root).any():
            root = root[root]
    own = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[own], nodes[root[own]]


def joined_in_tasks(edges: DataFrame, count: int, local: int) -> DataFrame:
    """``u, v``: the forests of the edges of each task, at most ``local`` of them at a time. Edges that fit one task need no
    more steps."""
    tasks = count // (local + 1) + 1

    def run(batches):
        def joined():
            u, v = forest(*(np.concatenate([x[k] for x in held]) for k in range(2)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        held, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, local):
                part = batch.slice(i, local)
                if size + part.num_rows > local and size:
                    yield joined()
                    held, size = [], 0
                held.append([part.column(c).to_numpy() for c in ("u", "v")])
                size += part.num_rows
        if size:
            yield joined()

    dealt = edges.coalesce(1) if tasks == 1 else edges.repartition(tasks, "v")
    return dealt.mapInArrow(run, "u long, v long")


def _least(edges: DataFrame) -> DataFrame:
    """Each edge ``(u, v)`` with the least neighbour ``m`` of u or u itself. Least values are pre-aggregated before the
    shuffle, and the join back lets Spark split the rows of a node that very many edges share."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    return edges.join(least, edges.u == least.n).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = _least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return low.select("u", F.col("m").alias("v")).unionByName(low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, local: int = LOCAL) -> DataFrame:
    """``node, component`` for every node of an edge; a component's name is its least node. Nodes are longs.

    Each round joins the edges of each task by union-find and then steps once over all; it is written to the shared
    checkpoint folder, so its lineage stays short. Self-loops, repeated edges and edges with a null end are left out;
    without edges the result is empty.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now, before = saved(now, "edges"), None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        done = state[0] <= local or state == before
        if state[0] and state != before:
            forests = joined_in_tasks(now, state[0], local)
            now = saved(forests if done else _small_star(_large_star(saved(forests.distinct(), "forests")).distinct()).distinct(), "stars")
        if done:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
