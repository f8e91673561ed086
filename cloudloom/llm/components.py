"""Connected components of an edge table, in logarithmically many rounds of joins and minimum aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.tables import attach
from cloudloom.session import cut_lineage

ONE_TASK = 1 << 20  # edges


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); `root` is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends by doubling, and
    contracts the edges, which at least halves the nodes left. A hub is only ever met by a minimum, which
    combines before its shuffle, and by a join that adaptive execution splits. Once the edges left are at most ONE_TASK,
    one task finishes them. Loops and repeated edges do no harm.
    """
    edges = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    nodes = cut_lineage(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    while left := edges.limit(ONE_TASK + 1).count():
        if left <= ONE_TASK:
            last = edges.coalesce(1).mapInArrow(_finish, "node long, root long")
            return attach_root(nodes, cut_lineage(last))
        hooks = (
            edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"))
            .groupBy("e.x")
            .agg(F.min("e.y").alias("y"))
            .select("x", F.least("x", "y").alias("y"))
        )
        hooks = cut_lineage(hooks)
        while True:
            step = attach(hooks, hooks.select(F.col("x").alias("y"), F.col("y").alias("z")), ["y"])
            step = cut_lineage(step.select("x", F.col("z").alias("y"), (F.col("y") != F.col("z")).alias("moved")))
            hooks = step.select("x", "y")
            if step.filter("moved").isEmpty():
                break
        to = lambda c: hooks.select(F.col("x").alias(c), F.col("y").alias(f"{c}_new"))
        nodes = cut_lineage(attach_root(nodes, hooks.select(F.col("x").alias("node"), F.col("y").alias("root"))))
        edges = attach(attach(edges, to("a"), ["a"]), to("b"), ["b"])
        edges = cut_lineage(
            edges.select(F.least("a_new", "b_new").alias("a"), F.greatest("a_new", "b_new").alias("b")).filter("a <> b").distinct()
        )
    return nodes


def attach_root(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Replaces the root of each node by that root's own."""
    found = attach(nodes, roots.select(F.col("node").alias("root"), F.col("root").alias("new")), ["root"])
    return found.select("node", F.coalesce("new", "root").alias("root"))


def _finish(batches):
    """Components of a bounded edge table, as (node, root)."""
    parts = [(b.column("a").to_numpy(zero_copy_only=False), b.column("b").to_numpy(zero_copy_only=False)) for b in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts))
    names, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = labels(index[: len(a)], index[len(a) :], len(names))
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[label])], names=["node", "root"])


def labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Component label (the smallest index) of nodes 0..n-1 of a graph that fits one task."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            return label
        label = new
