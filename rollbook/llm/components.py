"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import settle


def local_forest(a, b):
    """For links (a[i], b[i]) of one block: (node, smallest node of its component), without roots.

    Any number of links shrink to fewer rows than there are nodes, so no block emits all its pairs.
    """
    import numpy as np

    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links`` (a, b: long, no nulls).

    Each round points every root to its smallest neighbouring root, shortens the pointers by doubling until
    they end in roots, and renames the links by their roots; what is then no link between two roots goes.
    Rounds end when no link is left. Every step reads written tables, and minima combine before the
    shuffle, so that a node with very many links is split like any skewed join key.
    """
    links = settle(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a <> b")
        .distinct(),
        "links",
    )
    both = links.select(F.col("a").alias("node")).union(links.select("b"))
    parent = settle(both.distinct().select("node", F.col("node").alias("component")), "parents")
    while not links.isEmpty():
        hooks = links.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("to"))
        hooks = settle(hooks, "hooks")
        while True:
            step = hooks.select(F.col("root").alias("to"), F.col("to").alias("next"))
            far = hooks.join(step, "to", "left").select(
                "root", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")
            )
            far = settle(far, "hooks")
            hooks = far.select("root", "to")
            if far.where("moved").isEmpty():
                break
        parent = settle(_renamed(parent, hooks, "component"), "parents")
        links = _renamed(settle(_renamed(links, hooks, "a"), "links"), hooks, "b")
        links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = settle(links.where("a <> b").distinct(), "links")
    return parent


def _renamed(df: DataFrame, hooks: DataFrame, column: str) -> DataFrame:
    to = hooks.select(F.col("root").alias(column), "to")
    kept = [F.coalesce("to", column).alias(column) if c == column else F.col(c) for c in df.columns]
    return df.join(to, column, "left").select(*kept)
