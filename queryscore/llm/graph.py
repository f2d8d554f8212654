"""Connected components of a graph of long-valued nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryscore.llm.scratch import Tables, kept


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Each round hooks every root to the smallest root next to it and contracts the edges to those
    between different roots, at least halving the roots that have any. Rows per node are only
    aggregated to a minimum or joined to one, so a node with many neighbours is spread like any hot
    join key. Each round is written, so a lost executor repeats one step. A node that hooked to a root
    which hooked on by itself is left behind it; such paths are halved at the end until none is left.
    """
    own = Tables(edges.sparkSession)
    edges = own.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def lowest(e: DataFrame) -> DataFrame:
        both = e.union(e.select("b", "a"))
        return both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))

    def then(old: DataFrame, new: DataFrame, purpose: str) -> DataFrame:
        new = own.keep(new, purpose)
        own.free(old)
        return new

    roots = own.keep(lowest(edges).select(F.col("a").alias("node"), F.col("low").alias("root")), "roots")
    while True:
        of = lambda side, name: roots.select(F.col("node").alias(side), F.col("root").alias(name))
        across = edges.join(of("a", "x"), "a").join(of("b", "y"), "b").where("x <> y")
        edges = then(edges, across.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            break
        low = lowest(edges).withColumnRenamed("a", "root")
        roots = then(roots, roots.join(low, "root", "left").select("node", F.coalesce("low", "root").alias("root")), "roots")
    while True:
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        higher = roots.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved"))
        roots = then(roots, higher, "roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.select("node", "root")
    found = kept(roots.select("node", "root"), "components")
    own.free()
    return found
