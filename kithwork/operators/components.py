"""Connected components of an edge table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithwork.functions.storage import discard, stored


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; a component is named by its least node.

    A round hooks every node to the least of itself and its neighbours, follows the hooks to their roots by pointer
    jumping, and replaces the edges by those between roots. A root that nobody hooked to has a neighbour with a lesser
    root and hooks to it in the next round, so two rounds at least halve the nodes that have edges: rounds grow with the
    logarithm of the nodes at any diameter, and the tables shrink. Whether a label or an edge is left is the only thing
    that reaches the driver. Tables are written to the shared folder, so lineage stays short. A hub's messages are
    combined before the shuffle (min is a partial aggregate).
    """
    some = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    both = stored(some.unionByName(some.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not rounds or not both.isEmpty():
        roots = _roots(stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels"))
        rounds.append(roots)
        further = both.join(roots, "a").select("b", F.col("label").alias("c")).join(roots.select(F.col("a").alias("b"), "label"), "b")
        further = stored(further.filter("c <> label").select(F.col("c").alias("a"), F.col("label").alias("b")).distinct(), "edges")
        discard(both)
        both = further
    discard(both)
    # a node's root of one round is a node of the next round, or has no edges left
    found = rounds.pop()
    while rounds:
        earlier = rounds.pop()
        names = found.select(F.col("a").alias("label"), F.col("label").alias("further"))
        joined = stored(earlier.join(names, "label", "left").select("a", F.coalesce("further", "label").alias("label")), "labels")
        discard(earlier, found)
        found = joined
    return found.select(F.col("a").alias("node"), F.col("label").alias("component"))


def _roots(labels: DataFrame) -> DataFrame:
    """``labels`` (a, label), whose labels are nodes and never greater than a, with each label replaced by its chain's end."""
    while True:
        names = labels.select(F.col("a").alias("label"), F.col("label").alias("further"))
        jumped = stored(labels.join(names, "label").select("a", F.col("label").alias("old"), F.col("further").alias("label")), "labels")
        discard(labels)
        if jumped.filter("label <> old").isEmpty():
            out = jumped.select("a", "label")
            out._stored_path = jumped._stored_path
            return out
        labels = jumped.select("a", "label")
        labels._stored_path = jumped._stored_path
