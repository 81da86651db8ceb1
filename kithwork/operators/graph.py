"""Distances and neighbourhoods: the packed-bit kernel for graphs that fit a broadcast, a DataFrame frontier for all others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithwork.functions.storage import stored
from kithwork.operators import kernel

#: Levels after which a frontier gives up.
MAX_LEVELS = 10_000
#: Rows of a level, or of pairs that meet, that a task makes and holds at once, about.
TASK_ROWS = 500_000


def _parts(rows: int | None) -> int:
    """Tasks for ``rows`` rows that a join makes. A number that is given stays: the rows joined are few, so they would be put together."""
    return max(1, -(-(rows or 0) // TASK_ROWS))


def fits_kernel(edges: DataFrame) -> bool:
    """Whether ``edges`` may be broadcast; reads one row more than the bound at most."""
    return edges.select("src").limit(kernel.MAX_PLAIN + 1).count() <= kernel.MAX_PLAIN


def frontier(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, node, dist) by joins, a level at a time; each level is written to the shared folder.

    A level joins the last frontier with the edges, drops what was reached before and keeps each pair once.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    degree = stored(edges.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "degrees")
    level = stored(sources.select("src").distinct().select("src", F.col("src").alias("node"), F.lit(0).cast("long").alias("dist")), "level")
    n_edges, reached, d = degree.agg(F.sum("n")).first()[0], [level], 0
    while max_depth is None or d < max_depth:
        d += 1
        if d > MAX_LEVELS:
            raise RuntimeError(f"more than {MAX_LEVELS} levels")
        parts = _parts(level.join(degree, "node").agg(F.sum("n")).first()[0])
        if parts > 1:
            parts = max(parts, _parts(n_edges))
            step = level.repartition(parts, "node").join(edges.repartition(parts, "node"), "node").select("src", F.col("next").alias("node"))
            step = step.repartition(parts, "src", "node").distinct()
        else:
            step = level.join(edges, "node").select("src", F.col("next").alias("node")).distinct()
        # edges have both directions, so what was reached lies one or two levels back
        for old in reached[-2:]:
            step = step.join(old.select("src", "node"), ["src", "node"], "left_anti")
        level = stored(step.withColumn("dist", F.lit(d).cast("long")), "level")
        if not level.limit(1).count():
            break
        reached.append(level)
    out = spark.createDataFrame([], "src long, node long, dist long")
    for level in reached:
        out = out.unionByName(level)
    return out


def distances(edges: DataFrame, sources: DataFrame, max_depth: int | None = None, method: str = "auto") -> DataFrame:
    """(src, node, dist) from ``sources`` (src) over symmetric ``edges`` (src, dst)."""
    if method == "kernel" or method == "auto" and fits_kernel(edges):
        return kernel.distances(edges, sources, max_depth)
    return frontier(edges, sources, max_depth)


class Hops:
    """Hops between given pairs over one graph of symmetric ``edges`` (src, dst, weight), asked for as often as need be."""

    def __init__(self, edges: DataFrame, method: str = "auto"):
        self.shared = kernel.load(edges) if method != "frontier" else None
        if self.shared is None:
            if method == "kernel":
                raise ValueError(f"more than {kernel.MAX_EDGES} edges: use the frontier")
            self.edges = stored(edges.select("src", "dst", "weight"), "weighted")

    def between(self, asked: DataFrame) -> DataFrame:
        """``asked`` (src, dst, least, depth) -> (src, dst, least, dist) where dst is within ``depth`` hops (null: any) over edges of a weight above ``least``."""
        return kernel.hops(self.shared, asked) if self.shared is not None else self._by_levels(asked)

    def _by_levels(self, asked: DataFrame) -> DataFrame:
        """A level at a time; sources whose goals are all met, or too far off, go no further."""
        left = stored(asked.select(*(F.col(c).cast("long") for c in ("src", "dst", "least", "depth"))).distinct(), "asked")
        found = left.filter("src = dst").select("src", "dst", "least", F.lit(0).cast("long").alias("dist"))
        left = left.filter("src <> dst")
        level = stored(left.select("least", "src", F.col("src").alias("node")).distinct(), "level")
        levels, d = [level], 0
        steps = self.edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), "weight")
        while True:
            d += 1
            if d > MAX_LEVELS:
                raise RuntimeError(f"more than {MAX_LEVELS} levels")
            left = left.filter(F.col("depth").isNull() | (F.col("depth") >= d))
            active = left.select("least", "src").distinct()
            step = level.join(active, ["least", "src"], "left_semi").join(steps, "node").filter("weight > least").select("least", "src", F.col("next").alias("node")).distinct()
            for old in levels[-2:]:
                step = step.join(old, ["least", "src", "node"], "left_anti")
            level = stored(step, "level")
            if level.isEmpty():
                break
            levels.append(level)
            met = stored(left.join(level.withColumnRenamed("node", "dst"), ["least", "src", "dst"], "left_semi").select("src", "dst", "least", F.lit(d).cast("long").alias("dist")), "met")
            found = found.unionByName(met)
            left = stored(left.join(met, ["src", "dst", "least"], "left_anti"), "asked")
        return found


def neighbors_1hop(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, node) next to each of ``sources`` (src)."""
    return edges.join(sources.select("src").distinct(), "src", "left_semi").select("src", F.col("dst").alias("node")).distinct()


def neighbors_2hop(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, node) at exactly two hops: neither the source nor next to it."""
    near = neighbors_1hop(edges, sources)
    far = near.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")), "node").select("src", F.col("next").alias("node"))
    return far.filter("src <> node").distinct().join(near, ["src", "node"], "left_anti")


def pairs_within(edges: DataFrame, persons: DataFrame, h: int, method: str = "auto") -> DataFrame:
    """(p1, p2), p1 < p2, of ``persons`` (person_id) at most ``h`` hops apart in the whole graph."""
    return pair_distances(edges, persons, h, method).select("p1", "p2")


def pair_distances(edges: DataFrame, persons: DataFrame, h: int, method: str = "auto") -> DataFrame:
    """(p1, p2, dist), p1 < p2, of ``persons`` (person_id) at most ``h`` hops apart in the whole graph.

    For large graphs by meeting in the middle: balls of half the radius around either person share a vertex. The pairs
    that meet are counted first, so that a task makes and holds about TASK_ROWS of them however many there are.
    """
    people = persons.select(F.col("person_id").alias("src")).distinct()
    if h <= 0:
        return people.select(F.col("src").alias("p1"), F.col("src").alias("p2"), F.lit(0).cast("long").alias("dist")).filter("p1 < p2")
    if method == "kernel" or method == "auto" and fits_kernel(edges):
        return kernel.distances(edges, people, h, keep="pairs").select(F.col("src").alias("p1"), F.col("node").alias("p2"), "dist")
    # a way from p1 to p2 goes through a vertex at half the radius of p1, or p2 itself: both orders need not be tried
    outer = frontier(edges, people, (h + 1) // 2)
    first = outer.select(F.col("src").alias("p1"), "node", F.col("dist").alias("d1"))
    second = outer.filter(F.col("dist") <= h // 2).select(F.col("src").alias("p2"), "node", F.col("dist").alias("d2"))
    count = lambda rows, n: rows.groupBy("node").agg(F.count(F.lit(1)).alias(n))
    parts = _parts(count(first, "n1").join(count(second, "n2"), "node", "left").agg(F.sum(F.col("n1") * (F.coalesce("n2", F.lit(0)) + 1))).first()[0])
    met = first.repartition(parts, "node").join(second.repartition(parts, "node"), "node").filter("p1 < p2")
    return met.select("p1", "p2", (F.col("d1") + F.col("d2")).alias("dist")).repartition(parts, "p1", "p2").groupBy("p1", "p2").agg(F.min("dist").alias("dist"))


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends in ``members`` (person_id)."""
    own = members.select("person_id").distinct()
    return edges.join(own.select(F.col("person_id").alias("src")), "src", "left_semi").join(own.select(F.col("person_id").alias("dst")), "dst", "left_semi").select("src", "dst")


def sampled(members: DataFrame, share: float, seed: int) -> DataFrame:
    """(src): members chosen by a multiplicative hash of id and seed, the same on every run and in any SQL."""
    unit = F.pmod(F.pmod("person_id", F.lit(1 << 16)) * 40503 + F.lit(seed * 9973), F.lit(1 << 16)) / float(1 << 16)
    return members.filter(unit < share).select(F.col("person_id").alias("src"))
