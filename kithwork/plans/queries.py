"""The four query families. Parameters are tables, so a batch of queries is one plan."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithwork.functions.storage import stored
from kithwork.operators import closeness, graph, kernel, people, tag_communities
from kithwork.sources.tables import Network


def shortest_paths(params: DataFrame, edges: DataFrame, method: str = "auto") -> DataFrame:
    """``params`` (qid, p1, p2, x), weighted ``edges`` -> (qid, p1, p2, x, dist).

    Hops over edges of a weight above x (all if x is negative), -1 if there is no way, 0 from a person to themselves.
    All thresholds are searched in one job, each from its lesser persons to the asked ones only.
    """
    if params.isEmpty():
        return params.select("qid", "p1", "p2", "x", F.lit(0).cast("long").alias("dist"))
    asked = params.select("qid", "p1", "p2", "x", F.least("p1", "p2").alias("src"), F.greatest("p1", "p2").alias("dst"), F.greatest("x", F.lit(-1)).cast("long").alias("least"))
    goals = asked.filter("src <> dst").select("src", "dst", "least", F.lit(None).cast("long").alias("depth")).distinct()
    found = graph.Hops(edges, method).between(goals)
    rows = asked.join(found, ["src", "dst", "least"], "left")
    return rows.select("qid", "p1", "p2", "x", F.when(F.col("p1") == F.col("p2"), F.lit(0)).otherwise(F.coalesce("dist", F.lit(-1))).cast("long").alias("dist"))


def top_tags(params: DataFrame, net: Network) -> DataFrame:
    """``params`` (qid, k, d) -> (qid, rank, tag, size)."""
    interest, person = stored(net.interest, "interest"), stored(net.person, "person")
    edges = stored(tag_communities.tag_edges(net.knows, interest, person), "tag-edges")
    sizes = tag_communities.sizes_at(edges, interest, person, params)
    return tag_communities.top_tags(params, sizes, net.tag)


class _PairSearch:
    """Best pairs of several places and numbers of hops over one network.

    Candidates come in descending order of common tags. A person with n tags who shares t of them with another shares
    one of their n - t + 1 rarest, so a pass for t joins only those (a popular tag joins late, or never), and only among
    persons with t tags or more. Passes halve t; the pairs of a pass are tried for nearness a level of common tags at a
    time. Once k pairs of the levels done are near enough, no later one can be better.
    """

    def __init__(self, net: Network, names: DataFrame, asked: list[tuple[str, int, int]], method: str):
        self.asked, self.method = asked, method
        persons = people.in_place(net, names)
        interest = net.interest.join(persons.select("person_id").distinct(), "person_id", "left_semi")
        rare = interest.groupBy("tag_id").agg(F.count(F.lit(1)).alias("n"))
        tags = interest.join(rare, "tag_id").groupBy("person_id").agg(F.sort_array(F.collect_set(F.struct("n", "tag_id"))).alias("tags"))
        tags = tags.select("person_id", F.col("tags.tag_id").alias("tags"))
        none = F.array().cast("array<bigint>")
        self.persons = stored(persons.join(tags, "person_id", "left").select("name", "person_id", F.coalesce("tags", none).alias("tags")), "in-place")
        self.knows = net.knows
        self.hops: graph.Hops | None = None
        self.found: dict[tuple[str, int], list[DataFrame]] = {(place, h): [] for place, h, _ in asked}

    def candidates(self, least: int, below: int | None) -> DataFrame:
        """(name, p1, p2, common) of pairs with ``least`` common tags or more, fewer than ``below``."""
        own = self.persons.filter(F.size("tags") >= least).withColumn("rare", F.slice("tags", 1, F.size("tags") - (least - 1)))
        side = lambda p, t, r: own.select("name", F.explode("rare").alias("tag"), F.col("person_id").alias(p), F.col("tags").alias(t), F.col("rare").alias(r))
        both = side("p1", "t1", "r1").join(side("p2", "t2", "r2"), ["name", "tag"]).filter("p1 < p2")
        # a pair comes once for each rare tag in common: only the first counts
        both = both.filter(F.element_at(F.array_intersect("r1", "r2"), 1) == F.col("tag"))
        both = both.select("name", "p1", "p2", F.size(F.array_intersect("t1", "t2")).cast("long").alias("common"))
        both = both.filter(F.col("common") >= least)
        return both if below is None else both.filter(F.col("common") < below)

    def next_to(self, places: list[str]) -> DataFrame:
        """(name, p1, p2, common) of pairs who know each other."""
        own = self.persons.filter(F.col("name").isin(places))
        side = lambda p, k, t: own.select("name", F.col("person_id").alias(p), F.col("tags").alias(t)).withColumnRenamed(p, k)
        pairs = self.knows.filter("src < dst").join(side("p1", "src", "t1"), "src").join(side("p2", "dst", "t2"), ["name", "dst"])
        return pairs.select("name", F.col("src").alias("p1"), F.col("dst").alias("p2"), F.size(F.array_intersect("t1", "t2")).cast("long").alias("common"))

    def levels(self, pairs: DataFrame, open_: list[tuple[str, int, int]], have: dict) -> None:
        """Try ``pairs`` of one pass for all ``open_`` searches at once, most common tags first."""
        counted = pairs.groupBy("name", "common").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a place and number of tags
        steps = {(place, h): sorted(((r["common"], r["n"]) for r in counted if r["name"] == place), reverse=True) for place, h, _ in open_}
        while True:
            asked = None
            for place, h, k in open_:
                todo, pending, high, low = steps[place, h], 0, None, None
                while todo and have[place, h] < k and pending < 4 * k:
                    low, n = todo.pop(0)
                    high, pending = low if high is None else high, pending + n
                if high is not None:
                    part = pairs.filter((F.col("name") == place) & F.col("common").between(low, high)).withColumn("h", F.lit(h).cast("long"))
                    asked = part if asked is None else asked.unionByName(part)
            if asked is None:
                return
            goals = asked.select(F.col("p1").alias("src"), F.col("p2").alias("dst"), F.lit(-1).cast("long").alias("least"), F.col("h").alias("depth")).distinct()
            if self.hops is None:
                self.hops = graph.Hops(self.knows.withColumn("weight", F.lit(0).cast("long")), self.method)
            met = self.hops.between(goals).select(F.col("src").alias("p1"), F.col("dst").alias("p2"), F.col("dist"))
            near = asked.join(met.groupBy("p1", "p2").agg(F.min("dist").alias("dist")), ["p1", "p2"]).filter("dist <= h")
            near = stored(near.select("name", "h", "p1", "p2", "common"), "near")
            for r in near.groupBy("name", "h").agg(F.count(F.lit(1)).alias("n")).collect():
                have[r["name"], r["h"]] += r["n"]
            for place, h, _ in open_:
                self.found[place, h].append(near.filter((F.col("name") == place) & (F.col("h") == h)))

    def run(self) -> DataFrame | None:
        """(place, h, p1, p2, common): at least the k best pairs of each search, if there are so many."""
        out = None
        for place in {p for p, h, _ in self.asked if h == 1}:
            self.found[place, 1].append(self.next_to([place]).withColumn("h", F.lit(1).cast("long")))
        open_ = [x for x in self.asked if x[1] > 1]
        have = {(place, h): 0 for place, h, _ in open_}
        if open_:
            held = self.persons.groupBy("name", F.size("tags").alias("n")).agg(F.count(F.lit(1)).alias("persons")).collect()
            ns: dict[str, list[int]] = {}
            for r in sorted(held, key=lambda r: -r["n"]):
                ns.setdefault(r["name"], []).extend([r["n"]] * min(r["persons"], 8 * max(k for _, _, k in open_)))
            open_ = [x for x in open_ if len(ns.get(x[0], ())) > 1]
            # the first pass is for the t that some persons of each place have
            least, below = min((max(1, ns[place][min(len(ns[place]), 8 * k) - 1]) for place, _, k in open_), default=1), None
            passes = []
            while open_:
                pairs = stored(self.candidates(least, below).filter(F.col("name").isin([p for p, _, _ in open_])), "candidates")
                passes.append(pairs)
                self.levels(pairs, open_, have)
                open_ = [x for x in open_ if have[x[:2]] < x[2]]
                if least == 1:
                    break
                least, below = max(1, least // 2), least
            for place, h, k in open_:
                # those without a common tag rank by their ids alone
                own = self.persons.filter(F.col("name") == place).select("person_id")
                rest = graph.pairs_within(self.knows, own, h, self.method)
                for pairs in passes:
                    rest = rest.join(pairs.filter(F.col("name") == place).select("p1", "p2"), ["p1", "p2"], "left_anti")
                rest = rest.orderBy("p1", "p2").limit(k)
                self.found[place, h].append(rest.select(F.lit(place).alias("name"), F.lit(h).cast("long").alias("h"), "p1", "p2", F.lit(0).cast("long").alias("common")))
        for parts in self.found.values():
            for part in parts:
                part = part.select(F.col("name").alias("place"), "h", "p1", "p2", "common")
                out = part if out is None else out.unionByName(part)
        return out


def top_pairs(params: DataFrame, net: Network, method: str = "auto") -> DataFrame:
    """``params`` (qid, k, h, place) -> (qid, rank, p1, p2, common): pairs of a place within h hops, most common tags first."""
    asked = sorted(tuple(r) for r in params.filter("h > 0").groupBy("place", "h").agg(F.max("k")).collect())  # places of a query file
    if method == "frontier" or asked:
        net = replace(net, knows=stored(net.knows, "knows"))
    pairs = _PairSearch(net, params.select(F.col("place").alias("name")), asked, method).run() if asked else None
    if pairs is None:
        return params.selectExpr("qid", "k AS rank", "h AS p1", "h AS p2", "h AS common").limit(0)
    order = Window.partitionBy("qid").orderBy(F.col("common").desc(), "p1", "p2")
    rows = pairs.join(F.broadcast(params.select("qid", "k", "h", "place")), ["h", "place"])
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= F.col("k")).select("qid", "rank", "p1", "p2", "common")


def top_central(params: DataFrame, net: Network, method: str = "auto") -> DataFrame:
    """``params`` (qid, k, tag) -> (qid, rank, person_id, r, s, centrality).

    The communities of all tags are one table of edges by tag. As many as fit the kernel together go in one round of
    jobs; those that do not fit it alone are evaluated by joins. Either way members are taken in descending order of a
    bound until no one left can be among the best.
    """
    asked = [tuple(r) for r in params.filter("tag IS NOT NULL").groupBy("tag").agg(F.max("k")).collect()]  # tags of a query file
    if not asked:
        return params.selectExpr("qid", "k AS rank", "k AS person_id", "k AS r", "k AS s", "CAST(k AS double) AS centrality").limit(0)
    members = stored(people.tag_members(net, params.select(F.col("tag").alias("name"))), "members")
    ends = lambda c: members.withColumnRenamed("person_id", c)
    inside = stored(net.knows.join(ends("src"), "src").join(ends("dst"), ["name", "dst"]).select("name", "src", "dst"), "communities")
    count = lambda rows: {r["name"]: r["count"] for r in rows.groupBy("name").count().collect()}  # noqa: E731 one row a tag
    sizes, edges = count(members), count(inside)
    together: list[list[str]] = []
    found, room = None, 0
    for name, k in sorted(asked):
        n = edges.get(name, 0)
        if name not in sizes:
            continue
        if method == "frontier" or n > kernel.MAX_PLAIN:
            own = members.filter(F.col("name") == name).select("person_id")
            part = closeness.top_k(inside.filter(F.col("name") == name).select("src", "dst"), own, k, method="frontier").withColumn("name", F.lit(name))
            found = part if found is None else found.unionByName(part)
        elif together and n <= room:
            together[-1].append(name)
            room -= n
        else:
            together.append([name])
            room = kernel.MAX_PLAIN - n
    for names in together:
        own = F.col("name").isin(names)
        part = closeness.top_k_by_name(inside.filter(own), members.filter(own), {name: (k, sizes[name]) for name, k in asked if name in names})
        found = part if found is None else found.unionByName(part)
    if found is None:
        return params.selectExpr("qid", "k AS rank", "k AS person_id", "k AS r", "k AS s", "CAST(k AS double) AS centrality").limit(0)
    found = found.withColumnRenamed("name", "tag")
    order = Window.partitionBy("qid").orderBy(F.col("centrality").desc(), "person_id")
    rows = found.join(F.broadcast(params.select("qid", "k", "tag")), "tag")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= F.col("k")).select("qid", "rank", "person_id", "r", "s", "centrality")
