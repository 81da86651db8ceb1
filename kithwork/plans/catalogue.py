"""Registered queries: one for each operator, over the networks that projection.py derives."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithwork.functions.storage import run_folder, stored
from kithwork.operators import closeness, graph, pairs, people, tag_communities, weights
from kithwork.operators.components import components
from kithwork.plans import batch, formats
from kithwork.plans import queries as plans
from kithwork.sources import delimited, projection, query_file

# The parameters of the registered queries; oracle.py has the same.
PATHS = [(1, 2), (1, 9), (3, 14), (5, 8), (2, 13), (7, 7), (4, 11), (6, 10), (12, 1), (0, 3), (9, 5), (8, 999999), (999999, 999999)]
THRESHOLDS = [-1, 0, 1]
TOP_TAGS = [(8, "1995-01-01"), (8, "2001-01-01"), (3, "1992-01-01")]
ZERO_TAGS = [(40, "2001-06-01"), (100, "2030-01-01")]
TOP_PAIRS = [(5, 1, "ASIA"), (5, 2, "ASIA"), (5, 3, "ASIA"), (4, 2, "NATION_3"), (2, 2, "ATLANTIS"), (3, 0, "NATION_3")]
TOP_CENTRAL = [(5, "Brand#5"), (5, "Brand#4"), (3, "Brand#25"), (3, "Brand#0")]
BRANDS = ["Brand#4", "Brand#5"]
COMMUNITY = "Brand#25"
PLACE = "NATION_3"
SOURCES = [1, 2, 5]
DAY = "2001-01-01"
NAME = "red rod"
SHARE, SEED = 0.5, 7


class Context:
    """The networks of one call, each read once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def net(self):
        return projection.load(self.spark, self.sf_dir)

    @cached_property
    def users(self):
        return projection.user_network(self.spark, self.sf_dir)

    @cached_property
    def pairs(self) -> DataFrame:
        creator, reply, _ = self.users
        return weights.reply_pairs(reply, creator)

    @cached_property
    def weight(self) -> DataFrame:
        creator, reply, knows = self.users
        return weights.weighted(knows, reply, creator)

    def rows(self, values: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(values, schema)

    def names(self, *values: str) -> DataFrame:
        return self.rows([(v,) for v in values], "name string")

    @cached_property
    def sources(self) -> DataFrame:
        return self.rows([(s,) for s in SOURCES], "src bigint")

    @cached_property
    def members(self) -> DataFrame:
        return stored(people.tag_members(self.net, self.names(COMMUNITY)).select("person_id"), "members")

    @cached_property
    def community(self) -> DataFrame:
        return stored(graph.induced(self.net.knows, self.members), "community")

    @cached_property
    def tag_edges(self) -> DataFrame:
        return tag_communities.tag_edges(self.net.knows, self.net.interest, self.net.person)

    def path_params(self) -> DataFrame:
        values = [(i, a, b, x) for i, (a, b, x) in enumerate((a, b, x) for x in THRESHOLDS for a, b in PATHS)]
        return self.rows(values, "qid bigint, p1 bigint, p2 bigint, x bigint")

    def tag_params(self, values: list[tuple] = TOP_TAGS) -> DataFrame:
        return self.rows([(i, *v) for i, v in enumerate(values)], "qid bigint, k bigint, d string").withColumn("d", F.to_date("d"))

    def pair_params(self) -> DataFrame:
        return self.rows([(i, *v) for i, v in enumerate(TOP_PAIRS)], "qid bigint, k bigint, h bigint, place string")

    def central_params(self) -> DataFrame:
        return self.rows([(i, *v) for i, v in enumerate(TOP_CENTRAL)], "qid bigint, k bigint, tag string")

    @cached_property
    def knows(self) -> DataFrame:
        return stored(self.net.knows, "knows")

    @cached_property
    def place_persons(self) -> DataFrame:
        return stored(people.in_place(self.net, self.names(PLACE)).select("person_id"), "in-place")


def query_lines() -> list[str]:
    """The parameters above as a query file, the types mixed."""
    one = [f"query1({a}, {b}, {x})" for x in THRESHOLDS for a, b in PATHS]
    two = [f"query2({k}, {d})" for k, d in TOP_TAGS]
    three = [f"query3({k}, {h}, {p})" for k, h, p in TOP_PAIRS]
    four = [f"query4({k}, {t})" for k, t in TOP_CENTRAL]
    out = []
    for i in range(max(map(len, (one, two, three, four)))):
        out += [rows[i] for rows in (four, one, three, two) if i < len(rows)]
    return out


def _parsed(c: Context) -> dict[int, DataFrame]:
    return query_file.parse_lines(c.rows(list(enumerate(query_lines())), "line_no int, value string"))


def _parse_queries(c: Context) -> DataFrame:
    out = None
    for kind, rows in _parsed(c).items():
        args = F.concat_ws(",", *(F.col(n).cast("string") for n, _ in query_file.PARAMETERS[kind]))
        part = rows.select(F.lit(kind).cast("long").alias("type"), F.col("qid").cast("long").alias("qid"), args.alias("args"))
        out = part if out is None else out.unionByName(part)
    return out


def _pairs_within(edges: DataFrame, persons: DataFrame) -> DataFrame:
    """Pairs at most 1, 2 and 3 hops apart: a pair that is nearer is in all that follow."""
    near = graph.pair_distances(edges, persons, 3)
    return near.select(F.explode(F.sequence("dist", F.lit(3).cast("long"))).alias("h"), "p1", "p2")


def _pairs_within_sparse(c: Context) -> DataFrame:
    """Most persons of the place have no part in this graph."""
    return _pairs_within(stored(weights.above(c.weight, 0), "sparse"), c.place_persons)


def _from_files(c: Context) -> DataFrame:
    """The same batch, with the network written to ``|``-separated files and read again."""
    folder = f"{run_folder(c.spark)}/network-{uuid.uuid4().hex}"
    delimited.save(c.net, folder)
    return batch.answer(delimited.load(c.spark, folder), _parsed(c), c.users[2])


def _hops(c: Context, depth: int) -> DataFrame:
    return graph.distances(c.knows, c.sources, depth).select("src", F.col("node").alias("person_id"), "dist")


def _histogram(c: Context) -> DataFrame:
    return closeness.distance_histogram(c.community, c.members).select("person_id", "dist", "n")


def _common_by_arrays(c: Context) -> DataFrame:
    tags = people.tag_sets(c.net.interest)
    first, second = tags.selectExpr("person_id AS p1", "tags AS t1"), tags.selectExpr("person_id AS p2", "tags AS t2")
    joined = c.net.knows.filter("src < dst").selectExpr("src AS p1", "dst AS p2").join(first, "p1", "left").join(second, "p2", "left")
    return joined.select("p1", "p2", F.coalesce(F.size(F.array_intersect("t1", "t2")), F.lit(0)).cast("long").alias("common"))


def _approximate(c: Context) -> DataFrame:
    return closeness.approximate_sums(c.community, c.members, SHARE, SEED)


OPERATORS: dict[str, Callable[[Context], DataFrame]] = {
    # scans
    "scan_person": lambda c: c.net.person,
    "scan_knows": lambda c: c.net.knows,
    "scan_comment_creator": lambda c: c.users[0],
    "scan_reply": lambda c: c.users[1],
    "scan_tag": lambda c: c.net.tag,
    "scan_interest": lambda c: c.net.interest,
    "scan_place": lambda c: c.net.place,
    "scan_place_part_of": lambda c: c.net.place_part_of,
    "scan_located_in": lambda c: c.net.located_in,
    "scan_org_place": lambda c: c.net.org_place,
    "scan_study_work": lambda c: c.net.study_work,
    "scan_forum_tag": lambda c: c.net.forum_tag,
    "scan_forum_member": lambda c: c.net.forum_member,
    "reply_point_lookup": lambda c: c.users[1].filter("comment_id = 500"),
    # filters
    "edge_weight_threshold": lambda c: weights.above(c.weight, 0),
    "persons_born_since": lambda c: people.born_since(c.net.person, DAY),
    "persons_with_tag": lambda c: people.with_tag(c.net.interest, c.net.tag, NAME),
    "place_by_name": lambda c: people.place_by_name(c.net.place, PLACE),
    "canonical_pairs": lambda c: c.net.knows.select(F.least("src", "dst").alias("p1"), F.greatest("src", "dst").alias("p2")).distinct(),
    "encode_birthday": lambda c: people.encode_birthday(c.net.person),
    "dense_relabel": lambda c: people.dense_relabel(c.net.person, "person_id"),
    "forum_tag_filtered": lambda c: people.forum_tags_named(c.net, c.names(*BRANDS)),
    "forum_member_filtered": lambda c: people.members_of_tagged_forums(c.net, c.names(*BRANDS)),
    # joins
    "reply_pairs": lambda c: c.pairs,
    "reply_between_friends": lambda c: weights.between_friends(c.pairs, c.users[2]),
    "knows_weight": lambda c: c.weight,
    "tag_induced_edges": lambda c: c.tag_edges,
    "tag_forum_members": lambda c: people.tag_members(c.net, c.names(*BRANDS)),
    "person_org_place": lambda c: people.org_places(c.net),
    "persons_in_place": lambda c: people.in_place(c.net, c.names("ASIA", PLACE)),
    "induced_subgraph": lambda c: c.community,
    "common_tag_pairs": lambda c: pairs.common_tags(c.net.interest),
    "common_tag_count_arrays": _common_by_arrays,
    "place_pairs_theta": lambda c: pairs.all_pairs(c.place_persons),
    "neighbors_1hop": lambda c: graph.neighbors_1hop(c.net.knows, c.sources),
    "neighbors_2hop": lambda c: graph.neighbors_2hop(c.net.knows, c.sources),
    # aggregates
    "reply_pair_counts": lambda c: weights.pair_counts(c.pairs),
    "person_tag_count": lambda c: people.tag_counts(c.net.interest),
    "tag_member_count": lambda c: c.net.interest.groupBy("tag_id").agg(F.countDistinct("person_id").alias("n")),
    "edge_count": lambda c: c.net.knows.agg(F.count(F.lit(1)).alias("n")),
    "max_person_id": lambda c: c.net.person.agg((F.max("person_id") + 1).alias("n")),
    "kth_largest": lambda c: people.kth_largest(people.tag_counts(c.net.interest), "n_tags", 10),
    "persons_by_birthday": lambda c: people.by_birthday(c.net.person),
    "place_person_distinct": lambda c: people.person_places(c.net),
    # graph
    "k_hop_neighborhood": lambda c: _hops(c, 2),
    "exact_k_hop_ring": lambda c: _hops(c, 3).filter("dist = 3").select("src", "person_id"),
    "pairs_within_h": lambda c: _pairs_within(c.knows, c.place_persons),
    "pairs_within_h_sparse": _pairs_within_sparse,
    "all_pairs_distance": lambda c: graph.distances(c.community, c.members.withColumnRenamed("person_id", "src")),
    "distance_sum": lambda c: closeness.closeness(c.community, c.members).select("person_id", "s"),
    "distance_histogram": _histogram,
    "connected_components": lambda c: components(weights.above(c.weight, 1)),
    "reachable_count": lambda c: closeness.reachable(c.community, c.members),
    "component_eccentricity": lambda c: closeness.eccentricity(c.community, c.members),
    "closeness_upper_bound": lambda c: closeness.upper_bound(c.community, c.members, 2),
    "closeness_upper_bound_3": lambda c: closeness.upper_bound(c.community, c.members, 3),
    "place_closure": lambda c: people.place_closure(c.net.place, c.net.place_part_of),
    "tag_max_component": lambda c: tag_communities.max_component_by_joins(c.tag_edges, c.net.interest, c.net.person, DAY),
    "tag_component_steps": lambda c: tag_communities.component_steps(c.tag_edges, c.net.interest, c.net.person),
    # the four families
    "q1_shortest_path": lambda c: plans.shortest_paths(c.path_params(), c.weight),
    "q2_topk_tags": lambda c: plans.top_tags(c.tag_params(), c.net),
    "q2_topk_tags_zero_fill": lambda c: plans.top_tags(c.tag_params(ZERO_TAGS), c.net),
    "q3_topk_pairs": lambda c: plans.top_pairs(c.pair_params(), c.net),
    "q4_closeness_all": lambda c: closeness.closeness(c.community, c.members),
    "q4_topk_closeness": lambda c: plans.top_central(c.central_params(), c.net),
    "q4_topk_by_bounds": lambda c: closeness.top_k(c.community, c.members, 5),
    # answers as text
    "fmt_q1": lambda c: formats.paths(plans.shortest_paths(c.path_params(), c.weight)),
    "fmt_q2": lambda c: formats.tags(c.tag_params(), plans.top_tags(c.tag_params(), c.net)),
    "fmt_q3": lambda c: formats.pairs(c.pair_params(), plans.top_pairs(c.pair_params(), c.net)),
    "fmt_q4": lambda c: formats.central(c.central_params(), plans.top_central(c.central_params(), c.net)),
    "export_tgf": lambda c: formats.tgf(c.community),
    "export_dot": lambda c: formats.dot(c.community),
    "parse_queries": _parse_queries,
    "batch_mixed": lambda c: batch.answer(c.net, _parsed(c), c.users[2]),
    "batch_from_files": _from_files,
    # estimates
    "approx_distance_sum": _approximate,
    "estimate_error": lambda c: closeness.estimate_error(_approximate(c), closeness.closeness(c.community, c.members)),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Context(spark, sf_dir))) for name, f in OPERATORS.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most central customers of three brand communities."""
    c = Context(spark, sf_dir)
    return plans.top_central(c.central_params(), c.net)
