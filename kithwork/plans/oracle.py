"""SQL for the registered queries, as DuckDB runs it on the same tables."""

from __future__ import annotations

from kithwork.plans import catalogue as c

PREFIX = """
WITH RECURSIVE
u_creator AS (SELECT CAST(event_id AS BIGINT) AS comment_id, CAST(user_id AS BIGINT) AS person_id FROM events),
u_reply AS (SELECT * FROM (SELECT CAST(event_id AS BIGINT) AS comment_id, CAST(lag(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS replied_id FROM events) WHERE replied_id IS NOT NULL),
u_pairs AS (SELECT r.comment_id, a.person_id AS p1, b.person_id AS p2 FROM u_reply r JOIN u_creator a ON a.comment_id = r.comment_id JOIN u_creator b ON b.comment_id = r.replied_id WHERE a.person_id <> b.person_id),
u_knows AS (SELECT p1 AS src, p2 AS dst FROM u_pairs UNION SELECT p2, p1 FROM u_pairs),
u_counts AS (SELECT p1, p2, count(*) AS n FROM u_pairs GROUP BY p1, p2),
u_weight AS (SELECT k.src, k.dst, CAST(least(coalesce(f.n, 0), coalesce(b.n, 0)) AS BIGINT) AS weight FROM u_knows k LEFT JOIN u_counts f ON f.p1 = k.src AND f.p2 = k.dst LEFT JOIN u_counts b ON b.p1 = k.dst AND b.p2 = k.src),
placed AS (SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS person_id, CAST(o_orderdate AS DATE) AS day FROM orders),
person AS (SELECT person_id, max(day) AS birthday FROM placed GROUP BY person_id),
follows AS (SELECT person_id AS src, lead(person_id) OVER (ORDER BY o_orderkey) AS dst FROM placed),
knows AS (SELECT src, dst FROM follows WHERE src <> dst UNION SELECT dst, src FROM follows WHERE src <> dst),
tag AS (SELECT CAST(min(p_partkey) * 2 AS BIGINT) AS tag_id, p_name AS name FROM part GROUP BY p_name UNION ALL SELECT CAST(min(p_partkey) * 2 + 1 AS BIGINT), p_brand FROM part GROUP BY p_brand),
bought AS (SELECT l.*, o.person_id, n.tag_id AS name_id, b.tag_id AS brand_id FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN tag n ON n.name = p.p_name JOIN tag b ON b.name = p.p_brand LEFT JOIN placed o ON o.o_orderkey = l.l_orderkey),
interest AS (SELECT DISTINCT person_id, name_id AS tag_id FROM bought WHERE l_returnflag = 'R' AND l_linenumber = 1 AND person_id IS NOT NULL),
forum_tag AS (SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS forum_id, brand_id AS tag_id FROM bought WHERE l_quantity = 50 AND l_returnflag = 'R'),
forum_member AS (SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS forum_id, person_id FROM bought WHERE l_returnflag = 'R' AND l_linenumber = 1 AND person_id IS NOT NULL),
place AS (SELECT CAST(n_nationkey AS BIGINT) AS place_id, n_name AS name FROM nation UNION ALL SELECT CAST(r_regionkey + 1000 AS BIGINT), r_name FROM region),
part_of AS (SELECT CAST(n_nationkey AS BIGINT) AS child, CAST(n_regionkey + 1000 AS BIGINT) AS parent FROM nation),
located_in AS (SELECT CAST(c_custkey AS BIGINT) AS person_id, CAST(c_nationkey AS BIGINT) AS place_id FROM customer WHERE c_custkey IN (SELECT person_id FROM person)),
org_place AS (SELECT CAST(s_suppkey AS BIGINT) AS org_id, CAST(s_nationkey AS BIGINT) AS place_id FROM supplier),
study_work AS (SELECT DISTINCT person_id, CAST(l_suppkey AS BIGINT) AS org_id FROM bought WHERE l_returnflag = 'A' AND l_linenumber = 2 AND person_id IS NOT NULL),
org_person AS (SELECT s.person_id, o.place_id FROM study_work s JOIN org_place o ON o.org_id = s.org_id),
person_place AS (SELECT person_id, place_id FROM located_in UNION SELECT person_id, place_id FROM org_person),
closure AS (SELECT place_id AS ancestor, place_id FROM place UNION SELECT c.ancestor, p.child FROM closure c JOIN part_of p ON p.parent = c.place_id),
in_place AS (SELECT DISTINCT a.name, pp.person_id FROM place a JOIN closure c ON c.ancestor = a.place_id JOIN person_place pp ON pp.place_id = c.place_id),
named_forum AS (SELECT DISTINCT f.forum_id, t.name FROM forum_tag f JOIN tag t ON t.tag_id = f.tag_id),
tag_member AS (SELECT DISTINCT f.name, m.person_id FROM named_forum f JOIN forum_member m ON m.forum_id = f.forum_id),
tag_edge AS (SELECT a.tag_id, k.src, k.dst, least(x.birthday, y.birthday) AS day FROM knows k JOIN interest a ON a.person_id = k.src JOIN interest b ON b.person_id = k.dst AND b.tag_id = a.tag_id JOIN person x ON x.person_id = k.src JOIN person y ON y.person_id = k.dst WHERE k.src < k.dst),
tag_count AS (SELECT person_id, count(*) AS n_tags FROM interest GROUP BY person_id),
common AS (SELECT a.person_id AS p1, b.person_id AS p2, count(*) AS common FROM interest a JOIN interest b ON a.tag_id = b.tag_id AND a.person_id < b.person_id GROUP BY 1, 2)
"""


def _values(rows: list[tuple], types: tuple[str, ...]) -> str:
    lit = lambda v, t: f"CAST('{v}' AS {t})"
    return "VALUES " + ", ".join("(" + ", ".join(lit(v, t) for v, t in zip(r, types, strict=True)) + ")" for r in rows)


def _reach(name: str, sources: str, edges: str, depth: int) -> str:
    """CTEs ``name``_walk and ``name`` (src, node, dist) for ``sources`` (src) over ``edges`` (src, dst)."""
    return (
        f", {name}_walk AS (SELECT src, src AS node, CAST(0 AS BIGINT) AS d FROM ({sources}) UNION SELECT w.src, e.dst, w.d + 1 FROM {name}_walk w JOIN ({edges}) e ON e.src = w.node WHERE w.d < {depth})"
        f", {name} AS (SELECT src, node, min(d) AS dist FROM {name}_walk GROUP BY src, node)"
    )


SOURCES = "SELECT * FROM (" + _values([(s,) for s in c.SOURCES], ("BIGINT",)) + ") AS v(src)"
COMMUNITY = f""", member AS (SELECT person_id FROM tag_member WHERE name = '{c.COMMUNITY}'),
community AS (SELECT src, dst FROM knows WHERE src IN (SELECT person_id FROM member) AND dst IN (SELECT person_id FROM member))"""
COMMUNITY_REACH = COMMUNITY + _reach("reach", "SELECT person_id AS src FROM member", "SELECT * FROM community", 14)
SUMS = COMMUNITY_REACH + ", sums AS (SELECT node AS person_id, CAST(count(*) - 1 AS BIGINT) AS r, CAST(sum(dist) AS BIGINT) AS s FROM reach GROUP BY node), size AS (SELECT count(*) AS n FROM member)"
CENTRALITY = "CASE WHEN s > 0 THEN CAST(r * r AS DOUBLE) / CAST(s AS DOUBLE) / CAST(n - 1 AS DOUBLE) ELSE 0.0 END"

PATHS = [(i, a, b, x) for i, (a, b, x) in enumerate((a, b, x) for x in c.THRESHOLDS for a, b in c.PATHS)]
Q1 = (
    f", q AS (SELECT * FROM ({_values(PATHS, ('BIGINT',) * 4)}) AS v(qid, p1, p2, x))"
    ", walk AS (SELECT DISTINCT x, p1 AS src, p1 AS node, CAST(0 AS BIGINT) AS d FROM q UNION SELECT w.x, w.src, e.dst, w.d + 1 FROM walk w JOIN u_weight e ON e.src = w.node AND (w.x < 0 OR e.weight > w.x) WHERE w.d < 14)"
    ", near AS (SELECT x, src, node, min(d) AS dist FROM walk GROUP BY x, src, node)"
    ", a1 AS (SELECT q.qid, q.p1, q.p2, q.x, CASE WHEN q.p1 = q.p2 THEN 0 ELSE coalesce(n.dist, -1) END AS dist FROM q LEFT JOIN near n ON n.x = q.x AND n.src = q.p1 AND n.node = q.p2)"
)


def _q2(values: list[tuple]) -> str:
    rows = [(i, k, d) for i, (k, d) in enumerate(values)]
    return (
        f", q2 AS (SELECT * FROM ({_values(rows, ('BIGINT', 'BIGINT', 'DATE'))}) AS v(qid, k, d))"
        ", alive AS (SELECT DISTINCT q.d, i.tag_id, i.person_id FROM (SELECT DISTINCT d FROM q2) q JOIN interest i ON true JOIN person p ON p.person_id = i.person_id AND p.birthday >= q.d)"
        ", both_ways AS (SELECT tag_id, src, dst, day FROM tag_edge UNION ALL SELECT tag_id, dst, src, day FROM tag_edge)"
        ", grow AS (SELECT d, tag_id, person_id AS root, person_id AS node FROM alive UNION SELECT g.d, g.tag_id, g.root, e.dst FROM grow g JOIN both_ways e ON e.tag_id = g.tag_id AND e.src = g.node AND e.day >= g.d)"
        ", sized AS (SELECT d, tag_id, max(n) AS size FROM (SELECT d, tag_id, root, count(*) AS n FROM grow GROUP BY d, tag_id, root) GROUP BY d, tag_id)"
        ", a2 AS (SELECT qid, rank, tag, size FROM (SELECT q.qid, q.k, t.name AS tag, CAST(coalesce(s.size, 0) AS BIGINT) AS size, row_number() OVER (PARTITION BY q.qid ORDER BY coalesce(s.size, 0) DESC, t.name, t.tag_id) AS rank FROM q2 q JOIN tag t ON true LEFT JOIN sized s ON s.d = q.d AND s.tag_id = t.tag_id) WHERE rank <= k)"
    )


Q3 = (
    f", q3 AS (SELECT * FROM ({_values([(i, *v) for i, v in enumerate(c.TOP_PAIRS)], ('BIGINT', 'BIGINT', 'BIGINT', 'VARCHAR'))}) AS v(qid, k, h, place))"
    ", start3 AS (SELECT DISTINCT i.person_id AS src FROM in_place i JOIN q3 ON q3.place = i.name)"
    + _reach("hop", "SELECT src FROM start3", "SELECT * FROM knows", 3)
    + ", a3 AS (SELECT qid, rank, p1, p2, common FROM (SELECT q.qid, q.k, a.person_id AS p1, b.person_id AS p2, CAST(coalesce(m.common, 0) AS BIGINT) AS common, row_number() OVER (PARTITION BY q.qid ORDER BY coalesce(m.common, 0) DESC, a.person_id, b.person_id) AS rank"
    " FROM q3 q JOIN in_place a ON a.name = q.place JOIN in_place b ON b.name = q.place AND a.person_id < b.person_id JOIN hop ON hop.src = a.person_id AND hop.node = b.person_id AND hop.dist <= q.h LEFT JOIN common m ON m.p1 = a.person_id AND m.p2 = b.person_id) WHERE rank <= k)"
)
Q4 = (
    f", q4 AS (SELECT * FROM ({_values([(i, *v) for i, v in enumerate(c.TOP_CENTRAL)], ('BIGINT', 'BIGINT', 'VARCHAR'))}) AS v(qid, k, tag))"
    ", m4 AS (SELECT name, person_id FROM tag_member WHERE name IN (SELECT tag FROM q4))"
    ", e4 AS (SELECT a.name, k.src, k.dst FROM knows k JOIN m4 a ON a.person_id = k.src JOIN m4 b ON b.person_id = k.dst AND b.name = a.name)"
    ", walk4 AS (SELECT name, person_id AS src, person_id AS node, CAST(0 AS BIGINT) AS d FROM m4 UNION SELECT w.name, w.src, e.dst, w.d + 1 FROM walk4 w JOIN e4 e ON e.name = w.name AND e.src = w.node WHERE w.d < 12)"
    ", near4 AS (SELECT name, src, node, min(d) AS dist FROM walk4 GROUP BY name, src, node)"
    ", n4 AS (SELECT name, count(*) AS n FROM m4 GROUP BY name)"
    f", c4 AS (SELECT name, person_id, r, s, {CENTRALITY} AS centrality FROM (SELECT name, node AS person_id, CAST(count(*) - 1 AS BIGINT) AS r, CAST(sum(dist) AS BIGINT) AS s FROM near4 GROUP BY name, node) JOIN n4 USING (name))"
    ", a4 AS (SELECT qid, rank, person_id, r, s, centrality FROM (SELECT q.qid, q.k, x.*, row_number() OVER (PARTITION BY q.qid ORDER BY x.centrality DESC, x.person_id) AS rank FROM q4 q JOIN c4 x ON x.name = q.tag) WHERE rank <= k)"
)


def _lines(params: str, answers: str, word: str) -> str:
    return f"SELECT q.qid, coalesce(string_agg({word}, ' ' ORDER BY a.rank), '') AS line FROM {params} q LEFT JOIN {answers} a ON a.qid = q.qid GROUP BY q.qid"


FMT1, FMT2 = "SELECT qid, CAST(dist AS VARCHAR) AS line FROM a1", _lines("q2", "a2", "a.tag")
FMT3, FMT4 = _lines("q3", "a3", "a.p1 || '|' || a.p2"), _lines("q4", "a4", "CAST(a.person_id AS VARCHAR)")
BRANDS = ", ".join(f"'{b}'" for b in c.BRANDS)
EDGE_LINES = "SELECT {part}, src, dst, {line} FROM community WHERE src < dst"

ARGS = (
    [(1, i, f"{a},{b},{x}") for i, a, b, x in PATHS]
    + [(2, i, f"{k},{d}") for i, (k, d) in enumerate(c.TOP_TAGS)]
    + [(3, i, f"{k},{h},{p}") for i, (k, h, p) in enumerate(c.TOP_PAIRS)]
    + [(4, i, f"{k},{t}") for i, (k, t) in enumerate(c.TOP_CENTRAL)]
)


def _bound(levels: int) -> str:
    return (
        SUMS
        + f", low AS (SELECT m.person_id, m.r, CAST(coalesce(k.known, 0) + (m.r - coalesce(k.met, 0)) * {levels + 1} AS BIGINT) AS s FROM sums m LEFT JOIN (SELECT node, count(*) AS met, sum(dist) AS known FROM reach WHERE dist BETWEEN 1 AND {levels} GROUP BY node) k ON k.node = m.person_id)"
        + f" SELECT person_id, s AS s_low, {CENTRALITY} AS bound FROM low, size"
    )


def _within(persons: str, edges: str) -> str:
    """Pairs of ``persons`` within 1, 2 and 3 hops over ``edges`` (src, dst)."""
    return _reach("reach", f"SELECT person_id AS src FROM ({persons})", edges, 3) + f" SELECT h.h, src AS p1, node AS p2 FROM reach JOIN (SELECT unnest([1, 2, 3])::BIGINT AS h) h ON dist <= h.h WHERE src < node AND node IN (SELECT person_id FROM ({persons}))"


IN_PLACE = f"SELECT person_id FROM in_place WHERE name = '{c.PLACE}'"
#: Best day from which two members of a tag hang together: the latest of the earliest days on any way between them.
STEPS = (
    ", both_ways AS (SELECT tag_id, src, dst, day FROM tag_edge UNION ALL SELECT tag_id, dst, src, day FROM tag_edge)"
    ", ways AS (SELECT tag_id, src AS root, dst AS node, day FROM both_ways UNION SELECT w.tag_id, w.root, e.dst, least(w.day, e.day) FROM ways w JOIN both_ways e ON e.tag_id = w.tag_id AND e.src = w.node)"
    ", best AS (SELECT tag_id, root, node, max(day) AS day FROM ways WHERE root <> node GROUP BY tag_id, root, node)"
    ", grown AS (SELECT tag_id, day, count(*) OVER (PARTITION BY tag_id, root ORDER BY day DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1 AS n FROM best UNION ALL SELECT i.tag_id, p.birthday, 1 FROM interest i JOIN person p ON p.person_id = i.person_id)"
    ", daily AS (SELECT tag_id, day, max(n) AS n FROM grown GROUP BY tag_id, day)"
    ", compared AS (SELECT tag_id, day, n, max(n) OVER (PARTITION BY tag_id ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM daily)"
    " SELECT tag_id, day AS step_date, CAST(n AS BIGINT) AS max_size FROM compared WHERE before IS NULL OR n > before"
)
ESTIMATE = (
    SUMS
    + f", chosen AS (SELECT person_id FROM member WHERE ((person_id % 65536 + 65536) % 65536 * 40503 + {c.SEED} * 9973) % 65536 / 65536.0 < {c.SHARE})"
    + ", seen AS (SELECT node, count(*) AS met, sum(dist) AS known FROM reach WHERE dist > 0 AND src IN (SELECT person_id FROM chosen) GROUP BY node)"
    + ", estimate AS (SELECT s.person_id, s.r, s.s, CASE WHEN e.met > 0 THEN CAST(e.known * s.r AS DOUBLE) / CAST(e.met AS DOUBLE) END AS s_estimate FROM sums s LEFT JOIN seen e ON e.node = s.person_id)"
)

BODIES = {
    "scan_person": "SELECT * FROM person",
    "scan_knows": "SELECT * FROM knows",
    "scan_comment_creator": "SELECT * FROM u_creator",
    "scan_reply": "SELECT * FROM u_reply",
    "scan_tag": "SELECT * FROM tag",
    "scan_interest": "SELECT * FROM interest",
    "scan_place": "SELECT * FROM place",
    "scan_place_part_of": "SELECT * FROM part_of",
    "scan_located_in": "SELECT * FROM located_in",
    "scan_org_place": "SELECT * FROM org_place",
    "scan_study_work": "SELECT * FROM study_work",
    "scan_forum_tag": "SELECT * FROM forum_tag",
    "scan_forum_member": "SELECT * FROM forum_member",
    "reply_point_lookup": "SELECT * FROM u_reply WHERE comment_id = 500",
    "edge_weight_threshold": "SELECT * FROM u_weight WHERE weight > 0",
    "persons_born_since": f"SELECT * FROM person WHERE birthday >= DATE '{c.DAY}'",
    "persons_with_tag": f"SELECT DISTINCT person_id FROM interest JOIN tag USING (tag_id) WHERE name = '{c.NAME}'",
    "place_by_name": f"SELECT * FROM place WHERE name = '{c.PLACE}'",
    "canonical_pairs": "SELECT src AS p1, dst AS p2 FROM knows WHERE src < dst",
    "encode_birthday": "SELECT person_id, CAST(year(birthday) * 10000 + month(birthday) * 100 + day(birthday) AS BIGINT) AS code FROM person",
    "dense_relabel": "SELECT person_id, row_number() OVER (ORDER BY person_id) - 1 AS new_id FROM person",
    "forum_tag_filtered": f"SELECT * FROM named_forum WHERE name IN ({BRANDS})",
    "forum_member_filtered": f"SELECT * FROM forum_member WHERE forum_id IN (SELECT forum_id FROM named_forum WHERE name IN ({BRANDS}))",
    "reply_pairs": "SELECT * FROM u_pairs",
    "reply_between_friends": "SELECT * FROM u_pairs p WHERE EXISTS (SELECT 1 FROM u_knows k WHERE k.src = p.p1 AND k.dst = p.p2)",
    "knows_weight": "SELECT * FROM u_weight",
    "tag_induced_edges": "SELECT * FROM tag_edge",
    "tag_forum_members": f"SELECT * FROM tag_member WHERE name IN ({BRANDS})",
    "person_org_place": "SELECT * FROM org_person",
    "persons_in_place": f"SELECT * FROM in_place WHERE name IN ('ASIA', '{c.PLACE}')",
    "induced_subgraph": COMMUNITY + " SELECT * FROM community",
    "common_tag_pairs": "SELECT * FROM common",
    "common_tag_count_arrays": "SELECT k.src AS p1, k.dst AS p2, coalesce(m.common, 0) AS common FROM knows k LEFT JOIN common m ON m.p1 = k.src AND m.p2 = k.dst WHERE k.src < k.dst",
    "place_pairs_theta": f"SELECT a.person_id AS p1, b.person_id AS p2 FROM in_place a JOIN in_place b ON a.name = b.name AND a.person_id < b.person_id WHERE a.name = '{c.PLACE}'",
    "neighbors_1hop": f"SELECT src, dst AS node FROM knows WHERE src IN (SELECT src FROM ({SOURCES}))",
    "neighbors_2hop": _reach("reach", SOURCES, "SELECT * FROM knows", 2) + " SELECT src, node FROM reach WHERE dist = 2",
    "reply_pair_counts": "SELECT * FROM u_counts",
    "person_tag_count": "SELECT * FROM tag_count",
    "tag_member_count": "SELECT tag_id, count(DISTINCT person_id) AS n FROM interest GROUP BY tag_id",
    "edge_count": "SELECT count(*) AS n FROM knows",
    "max_person_id": "SELECT max(person_id) + 1 AS n FROM person",
    "kth_largest": "SELECT n_tags AS value FROM tag_count ORDER BY n_tags DESC LIMIT 1 OFFSET 9",
    "persons_by_birthday": "SELECT person_id, birthday, row_number() OVER (ORDER BY birthday DESC, person_id) AS position FROM person",
    "place_person_distinct": "SELECT * FROM person_place",
    "k_hop_neighborhood": _reach("reach", SOURCES, "SELECT * FROM knows", 2) + " SELECT src, node AS person_id, dist FROM reach",
    "exact_k_hop_ring": _reach("reach", SOURCES, "SELECT * FROM knows", 3) + " SELECT src, node AS person_id FROM reach WHERE dist = 3",
    "pairs_within_h": _within(IN_PLACE, "SELECT * FROM knows"),
    "pairs_within_h_sparse": _within(IN_PLACE, "SELECT src, dst FROM u_weight WHERE weight > 0"),
    "all_pairs_distance": COMMUNITY_REACH + " SELECT * FROM reach",
    "distance_sum": SUMS + " SELECT person_id, s FROM sums",
    "distance_histogram": COMMUNITY_REACH + " SELECT node AS person_id, dist, count(*) AS n FROM reach WHERE dist > 0 GROUP BY node, dist",
    "connected_components": _reach("reach", "SELECT DISTINCT src FROM u_weight WHERE weight > 1", "SELECT src, dst FROM u_weight WHERE weight > 1", 30) + " SELECT node, min(src) AS component FROM reach GROUP BY node",
    "reachable_count": SUMS + " SELECT person_id, r FROM sums",
    "component_eccentricity": COMMUNITY_REACH + " SELECT node AS person_id, max(dist) AS eccentricity FROM reach GROUP BY node",
    "closeness_upper_bound": _bound(2),
    "closeness_upper_bound_3": _bound(3),
    "place_closure": "SELECT * FROM closure",
    "tag_max_component": _q2([(1, c.DAY)]) + " SELECT tag_id, CAST(size AS BIGINT) AS size FROM sized",
    "tag_component_steps": STEPS,
    "approx_distance_sum": ESTIMATE + " SELECT person_id, r, s_estimate FROM estimate",
    "estimate_error": ESTIMATE + " SELECT count(*) AS n, round(avg(abs(s_estimate - s) / s), 9) AS error FROM estimate WHERE s > 0 AND s_estimate IS NOT NULL",
    "q1_shortest_path": Q1 + " SELECT * FROM a1",
    "q2_topk_tags": _q2(c.TOP_TAGS) + " SELECT * FROM a2",
    "q2_topk_tags_zero_fill": _q2(c.ZERO_TAGS) + " SELECT * FROM a2",
    "q3_topk_pairs": Q3 + " SELECT * FROM a3",
    "q4_closeness_all": SUMS + f" SELECT person_id, r, s, {CENTRALITY} AS centrality FROM sums, size",
    "q4_topk_by_bounds": SUMS + f" SELECT person_id, r, s, {CENTRALITY} AS centrality FROM sums, size ORDER BY 4 DESC, 1 LIMIT 5",
    "q4_topk_closeness": Q4 + " SELECT * FROM a4",
    "fmt_q1": f"{Q1} {FMT1}",
    "fmt_q2": f"{_q2(c.TOP_TAGS)} {FMT2}",
    "fmt_q3": f"{Q3} {FMT3}",
    "fmt_q4": f"{Q4} {FMT4}",
    "export_tgf": COMMUNITY + " SELECT DISTINCT 0 AS part, src AS a, CAST(NULL AS BIGINT) AS b, src || ' ' || src AS line FROM community UNION ALL SELECT 1, NULL, NULL, '#' UNION ALL " + EDGE_LINES.format(part=2, line="src || ' ' || dst"),
    "export_dot": COMMUNITY + " SELECT 0 AS part, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, 'graph g {' AS line UNION ALL SELECT 2, NULL, NULL, '}' UNION ALL " + EDGE_LINES.format(part=1, line="'  ' || src || ' -- ' || dst || ';'"),
    "parse_queries": f"SELECT * FROM ({_values(ARGS, ('BIGINT', 'BIGINT', 'VARCHAR'))}) AS v(type, qid, args)",
    "batch_mixed": Q1 + _q2(c.TOP_TAGS) + Q3 + Q4 + " " + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS type, qid, line FROM ({sql})" for i, sql in enumerate((FMT1, FMT2, FMT3, FMT4), 1)),
}


def oracle_sql() -> dict[str, str]:
    bodies = BODIES | {"batch_from_files": BODIES["batch_mixed"]}
    return {name: PREFIX + body for name, body in bodies.items()}
