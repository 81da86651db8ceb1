"""Random networks against plain Python, and relations that must hold between queries."""

import random
from collections import deque

import pytest

from kithwork.operators import closeness, graph, kernel, tag_communities
from kithwork.plans import queries
from kithwork.sources import projection
from kithwork.sources.tables import Network


def bfs(adj, s):
    dist, todo = {s: 0}, deque([s])
    while todo:
        v = todo.popleft()
        for w in adj.get(v, ()):
            if w not in dist:
                dist[w] = dist[v] + 1
                todo.append(w)
    return dist


def network(seed, n=40, m=60):
    rng = random.Random(seed)
    edges = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b}
    edges |= {(b, a) for a, b in edges}
    weight = {}
    for a, b in edges:
        weight[a, b] = weight.get((b, a), rng.randrange(4))
    adj = {}
    for a, b in edges:
        adj.setdefault(a, []).append(b)
    return adj, weight


@pytest.mark.parametrize("seed", [1, 2])
def test_shortest_paths(spark, seed):
    adj, weight = network(seed)
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in weight.items()], "src long, dst long, weight long")
    params = [(i, a, b, x) for i, (a, b, x) in enumerate((a, b, x) for x in (-3, -1, 0, 1, 2) for a in range(0, 40, 9) for b in range(0, 44, 7))]
    rows = queries.shortest_paths(spark.createDataFrame(params, "qid long, p1 long, p2 long, x long"), edges).collect()
    assert len(rows) == len(params)
    for r in rows:
        own = {a: [b for b in bs if r["x"] < 0 or weight[a, b] > r["x"]] for a, bs in adj.items()}
        want = 0 if r["p1"] == r["p2"] else bfs(own, r["p1"]).get(r["p2"], -1)
        assert r["dist"] == want, r


def test_closeness_and_bounds(spark):
    adj, weight = network(5, 30, 35)
    edges = spark.createDataFrame([(a, b) for a, b in weight], "src long, dst long")
    members = spark.createDataFrame([(i,) for i in range(31)], "person_id long")
    exact = {r["person_id"]: r for r in closeness.closeness(edges, members).collect()}
    other = {r["person_id"]: r["centrality"] for r in closeness.closeness(edges, members, "frontier").collect()}
    bound = {r["person_id"]: r["bound"] for r in closeness.upper_bound(edges, members, 2).collect()}
    assert len(exact) == 31
    for v, r in exact.items():
        d = bfs(adj, v)
        n, s = len(d) - 1, sum(d.values())
        assert (r["r"], r["s"]) == (n, s)
        assert r["centrality"] == (float(n * n) / float(s) / 30.0 if s else 0.0) == other[v]
        assert bound[v] >= r["centrality"]


@pytest.mark.parametrize("k", [1, 4, 40])
def test_top_k_by_bounds(spark, k):
    _, weight = network(6, 34, 45)
    edges = spark.createDataFrame([(a, b) for a, b in weight], "src long, dst long")
    members = spark.createDataFrame([(i,) for i in range(34)], "person_id long")
    exact = sorted(map(tuple, closeness.closeness(edges, members).select("person_id", "r", "s", "centrality").collect()), key=lambda r: (-r[3], r[0]))
    got = sorted(map(tuple, closeness.top_k(edges, members, k).select("person_id", "r", "s", "centrality").collect()), key=lambda r: (-r[3], r[0]))
    assert got == exact[:k]


def test_kernel_with_many_sources_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(kernel, "LEVEL_BYTES", 1)
    adj, weight = network(8, 200, 300)
    edges = spark.createDataFrame([(a, b) for a, b in weight], "src long, dst long")
    sources = spark.createDataFrame([(i,) for i in range(200)], "src long")
    got = {(r["src"], r["node"]): r["dist"] for r in kernel.distances(edges, sources).collect()}
    want = {(s, v): d for s in range(200) for v, d in bfs(adj, s).items()}
    assert got == want


def test_sampled_sums_are_near_and_repeat(spark):
    _, weight = network(9, 120, 400)
    edges = spark.createDataFrame([(a, b) for a, b in weight], "src long, dst long")
    members = spark.createDataFrame([(i,) for i in range(120)], "person_id long")
    exact = closeness.closeness(edges, members)
    one = closeness.approximate_sums(edges, members, 0.5, 3)
    error = closeness.estimate_error(one, exact).first()
    assert error["n"] > 100 and error["error"] < 0.15
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, closeness.approximate_sums(edges, members, 0.5, 3).collect()))
    full = closeness.estimate_error(closeness.approximate_sums(edges, members, 1.1, 3), exact).first()
    assert full["error"] < 1e-9


def test_tag_steps_against_brute_force(spark):
    rng = random.Random(4)
    adj, weight = network(4, 40, 120)
    days = {v: f"2000-01-{rng.randrange(1, 20):02d}" for v in range(40)}
    tags = {(v, t) for v in range(40) for t in range(3) if rng.random() < 0.6}
    person = spark.createDataFrame(list(days.items()), "person_id long, d string").selectExpr("person_id", "to_date(d) AS birthday")
    interest = spark.createDataFrame(sorted(tags), "person_id long, tag_id long")
    knows = spark.createDataFrame([(a, b) for a, b in weight], "src long, dst long")
    steps = tag_communities.component_steps(tag_communities.tag_edges(knows, interest, person), interest, person).collect()
    for day in sorted(set(days.values())):
        for t in range(3):
            own = {v for v in range(40) if (v, t) in tags and days[v] >= day}
            sub = {v: [w for w in adj.get(v, ()) if w in own] for v in own}
            want = max((len(bfs(sub, v)) for v in own), default=0)
            got = max((r["max_size"] for r in steps if r["tag_id"] == t and str(r["step_date"]) >= day), default=0)
            assert got == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_within_with_persons_outside_the_graph(spark, seed):
    """Far more persons than vertices: both methods find the same pairs."""
    adj, weight = network(seed, 60, 12)
    edges = spark.createDataFrame([(a, b) for a, b in weight], "src long, dst long")
    persons = spark.createDataFrame([(i,) for i in range(200)], "person_id long")
    for h in (1, 2, 3):
        want = {(a, b) for a in adj for b, d in bfs(adj, a).items() if a < b and d <= h}
        for method in ("kernel", "frontier"):
            assert {tuple(r) for r in graph.pairs_within(edges, persons, h, method).collect()} == want, (h, method)


def test_best_pairs_against_all_pairs(spark):
    """Passes over rare tags find what counting all pairs finds, for any k, with a tag that nearly all have."""
    rng = random.Random(12)
    adj, weight = network(12, 50, 70)
    tags = {(v, t) for v in range(50) for t in range(12) if rng.random() < (0.9 if t == 0 else 0.25)}
    frame = spark.createDataFrame
    table = lambda rows, schema: frame(sorted(rows), schema)
    none = frame([], "a long, b long")
    net = Network(
        person=table({(v,) for v in range(50)}, "person_id long").selectExpr("person_id", "DATE '2000-01-01' AS birthday"),
        knows=table(set(weight), "src long, dst long"), comment_creator=none, reply=none, tag=none, interest=table(tags, "person_id long, tag_id long"), forum_tag=none, forum_member=none,
        place=frame([(1, "here"), (2, "there")], "place_id long, name string"), place_part_of=frame([], "child long, parent long"),
        located_in=table({(v, 1) for v in range(50) if v % 5} | {(v, 2) for v in range(0, 50, 3)}, "person_id long, place_id long"),
        org_place=frame([], "org_id long, place_id long"), study_work=frame([], "person_id long, org_id long"),
    )
    asked = [(i, k, h, p) for i, (k, h, p) in enumerate((k, h, p) for k in (1, 7, 5000) for h in (0, 1, 2, 3) for p in ("here", "there", "nowhere"))]
    params = frame(asked, "qid long, k long, h long, place string")
    own = {v: {t for w, t in tags if w == v} for v in range(50)}
    for method in ("kernel", "frontier"):
        got = sorted(map(tuple, queries.top_pairs(params, net, method).collect()))
        want = []
        for qid, k, h, place in asked:
            persons = [v for v in range(50) if (place == "here" and v % 5) or (place == "there" and v % 3 == 0)]
            pairs = [(-len(own[a] & own[b]), a, b) for a in persons for b, d in bfs(adj, a).items() if a < b and b in persons and d <= h]
            want += [(qid, i + 1, a, b, -n) for i, (n, a, b) in enumerate(sorted(pairs)[:k])]
        assert got == sorted(want), method


def test_previous_in_group_over_ranges(spark):
    rng = random.Random(2)
    rows = [(i, f"2024-01-{rng.randrange(1, 29):02d} {rng.randrange(24):02d}:00:{rng.randrange(60):02d}" if i % 50 else None, rng.choice("aab")) for i in range(400)]
    frame = spark.createDataFrame(rows, "event_id long, t string, event_type string").selectExpr("event_id", "CAST(t AS TIMESTAMP_NTZ) AS ts", "event_type")
    for width in (1, 16, 1 << 16):
        got = {r["event_id"]: r["before"] for r in projection.previous_in_group(frame, "event_type", "ts", "event_id", "before", width).collect()}
        want = {}
        for kind in "ab":
            order = sorted((t or "", i) for i, t, k in rows if k == kind)
            want |= {i: (order[n - 1][1] if n else None) for n, (_, i) in enumerate(order)}
        assert got == want


def test_hops_grow_with_h(spark):
    _, weight = network(11)
    edges = spark.createDataFrame([(a, b) for a, b in weight], "src long, dst long")
    persons = spark.createDataFrame([(i,) for i in range(0, 40, 2)], "person_id long")
    before = set()
    for h in range(5):
        now = {tuple(r) for r in graph.pairs_within(edges, persons, h).collect()}
        assert before <= now
        before = now
