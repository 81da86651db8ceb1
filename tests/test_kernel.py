"""The kernel's chunks, bounds and counts against plain Python."""

import random
from collections import deque

import numpy as np
import pytest

from kithwork.operators import closeness, kernel
from kithwork.plans import queries
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


def pieces(seed, sizes=(70, 40, 9, 2, 2), degree=3, hub=0):
    """Adjacency of a random graph of several parts, with shuffled ids; the first ``hub`` persons know a whole part."""
    rng = random.Random(seed)
    ids, adj, low = rng.sample(range(-500, 10**6), sum(sizes)), {}, 0
    for n in sizes:
        own = ids[low : low + n]
        pairs = [(own[i], own[rng.randrange(i)]) for i in range(1, n)] + [tuple(rng.sample(own, 2)) for _ in range(n * (degree - 2) // 2)]
        for a, b in pairs + [(own[0], x) for x in own[1:] if low < hub]:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
        low += n
    return adj


def graph(adj):
    src, dst = np.array([(a, b) for a, bs in adj.items() for b in bs], np.int64).T
    return kernel.Graph(src, dst)


@pytest.mark.parametrize("hub,heavy,width", [(0, 256, 16), (1, 256, 16), (1, 5, 1)])
def test_levels_and_counts(monkeypatch, hub, heavy, width):
    """Chunks inside a part, over several parts, of scattered sources; hubs; tiny tiles and groups."""
    monkeypatch.setattr(kernel, "HEAVY", heavy)
    monkeypatch.setattr(kernel, "MAX_WORDS", width)
    monkeypatch.setattr(kernel, "TILE_BYTES", 100)
    monkeypatch.setattr(kernel, "GROUP_BYTES", 400)
    adj = pieces(3, hub=hub)
    g, want = graph(adj), {v: bfs(adj, v) for v in adj}
    assert sorted(g.sizes.tolist()) == [2, 2, 9, 40, 70]
    for sources in (np.arange(len(g.ids)), np.arange(0, len(g.ids), 7), np.array([5])):
        got = {}
        for low, high in g.chunks(sources):
            part = sources[low:high]
            for d, n in kernel._profile(g, part):
                got |= {(int(g.ids[v]), d): int(c) for v, c in zip(part, n, strict=True) if c}
        plain = {}
        for v in g.ids[sources].tolist():
            for d in want[v].values():
                if d:
                    plain[v, d] = plain.get((v, d), 0) + 1
        assert got == plain


@pytest.mark.parametrize("rows", [0, 1, 8, 9, 100, 1000])
def test_column_counts(rows):
    bits = np.random.default_rng(rows).integers(0, 1 << 63, (rows, 3)).astype(np.uint64)
    plain = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").sum(0) if rows else np.zeros(192)
    assert kernel.column_counts(bits).tolist() == plain.tolist()


def test_a_chunk_works_on_its_own_component():
    """Rows of other parts are not held: twice as many parts cost twice the work, not four times."""
    adj = pieces(1, sizes=(100,) * 12)
    g = graph(adj)
    for low, high in g.chunks(np.arange(300)):
        for _, _, reached, level in g.levels(np.arange(low, high), None):
            assert not level or len(reached) < 1200
    assert sum(len(r) for _, _, r, level in g.levels(np.arange(100), 0) if level) == 100


@pytest.mark.parametrize("seed,degree", [(1, 2), (2, 3), (5, 6)])
def test_least_sums_are_bounds(seed, degree):
    adj = pieces(seed, (90, 30, 2), degree)
    g = graph(adj)
    for deepest in (1, 3, 40):
        r, s = g.least_sums(deepest)
        for i, v in enumerate(g.ids.tolist()):
            d = bfs(adj, v)
            assert r[i] == len(d) - 1 and s[i] <= sum(d.values())


def test_few_members_are_evaluated(spark, monkeypatch):
    """Of a small world most members are bounded away, and ties beyond the first round are kept."""
    rng, n, k = random.Random(3), 6000, 5
    edges = sorted({(a, b) for a, b in ((rng.randrange(n), int(rng.random() ** 2 * n)) for _ in range(5 * n)) if a != b})
    frame = spark.createDataFrame(edges + [(b, a) for a, b in edges], "src long, dst long").distinct()
    members = spark.range(n).withColumnRenamed("id", "person_id")
    seen = []
    each = kernel._each
    monkeypatch.setattr(kernel, "_each", lambda spark, n, do, schema, tasks=16: (lambda out: (seen.append(out.count()), out)[1])(each(spark, n, do, schema, tasks)))
    got = list(map(tuple, closeness.top_k(frame, members, k).orderBy("centrality", ascending=False).collect()))
    assert sum(seen) < n / 2
    exact = closeness.closeness(frame, members).collect()
    assert got == [tuple(r) for r in sorted(exact, key=lambda r: (-r["centrality"], r["person_id"]))[:k]]


@pytest.mark.parametrize("method,most", [("auto", 16_000_000), ("auto", 30), ("frontier", 0)])
def test_central_members_of_several_tags(spark, monkeypatch, method, most):
    """All together, a few at a time and by joins: the same, with members who know no one and with equal values."""
    monkeypatch.setattr(kernel, "MAX_PLAIN", most)
    if most == 30:
        monkeypatch.setattr(kernel, "collect", None)
    knows = sorted({(a, b) for x, y in [(0, 1), (1, 2), (2, 3), (4, 5), (5, 6), (6, 7), (8, 9), (3, 8)] for a, b in ((x, y), (y, x))})
    tags = {"a": range(0, 4), "b": range(4, 8), "c": range(0, 12), "d": [10, 11]}
    frame = spark.createDataFrame
    none = frame([], "a long, b long")
    net = Network(
        person=none, knows=frame(knows, "src long, dst long"), comment_creator=none, reply=none, tag=frame([(i, t) for i, t in enumerate(tags)], "tag_id long, name string"), interest=none,
        forum_tag=frame([(i, i) for i in range(4)], "forum_id long, tag_id long"), forum_member=frame([(i, p) for i, t in enumerate(tags.values()) for p in t], "forum_id long, person_id long"),
        place=none, place_part_of=none, located_in=none, org_place=none, study_work=none,
    )
    params = frame([(i, k, t) for i, (k, t) in enumerate((k, t) for k in (2, 20) for t in [*tags, "e"])], "qid long, k long, tag string")
    got = {(r["qid"], r["rank"]): tuple(r)[2:] for r in queries.top_central(params, net, method).collect()}
    want = {}
    for qid, (k, t) in enumerate((k, t) for k in (2, 20) for t in [*tags, "e"]):
        own = set(tags.get(t, ()))
        adj = {a: [b for x, b in knows if x == a and b in own] for a in own}
        rows = []
        for v in own:
            d = bfs(adj, v)
            r, s = len(d) - 1, sum(d.values())
            rows.append((v, r, s, float(r * r) / float(s) / float(len(own) - 1) if s else 0.0))
        for rank, row in enumerate(sorted(rows, key=lambda x: (-x[3], x[0]))[:k], 1):
            want[qid, rank] = row
    assert got == want
