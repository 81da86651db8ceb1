"""Components on graphs of a large diameter and against a plain version."""

import random

from kithwork.operators import components


def least(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {x: root(x) for x in parent}


def found(spark, edges):
    rows = components.components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["component"] for r in rows}


def test_a_long_path_with_shuffled_ids(spark):
    ids = random.Random(4).sample(range(-(10**15), 10**15), 3000)
    path = list(zip(ids, ids[1:], strict=False))
    assert set(found(spark, path).values()) == {min(ids)}


def test_paths_stars_loops_and_strays(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 - i) for i in range(1, 90)] + [(2000, 2000), (2001, 2001), (2001, 2002)]
    edges += [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(190)]
    assert found(spark, edges) == least(edges)
    assert found(spark, [(1, None), (None, 2)]) == found(spark, []) == {}
