"""Pairs by a grid of blocks against plain Python, with cells that are small and many."""

import random

import pytest

from kithwork.operators import graph, pairs


@pytest.mark.parametrize("cell", [20, 300, 8_000_000])
def test_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(pairs, "CELL_PAIRS", cell)
    ids = random.Random(1).sample(range(-1000, 10**9), 90)
    persons = spark.createDataFrame([(i,) for i in ids + ids[:9]], "person_id long")
    found = pairs.all_pairs(persons)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in ids for b in ids if a < b}
    if cell == 20:  # no key has all: before, one task made all pairs of a place
        made = [len(x) for x in found.rdd.glom().collect()]
        assert max(made) < len(got) / 10


@pytest.mark.parametrize("cell,step", [(20, 7), (300, 50), (8_000_000, 1 << 20)])
def test_common_tags(spark, monkeypatch, cell, step):
    monkeypatch.setattr(pairs, "CELL_PAIRS", cell)
    monkeypatch.setattr(pairs, "STEP_PAIRS", step)
    rng = random.Random(5)
    ids = rng.sample(range(-50, 10**9), 60)
    tags = {v: {t for t in range(-3, 30) if rng.random() < (0.8 if t == 0 else 0.05)} for v in ids}
    rows = [(v, t) for v, ts in tags.items() for t in ts] + [(None, 0), (ids[0], None)]
    found = pairs.common_tags(spark.createDataFrame(rows, "person_id long, tag_id long"))
    got = sorted(map(tuple, found.collect()))
    assert got == sorted((a, b, len(tags[a] & tags[b])) for a in ids for b in ids if a < b and tags[a] & tags[b])
    if cell == 20:
        made = [len(x) for x in found.rdd.glom().collect()]
        assert max(made) < len(got) / 10


def test_no_rows(spark):
    assert pairs.common_tags(spark.createDataFrame([], "person_id long, tag_id long")).count() == 0
    assert pairs.all_pairs(spark.createDataFrame([], "person_id long")).count() == 0


def test_pairs_that_meet_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks grow with the pairs that a join makes, not with the rows that it reads."""
    monkeypatch.setattr(graph, "TASK_ROWS", 400)
    rng = random.Random(8)
    edges = {(a, b) for a, b in ((rng.randrange(150), rng.randrange(150)) for _ in range(300)) if a != b}
    knows = spark.createDataFrame(sorted(edges | {(b, a) for a, b in edges}), "src long, dst long")
    persons = spark.range(0, 150, 2).withColumnRenamed("id", "person_id")
    for h in (1, 2, 3, 4):
        found = graph.pair_distances(knows, persons, h, "frontier")
        assert {tuple(r) for r in found.collect()} == {tuple(r) for r in graph.pair_distances(knows, persons, h, "kernel").collect()}
    made = [len(x) for x in found.rdd.glom().collect()]
    assert max(made) <= 400 < sum(made)
