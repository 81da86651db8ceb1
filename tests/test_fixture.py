"""A hand-checked network of eight persons, read from files and queried in a batch."""

import pytest

from kithwork.operators import components, graph, people, tag_communities, weights
from kithwork.plans import batch, formats, queries
from kithwork.sources import delimited, generate, query_file

FILES = {
    "person": ["id|firstName|lastName|gender|birthday|more"] + [f"{i}|a|b|c|{d}|x|y" for i, d in enumerate(["1980-01-01", "1985-06-15", "1990-03-03", "1979-12-31", "1990-03-03", "2000-02-29", "1988-08-08", "1995-05-05"])],
    "person_knows_person": ["a|b"] + [f"{a}|{b}" for x, y in [(0, 1), (1, 2), (2, 3), (3, 4), (0, 4), (2, 4), (5, 6)] for a, b in ((x, y), (y, x))],
    "comment_hasCreator_person": ["c|p"] + [f"{c}|{p}" for c, p in zip(range(0, 150, 10), [0, 1, 0, 1, 0, 1, 2, 1, 2, 4, 3, 7, 0, 2, 2], strict=True)],
    "comment_replyOf_comment": ["c|r"] + ["10|0", "20|10", "30|20", "40|30", "60|50", "70|60", "100|90", "90|80", "110|0", "140|130", "120|10"],
    "tag": ["id|name|url", "100|Bach|u", "200|Ada|u", "300|Curie|u"],
    "person_hasInterest_tag": ["p|t"] + [f"{p}|{t}" for p, ts in {0: (100, 200), 1: (100, 200), 2: (100,), 3: (200, 100), 4: (200,), 5: (100, 200), 6: (100, 200)}.items() for t in ts],
    "forum_hasTag_tag": ["f|t", "0|100", "10|200", "20|100"],
    "forum_hasMember_person": ["f|p|when"] + [f"{f}|{p}|2020" for f, ps in {0: (0, 1, 2, 4), 10: (5, 6, 7, 3), 20: (3, 5, 6)}.items() for p in ps],
    "place": ["id|name|url", "1|World|u", "2|Europe|u", "3|Paris|u", "4|Rome|u", "5|Paris|u", "6|USA|u"],
    "place_isPartOf_place": ["a|b", "2|1", "3|2", "4|2", "6|1", "5|6"],
    "person_isLocatedIn_place": ["p|l"] + [f"{p}|{q}" for p, q in [(0, 3), (1, 3), (2, 4), (3, 5), (4, 6), (5, 5), (6, 4), (7, 1)]],
    "organisation_isLocatedIn_place": ["o|l", "0|3", "10|6"],
    "person_studyAt_organisation": ["p|o|year", "2|0|1999"],
    "person_workAt_organisation": ["p|o|year", "6|10|2001", "2|0|2003"],
}
QUERIES = """query4(7, Bach)
query1(0, 3, -1)
query2(3, 1980-01-01)
query1(0, 2, 0)
query3(3, 1, Paris)
query1(0, 2, 1)
query1(0, 3, 0)
query1(0, 1, 1)
query1(0, 1, 2)
query1(5, 0, -1)
query1(7, 7, 3)
query2(2, 1979-01-01)
query2(3, 1985-06-15)
query2(3, 2001-01-01)
query3(3, 2, Paris)
query3(4, 3, Europe)
query3(3, 1, USA)
query3(5, 2, World)
query3(2, 2, Atlantis)
query4(4, Ada)
query4(3, Curie)
"""
EXPECTED = ["2", "2", "-1", "-1", "1", "-1", "-1", "0", "Ada Bach Curie", "Ada Bach", "Ada Bach Curie", "Ada Bach Curie", "0|1 1|2 2|3", "0|1 0|3 1|3", "0|1 0|2 1|2", "5|6 3|4", "0|1 0|3 1|3 5|6 0|2", "", "2 4 0 1 3 5 6", "5 6 3 7", ""]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("network")
    for name, lines in FILES.items():
        (path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    (path / "queries.txt").write_text(QUERIES)
    return str(path)


@pytest.fixture(scope="module")
def net(spark, folder):
    return delimited.load(spark, folder)


def test_batch_answers_in_order_of_type(spark, folder):
    rows = batch.run(spark, folder, f"{folder}/queries.txt").orderBy("type", "qid").collect()
    assert [r["line"] for r in rows] == EXPECTED


def test_weights(net):
    rows = weights.weighted(net.knows, net.reply, net.comment_creator).filter("src < dst").collect()
    assert {(r["src"], r["dst"]): r["weight"] for r in rows} == {(0, 1): 2, (1, 2): 1, (2, 3): 0, (3, 4): 0, (0, 4): 0, (2, 4): 0, (5, 6): 0}


@pytest.mark.parametrize("h", [0, 1, 2, 3])
def test_pairs_within_agree_between_methods(net, h):
    persons = net.person.select("person_id")
    sets = [{(r["p1"], r["p2"]) for r in graph.pairs_within(net.knows, persons, h, m).collect()} for m in ("kernel", "frontier")]
    assert sets[0] == sets[1]


def test_frontier_equals_kernel(net):
    sources = net.person.selectExpr("person_id AS src")
    both = [{tuple(r) for r in graph.distances(net.knows, sources, None, m).select("src", "node", "dist").collect()} for m in ("kernel", "frontier")]
    assert both[0] == both[1] and (7, 7, 0) in both[0]


def test_heavy_tags_take_joins_and_agree(spark, net):
    edges = tag_communities.tag_edges(net.knows, net.interest, net.person)
    days = query_file.parse_lines(spark.createDataFrame([(0, "query2(1, 1980-01-01)"), (1, "query2(1, 1985-06-15)")], "line_no int, value string"))[2]
    light, heavy = ({tuple(r) for r in tag_communities.sizes_at(edges, net.interest, net.person, days, n).select("d", "tag_id", "size").collect()} for n in (10**6, 0))
    assert light == heavy


def test_cyclic_places_and_components(spark):
    place = spark.createDataFrame([(1, "a"), (2, "b")], "place_id long, name string")
    part = spark.createDataFrame([(1, 2), (2, 1)], "child long, parent long")
    assert people.place_closure(place, part).count() == 4
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "src long, dst long")
    got = {r["node"]: r["component"] for r in components.components(chain).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_exports(spark, net):
    lines = [r["line"] for r in formats.tgf(net.knows).orderBy("part", "a", "b").collect()]
    assert lines[:2] == ["0 0", "1 1"] and "#" in lines and lines[-1] == "5 6"
    assert formats.dot(net.knows).orderBy("part", "a", "b").first()["line"] == "graph g {"


def test_empty_batch(spark, net):
    params = query_file.parse_lines(spark.createDataFrame([], "line_no int, value string"))
    assert batch.answer(net, params).count() == 0
    assert queries.top_central(params[4], net).columns == ["qid", "rank", "person_id", "r", "s", "centrality"]


def test_generated_queries_repeat_and_parse(spark, net):
    lines = generate.query_lines(net, 3, seed=5)
    assert lines == generate.query_lines(net, 3, seed=5) and len(lines) == 12
    params = query_file.parse_lines(spark.createDataFrame(list(enumerate(lines)), "line_no int, value string"))
    assert [params[k].count() for k in (1, 2, 3, 4)] == [3, 3, 3, 3]
    # with frontiers only, answers are the same
    wide = weights.weighted(net.knows, net.reply, net.comment_creator)
    both = [sorted(map(tuple, queries.shortest_paths(params[1], wide, m).collect())) for m in ("kernel", "frontier")]
    assert both[0] == both[1]
    both = [sorted(map(tuple, queries.top_pairs(params[3], net, m).collect())) for m in ("kernel", "frontier")]
    assert both[0] == both[1]
