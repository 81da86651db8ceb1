"""Every source of a mix comes to its target, however small it is beside the others."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from kithwork.llm import mixing, queries

from .conftest import SCHEMA


def own_docs(spark):
    rows = [(1000 * k + i, "word " * 400, "en", f"big{k}", None) for k in range(3) for i in range(50)]
    rows += [(10_000 + i, "one two three four five " * (1 + i % 3), "en", f"small{i // 2:03}", None) for i in range(80)]
    return spark.createDataFrame(rows, SCHEMA)


def test_small_sources_beside_large_ones_come_to_their_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 64)  # as few slots beside so many words as billions of words have
    got, aims = defaultdict(int), {}
    for r in mixing.mix(own_docs(spark))[0].collect():
        assert 0 <= r["taken"] <= 3 * r["size"]
        got[r["source"]] += r["taken"]
        aims[r["source"]] = r["target"]
    assert len(got) == 43 and all(abs(got[s] - aims[s]) <= 1 for s in got)


def test_slots_tile_what_is_taken_and_keep_near_the_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 500)
    documents, slots = mixing.mix(own_docs(spark))
    aims = {r["source"]: (r["target"], r["source_size"]) for r in documents.collect()}
    rows = sorted(map(tuple, slots.select("slot", "source", "rank", "first", "words").collect()))
    assert [r[0] for r in rows] == list(range(len(rows)))
    given, ranks = defaultdict(int), defaultdict(int)
    total, largest = sum(r[4] for r in rows), max(r[4] for r in rows)
    for n, (_, source, rank, first, words) in enumerate(rows):
        assert rank == ranks[source] and first == given[source] % aims[source][1] and words > 0
        ranks[source] += 1
        given[source] += words
        if source.startswith("big"):
            assert abs(given[source] - aims[source][0] * (n + 1) / len(rows)) <= 0.2 * total
    assert all(abs(given[s] - aims[s][0]) <= 1 for s in aims) and largest <= total / 100


@pytest.mark.parametrize("slots", [64, 500, 1 << 20])
def test_taken_is_what_the_slots_cover(spark, docs, monkeypatch, slots):
    """Every word of every slot counted one by one along the sources' streams gives exactly what is taken."""
    monkeypatch.setattr(mixing, "SLOTS", slots)
    for own in (own_docs(spark), docs):
        documents, table = mixing.mix(own)
        rows = documents.collect()
        size = {r["source"]: r["source_size"] for r in rows}
        times = {s: [0] * n for s, n in size.items()}
        for r in table.collect():
            for w in range(r["words"]):
                times[r["source"]][(r["first"] + w) % size[r["source"]]] += 1
        ends = defaultdict(int)
        for r in sorted(rows, key=lambda r: (r["start"], r["size"])):
            if r["size"]:
                assert r["start"] == ends[r["source"]]  # documents lie end to end
                ends[r["source"]] += r["size"]
            assert r["taken"] == sum(times[r["source"]][r["start"] : r["start"] + r["size"]])
        assert all(ends[s] == n for s, n in size.items())


@pytest.mark.parametrize("slots", [64, 1 << 20])
def test_what_is_taken_is_counted_from_the_slots(spark, docs, tmp_path, monkeypatch, slots):
    """With slots withheld, a document gives what the others cover, and its first slot is the first of those."""
    monkeypatch.setattr(mixing, "SLOTS", slots)
    for n, own in enumerate((own_docs(spark), docs)):
        path = f"file://{tmp_path}/{n}"
        own.write.parquet(f"{path}/documents.parquet")
        whole = {(r["source"], r["start"], r["size"]): r for r in mixing.mix(own)[0].collect()}
        with monkeypatch.context() as m:
            plan = mixing.schedule
            m.setattr(mixing, "schedule", lambda sources, plan=plan: plan(sources).filter("slot % 3 > 0"))
            documents, table = mixing.mix(own)
            rows, kept = documents.collect(), table.collect()
            answer = queries.op6_mix(spark, path).collect()
        cover, size = defaultdict(list), {r["source"]: r["source_size"] for r in rows}
        for r in kept:
            for w in range(r["words"]):
                cover[r["source"], (r["first"] + w) % size[r["source"]]].append(r["slot"])
        for r in rows:
            got = [s for x in range(r["start"], r["start"] + r["size"]) for s in cover[r["source"], x]]
            assert (r["taken"], r["first_slot"]) == (len(got), min(got, default=None))
        assert sum(r["taken"] for r in rows) < sum(r["taken"] for r in whole.values())
        key = lambda r: (r["doc_id"] is not None, r["doc_id"], r["size"], r["taken"], r["first_slot"] or -1)
        assert sorted(map(key, answer)) == sorted(map(key, rows))


def test_the_pipeline_passes_on_what_the_slots_cover(spark, monkeypatch):
    """Documents go on to sharding as often as slots cover them, counted word by word; a source without slots does not."""
    own = own_docs(spark)
    plan = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda sources: plan(sources).filter("source <> 'big1' AND slot % 3 > 0"))
    documents, table = mixing.mix(corpus_pipeline._keyed(own), doc_id=corpus_pipeline.KEY)
    rows = documents.collect()
    times, size = defaultdict(int), {r["source"]: r["source_size"] for r in rows}
    for r in table.collect():
        for w in range(r["words"]):
            times[r["source"], (r["first"] + w) % size[r["source"]]] += 1
    names = {r[corpus_pipeline.KEY]: r["doc_id"] for r in corpus_pipeline._keyed(own).collect()}
    want = Counter()
    for r in rows:
        words = sum(times[r["source"], x] for x in range(r["start"], r["start"] + r["size"]))
        want[names[r["doc_id"]]] = (2 * words + r["size"]) // (2 * r["size"])
    mixed = corpus_pipeline.mix_sources(spark, own, None)
    assert mixed.columns == own.columns
    sharded = corpus_pipeline.shard(spark, mixed, None).collect()
    assert Counter(r["doc_id"] for r in sharded) == +want and max(want.values()) > 1
    assert {r["source"] for r in sharded} >= {"big0", "big2"} and "big1" not in {r["source"] for r in sharded}
