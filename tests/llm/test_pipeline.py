"""The pipeline against a brute-force version, stage by stage, and the registered queries."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kithwork.llm import mixing, queries, sharding, toxicity

from . import brute

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not here")


@pytest.fixture(scope="module")
def folder(spark, clashing, rows, tmp_path_factory):
    """A small folder of tables; the labels mark documents with a planted word."""
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    texts = [r[1] or "" for r in rows]
    own = clashing.unionByName(clashing.limit(0))
    bad = spark.createDataFrame([(5000 + i, f"{t.split(chr(10))[0]} you blatherskite {i} {t[:60]}") for i, t in enumerate(texts[:60])], "doc_id long, text string")
    for c in own.columns:
        if c not in bad.columns:
            bad = bad.withColumn(c, F.lit("s1" if c == "source" else None).cast(own.schema[c].dataType))
    plain = [" ".join(f"{c}{i}x{i * 7 % 11}" for i in range(900)) for c in "uvw"]
    passage = texts[4].split()[10:23]
    more = [(3000, f"{plain[0]} {' '.join(passage)} end"), (3001, f"start {plain[1]} {' '.join(passage[:12])}"), (3002, f"other rareword {plain[2]}")]
    more = spark.createDataFrame(more, "doc_id long, text string")
    for c in own.columns:
        if c not in more.columns:
            more = more.withColumn(c, F.lit("s1" if c == "source" else None).cast(own.schema[c].dataType))
    own.unionByName(bad).unionByName(more).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1, 0) for r in rows if r[0] is not None] + [(5000 + i, 1, 1) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(texts[4].split()[2:45])), (2, None), (3, "rareword")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def pair_rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(x):
    return [(v is not None, v) for v in x]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = pair_rows(docs)
        after = stage(spark, docs, folder)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns, name
        after = after.persist()
        now = pair_rows(after)
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            automaton = model.automaton()
            want = [x for x in before if model.score(automaton, x[1]) < toxicity.THRESHOLD]
            assert sorted(now, key=key) == sorted(want, key=key) and not any("blatherskite" in (t or "") for _, t in now)
            assert {d for d, _ in before if d is not None and d < 5000} == {d for d, _ in now if d is not None}
        elif name == "near duplicates":
            groups = {x[3] for x, (_, t) in zip(brute.classes(before), before, strict=True) if brute.shingles(t)}
            full = [x for x in now if brute.shingles(x[1])]
            assert len(full) == len(groups) and {x for x in before if not brute.shingles(x[1])} == {x for x in now if not brute.shingles(x[1])}
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            counted = list(zip(before, brute.decontaminate(before, items), strict=True))
            windows = {x for x in before if brute.holds_window(x[1], items)}
            bad = windows | {x for x, (_, n, h, _) in counted if h and 20 * h >= n}
            assert sorted(now, key=key) == sorted((x for x in before if x not in bad), key=key)
            assert not any(brute.holds_window(t, items) for _, t in now)
            # a window is enough in a long document, a short item is not, and clean documents stay
            assert {d for d, _ in windows} >= {3000} and {d for d, _ in now} >= {3001, 3002}
            assert all(x in now for x, (_, _, h, _) in counted if not h)
        elif name == "mixing":
            keyed = corpus_pipeline._keyed(docs)
            taken, _ = mixing.mix(keyed, doc_id=corpus_pipeline.KEY)
            copies = Counter()
            for r in taken.filter("size > 0").collect():
                copies[r["doc_id"]] += (2 * r["taken"] + r["size"]) // (2 * r["size"])
            names = {r[corpus_pipeline.KEY]: (r["doc_id"], r["text"]) for r in keyed.collect()}
            got, own = Counter(now), Counter(before)
            assert got == Counter({names[k]: n for k, n in copies.items() if n})
            assert all(n <= 3 * own[x] for x, n in got.items())
        else:
            rows = [tuple(r) for r in after.select("doc_id", "shard", "slot").collect()]
            assert all(s == brute.shard(d, corpus_pipeline.SHARDS) for d, s, _ in rows) and sorted(now, key=key) == sorted(before, key=key)
            for s in {x[1] for x in rows}:
                assert sorted(x[2] for x in rows if x[1] == s) == list(range(sum(x[1] == s for x in rows)))
        docs = after
    ran = corpus_pipeline.run(spark, folder)
    assert sorted(pair_rows(ran), key=key) == sorted(pair_rows(docs), key=key)


def test_stages_of_an_empty_table(spark, folder, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
    assert sharding.SLOT_PARTS > 1


@needs_data
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    result = con.sql(queries.oracle_sql()[name])
    assert sorted(result.columns) == sorted(df.columns)
    columns = result.columns
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(map(str, r)) for r in result.fetchall())


CONTRACT = {
    "op1": "page_id url text n_chars", "op2": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op3": "doc_id n_words n_hit n_items items_sha256 contaminated", "op4": "doc_id n_lines n_dropped kept_sha256",
    "op5": "doc_id n_words n_removed kept_sha256", "op6": "doc_id size source_size target taken", "op7": "doc_id size text_crc32 law shard slot grown_shard", "op8": "doc_id held_out score predicted",
    "op9": "doc_id class_id n_links", "op10": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
}
TYPES = {"text": "string", "url": "string", "spans": "string", "law": "string", "shard": "int", "grown_shard": "int", "target": "double", "score": "double", "predicted": "int", "contaminated": "boolean", "held_out": "boolean", "base_failed": "boolean", "kept": "boolean"}


@needs_data
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_columns(spark, name):
    want = CONTRACT[name.split("_")[0]].split()
    df = queries.queries()[name](spark, DATA)
    assert df.columns[: len(want)] == want
    types = dict(df.dtypes)
    for c in want:
        assert types[c] == ("string" if c.endswith("sha256") else TYPES.get(c, "bigint")), c
    assert df.count() == spark.read.parquet(f"{DATA}/{'pages' if name.startswith('op1_') else 'documents'}.parquet").count()
