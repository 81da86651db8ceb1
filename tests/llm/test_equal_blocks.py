"""Equal rows: blocks of the benchmark index with equal contents, lines that many documents share."""

import random

import numpy as np

from kithwork.llm import decontamination, lines, substrings

from . import brute
from .conftest import listed, same


def test_a_file_appended_twice_keeps_all_rows(spark, monkeypatch):
    own = [(1, "one two three four"), (2, "five six"), (None, None)]
    items = [(1, "two three"), (2, "five six"), (3, "four")]
    once = spark.createDataFrame(own, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(decontamination, "PART_WORDS", 2)
    found = decontamination.search(decontamination.build_index(once.unionByName(once)), spark.createDataFrame(items, "item_id long, text string"))
    assert same(listed(found, "doc_id", "n_words", "n_hit", "items"), brute.decontaminate(own + own, items))


def test_line_index_holds_real_counts_and_answers_from_many_copies(spark, monkeypatch):
    own = [(i % 40 if i % 7 else None, f"shared line number one\nown line {i:05d} of it\n  Shared LINE number one\t") for i in range(600)]
    own += [(None, "shared line number one\ntwice and twice again")] * 300 + [(77, "")]
    docs = spark.createDataFrame(own, "doc_id long, text string").repartition(6)
    keys = lines.line_keys(docs)
    index, _ = lines.build_index(keys)
    h = keys.groupBy("h", "print").count().collect()
    shard = [lines.Shard(*r[2:]) for r in index.collect()]
    assert len(shard) == 1
    for hashed, mark, n in h:
        at = shard[0].look(np.array([hashed], np.int64).view(np.uint64), np.array([mark], np.int32).view(np.uint32))
        assert shard[0].counts[at[0]] == n
    assert max(n for _, _, n in h) == 1500
    monkeypatch.setattr(lines, "SHARD_KEYS", 50)
    monkeypatch.setattr(lines, "COPY_PROBES", 40)
    got = lines.drop_repeated_lines(docs, with_text=False)
    assert same(listed(got, "doc_id", "n_lines", "n_dropped", "kept_sha256"), brute.drop_lines(own))


def test_sketch_stays_in_its_bound(spark, docs):
    bits = substrings.sketch_bits(0)
    twice, hot = substrings._sketch(docs.selectExpr("coalesce(text, '') AS body"), bits, 35, 16)
    assert sum(map(len, twice)) + len(hot) == substrings.sketch_bytes(bits)
    assert substrings.sketch_bits(10**15) == substrings.MAX_BITS and substrings.sketch_bytes(substrings.MAX_BITS) == 192 << 20


def test_substrings_of_many_equal_rows_and_a_very_long_text(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    passage = say(60)
    own = [(None, passage)] * 200 + [(7, f"{say(20)} {passage} {say(300_000)} {passage[:180]}"), (8, say(50))]
    frame = spark.createDataFrame(own, "doc_id long, text string").repartition(5)
    got = substrings.remove_repeats(frame, with_text=False)
    assert same(listed(got, "doc_id", "n_words", "n_removed", "kept_sha256"), brute.drop_windows(own))
