"""The operators over documents against plain versions, with nulls, blanks, ties, repeated rows, long texts and clashing names."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kithwork.llm import decontamination, jaccard, lines, mixing, quality, sharding, substrings
from kithwork.llm import words as W

from . import brute
from .conftest import SCHEMA, listed, make_docs, same


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


# ---- words ----


def test_words_and_sequences():
    texts = ["a b  c", None, "", "é\x0bzz", "a b c d"]
    got = []
    for first, end, data, offsets in W.chunks(pa.array(texts), 4):
        starts, ends, rows = W.spans(data, offsets, W.SOLID)
        got += [(first + r, bytes(data[a:b]).decode()) for a, b, r in zip(starts, ends, rows, strict=True)]
        assert end > first
    assert got == [(i, w) for i, t in enumerate(texts) for w in brute.WORD.findall(t or "")]
    data = np.frombuffer(b"aa b aa c b aa c", np.uint8)
    s, e, _ = W.spans(data, np.array([0, len(data)]), W.SOLID)
    h = W.hashes(data, s, e)
    assert h[0] == h[2] == h[5] and len(set(h.tolist())) == 3
    for n in (1, 2, 3, 5, 7):
        q = W.sequences(h, n)
        words = [bytes(data[a:b]) for a, b in zip(s, e, strict=True)]
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        assert len(q) == len(grams)
        assert all((q[i] == q[j]) == (grams[i] == grams[j]) for i in range(len(grams)) for j in range(len(grams)))


# ---- 3 ----


def items(spark, rows):
    texts = [r[1] or "" for r in rows]
    own = [(1, " ".join(texts[4].split()[5:40])), (2, "one two three"), (3, None), (None, " ".join(texts[10].split()[:13])), (5, ""), (6, "never seen at all"), (2, "ONE, two; three"), (7, " ".join(texts[16].split()[9:60]))]
    return own, spark.createDataFrame(own, "item_id long, text string")


def test_decontamination(spark, docs, rows):
    own, bench = items(spark, rows)
    index = decontamination.build_index(docs)
    found = decontamination.search(index, bench)
    want = [(d, n, h, i) for d, n, h, i in brute.decontaminate(pairs(rows), own)]
    assert listed(found, "doc_id", "n_words", "n_hit", "items") == sorted(want, key=lambda t: [(x is not None, x) for x in t])
    assert sum(bool(x[3]) for x in want) > 10


def test_decontamination_in_several_passes(spark, docs, rows, monkeypatch):
    own, bench = items(spark, rows)
    monkeypatch.setattr(decontamination, "PART_WORDS", 20)
    found = decontamination.search(decontamination.build_index(docs), bench)
    assert same(listed(found, "doc_id", "n_words", "n_hit", "items"), brute.decontaminate(pairs(rows), own))


def test_phrases_and_proximity(spark):
    own = [(1, "the quick brown fox"), (2, "brown the quick fox"), (3, "quick one two three four brown"), (4, None)]
    index = decontamination.build_index(spark.createDataFrame(own, "doc_id long, text string"))
    assert listed(decontamination.phrases(index, ["quick brown", "the quick"]), "query", "doc_id") == [(0, 1), (1, 1), (1, 2)]
    assert listed(decontamination.phrases(index, ["brown quick"], 3), "doc_id") == [(1,), (2,)]
    assert listed(decontamination.phrases(index, ["brown quick"], 6), "doc_id") == [(1,), (2,), (3,)]


def test_decontamination_of_empty_tables(spark, empty, docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.search(decontamination.build_index(empty), none).count() == 0
    assert decontamination.search(decontamination.build_index(docs), none).filter("n_hit > 0").count() == 0


# ---- 4 ----


def test_lines(docs, rows, clashing):
    want = brute.drop_lines(pairs(rows))
    assert sum(x[2] for x in want) > 20
    for d in (docs, clashing):
        got = lines.drop_repeated_lines(d).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("sha"))
        assert same(listed(got, "doc_id", "n_lines", "n_dropped", "sha"), want)


def test_lines_with_many_shards_and_copies(docs, rows, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 7)
    monkeypatch.setattr(lines, "COPY_PROBES", 3)
    got = lines.drop_repeated_lines(docs)
    assert same(listed(got, "doc_id", "n_dropped"), [(x[0], x[2]) for x in brute.drop_lines(pairs(rows))])


def test_lines_of_an_empty_table(empty):
    assert lines.drop_repeated_lines(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    table = lines.PerfectHash.build(keys)
    again = lines.PerfectHash.unpack(*table.pack())
    assert sorted(again.index(keys).tolist()) == list(range(len(keys)))
    assert len(table.rest) < 5


def test_perfect_hash_with_equal_keys():
    keys = np.array([5, 5, 9], np.uint64)
    assert set(lines.PerfectHash.build(keys).index(keys)) >= {0}


# ---- 5 ----


@pytest.mark.parametrize("window", [35, 8, 16])
def test_substrings(docs, rows, window):
    want = brute.drop_windows(pairs(rows), window)
    assert sum(x[2] > 0 for x in want) > 15
    got = substrings.remove_repeats(docs, window)
    assert same(listed(got, "doc_id", "n_words", "n_removed", "kept_sha256"), want)
    assert got.filter(F.sha2(F.col("kept").cast("binary"), 256) != F.col("kept_sha256")).count() == 0


def test_substrings_lose_nothing_with_a_full_sketch_and_small_buffers(docs, rows, clashing, monkeypatch):
    monkeypatch.setattr(substrings, "MAX_BITS", 8)
    monkeypatch.setattr(substrings, "MIN_BITS", 8)
    monkeypatch.setattr(substrings, "BUFFER", 300)
    monkeypatch.setattr(substrings, "HOT", 2)
    want = brute.drop_windows(pairs(rows))
    assert same(listed(substrings.remove_repeats(clashing), "doc_id", "n_words", "n_removed", "kept_sha256"), want)


def test_substrings_of_an_empty_table(empty):
    assert substrings.remove_repeats(empty).count() == 0


# ---- 6 ----


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    assert mixing.targets([1000, 10, 0], [1, 2, 3]) == pytest.approx([980 + 0, 30, 0])
    assert mixing.targets([], []) == []
    assert mixing.targets([0, 0], [1, 2]) == [0, 0]


@pytest.mark.parametrize("slots", [1 << 20, 500])
def test_mixing(docs, rows, clashing, monkeypatch, slots):
    monkeypatch.setattr(mixing, "SLOTS", slots)
    sizes = [len(brute.WORD.findall(r[1] or "")) for r in rows]
    for d in (docs, clashing):
        found, _ = mixing.mix(d)
        got = listed(found, "doc_id", "source", "size", "taken", "source_size", "target")
        assert same([x[:3] for x in got], [(r[0], r[3], n) for r, n in zip(rows, sizes, strict=True)])
        by = {}
        for x in got:
            by.setdefault(x[1], []).append(x)
            assert 0 <= x[3] <= 3 * x[2]
        names = sorted(by, key=lambda s: (s is None, s or ""))
        own = [sum(x[2] for x in by[s]) for s in names]
        want = mixing.targets(own, [1 + i % 3 for i in range(len(names))])
        length = -(-sum(own) // slots)
        for s, n, t in zip(names, own, want, strict=True):
            assert {x[4] for x in by[s]} == {n} and {round(x[5], 6) for x in by[s]} == {round(t, 6)}
            assert abs(sum(x[3] for x in by[s]) - t) <= 12 * length + 0.01 * t
        again, _ = mixing.mix(d)
        assert listed(again, "doc_id", "size", "taken") == listed(found, "doc_id", "size", "taken")


def test_mixing_of_empty_tables(spark, empty):
    assert mixing.mix(empty)[0].count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None), (2, " ", "en", "a", 1)], SCHEMA)
    assert listed(mixing.mix(blank)[0], "doc_id", "taken") == [(1, 0), (2, 0)]


# ---- 7 ----


def test_sharding(docs, rows, clashing):
    for d in (docs, clashing):
        got = listed(sharding.assign(d, [1.0] * 24, grown=1.0), "doc_id", "size", "text_crc32", "shard", "grown_shard", "slot")
        assert same([x[:5] for x in got], [(r[0], len((r[1] or "").encode()) + 8, brute.crc(r[1]), brute.shard(r[0], 24), brute.shard(r[0], 25)) for r in rows])
        for s in range(24):
            slots = sorted(x[5] for x in got if x[3] == s)
            assert slots == list(range(len(slots)))
        assert all(x[3] == x[4] or x[4] == 24 for x in got)


def test_weighted_shards_get_their_share(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    n = {r["shard"]: r["count"] for r in sharding.assign(ids, [1.0, 2.0, 5.0]).groupBy("shard").count().collect()}
    assert [round(n[i] / 2500) for i in range(3)] == [1, 2, 5]


def test_sharding_of_an_empty_table(empty):
    assert sharding.assign(empty, [1.0]).count() == 0


def test_written_shards(docs, spark, tmp_path):
    sharding.write_shards(docs, [1.0] * 3, f"file://{tmp_path}/s")
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == docs.count() and set(back.columns) == {*docs.columns, "__shard"}


# ---- 9 ----


def test_near_duplicates(docs, rows, clashing):
    want = brute.near(pairs(rows))
    assert sum(x[2] > 0 for x in want) > 10
    for d in (docs, clashing):
        assert same(listed(jaccard.near_duplicates(d), "doc_id", "class_id", "n_links"), want)


def test_large_families_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    own = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(120)] = f"x{rng.randrange(9)}"
        own.append((i, " ".join(words)))
    got = jaccard.near_duplicates(spark.createDataFrame(own, "doc_id long, text string"))
    assert same(listed(got, "doc_id", "class_id", "n_links"), brute.near(own))


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_unlike_texts_in_a_bucket_lose_no_link(spark, monkeypatch, rounds):
    """Buckets of one value a band hold many unlike texts; hubs tell them apart and every link is found."""
    monkeypatch.setattr(jaccard, "HUB_ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "ROWS_A_BAND", 1)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 500)
    rng = random.Random(rounds)
    shared = [f"s{i}" for i in range(60)]
    own = []
    for family in range(6):
        words = shared + [f"f{family}x{i}" for i in range(50)]
        for _ in range(9):  # a chain of versions: the ends are no longer alike
            at = rng.randrange(60, 108)
            words = words[:at] + [f"v{rng.randrange(10**6)}", f"v{rng.randrange(10**6)}"] + words[at + 2 :]
            own.append((len(own), " ".join(words)))
    got = jaccard.near_duplicates(spark.createDataFrame(own, "doc_id long, text string"))
    want = brute.near(own)
    assert len({x[1] for x in want}) == 6 and same(listed(got, "doc_id", "class_id", "n_links"), want)


def test_keep_one(docs, rows, clashing):
    classes = [x for x, r in zip(brute.classes(pairs(rows)), rows, strict=True) if brute.shingles(r[1])]
    kept = jaccard.keep_one(clashing)
    assert kept.columns == clashing.columns
    got = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    full = [x for x in got if brute.shingles(x[1])]
    assert len(full) == len({x[3] for x in classes}) and {d for d, _ in full} == {x[1] for x in classes}
    assert same(list({x for x in got if not brute.shingles(x[1])}), list({x for x in pairs(rows) if not brute.shingles(x[1])}))


def test_near_duplicates_of_an_empty_table(empty):
    assert jaccard.near_duplicates(empty).count() == 0
    assert jaccard.keep_one(empty).count() == 0


def test_bands_reach_the_recall():
    n = jaccard.bands_for(0.8, 0.999, 6)
    assert 1 - (1 - 0.8**6) ** n >= 0.999 > 1 - (1 - 0.8**6) ** (n - 1)


# ---- 10 ----


def test_quality_counts(docs, rows, clashing):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for d in (docs, clashing):
        assert same(listed(quality.counts(d), "doc_id", *names), [(r[0], *brute.counts(r[1])) for r in rows])


def test_quality_posterior(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["the", "of", "river", "house", "and", "walked", "slowly"]) + str(rng.randrange(30)) * (rng.random() < 0.01) for _ in range(80)) + "." for _ in range(80)]
    bad = ["### *** $$$ " * 40 + "x" for _ in range(12)] + ["buy now " * 60 for _ in range(8)]
    own = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    got = {r["doc_id"]: r["posterior"] for r in quality.score(own).collect()}
    assert min(got[i] for i in range(80)) > max(got[i] for i in range(80, 100))


def test_em_finds_the_better_rule():
    rng = random.Random(5)
    votes = {}
    for _ in range(5000):
        y = rng.random() < 0.8
        row = tuple((1 if y else -1) * (1 if rng.random() < p else -1) * (rng.random() < 0.9) for p in (0.95, 0.7, 0.9))
        votes[row] = votes.get(row, 0) + 1
    odds, w = quality.fit(sorted(votes.items()))
    assert odds > 0 and w[0][1] > w[1][1] and w[0][-1] < w[1][-1] < 0


def test_quality_of_an_empty_table(empty):
    assert quality.score(empty).count() == 0


def test_fixture_has_the_hard_cases():
    assert any(r[0] is None for r in make_docs()) and any(r[1] is None for r in make_docs())
