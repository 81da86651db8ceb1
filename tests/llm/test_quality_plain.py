"""Posteriors against expectation-maximisation written out document by document."""

import math
import random

import pytest

from kithwork.llm import quality


def plain_posteriors(votes, rounds=quality.ROUNDS):
    """One probability a document; ``votes``: a list of votes a document."""
    n, rules = len(votes), len(votes[0])
    good = [0.95 if min(v) >= 0 else 0.3 if sum(x < 0 for x in v) == 1 else 0.05 for v in votes]
    weak = 0.01 * n + 1.0  # pseudo-documents behind every share
    lean = {-1: (0.05, 0.6), 0: (0.2, 0.2), 1: (0.75, 0.2)}
    for _ in range(rounds):
        n_good = math.fsum(good)
        prior = (n_good + 0.7 * weak) / (n - n_good + 0.3 * weak)
        ratio = []
        for r in range(rules):
            own = {}
            for vote in (-1, 1):
                in_good = math.fsum(g for g, v in zip(good, votes, strict=True) if v[r] == vote)
                in_bad = math.fsum(1 - g for g, v in zip(good, votes, strict=True) if v[r] == vote)
                own[vote] = ((in_good + weak * lean[vote][0]) / (n_good + weak)) / ((in_bad + weak * lean[vote][1]) / (n - n_good + weak))
            own[0] = 1.0
            ratio.append(own)
        good = []
        for v in votes:
            odds = prior * math.prod(ratio[r][x] for r, x in enumerate(v))
            good.append(odds / (1 + odds))
    return good


@pytest.fixture(scope="module")
def scored(spark, docs):
    rng = random.Random(8)
    more = [(5000 + i, " ".join(rng.choice(["the", "of", "river", "house", "and", "Walked.", "###", "77"]) for _ in range(rng.randint(3, 90))), "en", "s", 1) for i in range(120)]
    return quality.score(docs.unionByName(spark.createDataFrame(more, docs.schema))).collect()


def test_posteriors(scored):
    names = [f"vote_{k}" for k in quality.rules()]
    want = plain_posteriors([[r[n] for n in names] for r in scored])
    assert len({round(p, 3) for p in want}) > 5
    assert all(abs(r["posterior"] - p) < 1e-6 for r, p in zip(scored, want, strict=True))


def test_votes(scored):
    """Four rules recomputed from the counts."""
    for r in scored:
        words = r["n_words"]
        assert r["vote_length"] == (-1 if words < 12 else 1 if words >= 25 else 0)
        share = r["n_symbols"] / words if words else None
        assert r["vote_symbols"] == (0 if share is None else -1 if share > 0.2 else 1 if share <= 0.05 else 0)
        again = r["n_repeat_words"] / words if words >= 16 else None
        assert r["vote_repeats"] == (0 if again is None else -1 if again > 0.25 else 1 if again <= 0.1 else 0)
        known = r["n_function"] / words if words >= 25 else None
        assert r["vote_function_words"] == (0 if known is None else -1 if known < 0.03 else 1 if known >= 0.08 else 0)


def test_a_very_long_text(spark):
    """Counts of 200 000 words, with a passage that comes twice."""
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**9)}" for _ in range(200_000)]
    words[150_000:150_030] = words[1000:1030]
    row = quality.score(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert (row["n_words"], row["n_repeat_words"], row["n_dup_lines"]) == (200_000, 60, 0)
