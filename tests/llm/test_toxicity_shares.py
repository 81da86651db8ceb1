"""Scores mean the same whether all labelled documents are learned from or a sample of either class."""

import random

from kithwork.llm import toxicity


def test_a_sample_of_either_class_keeps_the_true_odds(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("aeioubcdfgt") for _ in range(6)) for _ in range(300)]
    rows = []
    for i in range(1600):
        toxic = i % 16 == 0
        words = [rng.choice(vocab) for _ in range(30)]
        if toxic and i % 32 == 0:
            words[rng.randrange(30)] = rng.choice(["zzvile", "zzviler", "zzvilest"])
        rows.append((i, " ".join(words), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    whole, part = (toxicity.fit(table, table, sample=n) for n in (10_000, 80))
    assert any(x.startswith(" zzvi") for x in part.weights)
    assert abs(whole.base - part.base) < 0.6
    score = part.score(part.automaton(), " ".join(vocab[:30]))
    assert score < toxicity.THRESHOLD / 2


def test_a_text_that_does_not_fit_the_sample_is_passed_over(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 3000)
    docs = [(i, f"plain words number {i} of many " + ("you blatherskite" if i % 4 == 0 else "and more")) for i in range(200)]
    docs += [(1000 + i, "long " * 5000) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000 and i % 4 == 0)) for i, _ in docs], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, shift=0.0: seen.append((texts, toxic)))
    toxicity.fit(frame, labels)
    texts, toxic = seen[0]
    assert set(toxic) == {0, 1} and len(texts) > 30 and sum(map(len, texts)) <= 3000


def test_weights_against_a_plain_matcher():
    """At each place the longest entry counts, unless all of it lies in an exception phrase."""
    rng = random.Random(3)
    letters = "ab "
    for _ in range(300):
        entries = {" " + "".join(rng.choice("ab") for _ in range(rng.randint(1, 3))): float(rng.randint(1, 9)) for _ in range(4)}
        exceptions = sorted({f" {''.join(rng.choice(letters) for _ in range(rng.randint(1, 5))).strip() or 'a'} " for _ in range(2)} - set(entries))
        model = toxicity.Model(entries, exceptions)
        text = f" {''.join(rng.choice(letters) for _ in range(30))} "
        want = 0.0
        spared = [(i, i + len(p)) for p in exceptions for i in range(len(text)) if text.startswith(p, i)]
        for i in range(len(text)):
            longest = max((e for e in entries if text.startswith(e, i)), key=len, default=None)
            # the blank behind a word may be missing from the phrase's match
            if longest and not any(a <= i and i + len(longest) - 1 <= b - 1 + 1 and i + len(longest) - 2 <= b - 1 for a, b in spared):
                want += entries[longest]
        assert model.weigh(model.automaton(), text) == want, (entries, exceptions, text)
