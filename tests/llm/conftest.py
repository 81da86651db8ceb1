import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(seed=3, n=60):
    """Documents with copies, near copies, shared lines and passages, nulls, blanks, ties and very long texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeioubcdfgé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, line = say(70), say(6)
    texts = []
    for i in range(n):
        kind = i % 6
        body = "\n".join(say(rng.randint(1, 60)) for _ in range(rng.randint(1, 5)))
        if kind == 1 and texts:
            body = rng.choice(texts) or ""
        elif kind == 2 and texts:
            words = (rng.choice(texts) or "").split(" ")
            words[rng.randrange(len(words))] = "changed"
            body = " ".join(words)
        elif kind == 3:
            body = f"{body}\n  {line.upper()}\t\n{body.split(chr(10))[0]}"
        elif kind == 4:
            body = f"{say(9)} {passage} {body}"
        texts.append(body)
    rows = [(i, t, "en", f"s{i % 4}" if i % 3 else "s0", len(t)) for i, t in enumerate(texts)]
    rows += [
        (1000, None, None, None, None), (1001, "", "en", "s1", 0), (1002, " \n\t ", "en", None, 4), (1003, "one two three", "en", "s9", 13), (1004, "one two three", "en", "s9", 13),
        (None, "no id " + passage, "en", "s2", None), (None, None, None, None, None), (1005, "word " * 9000, "en", "s3", None), (1006, "x" * 120_000, "en", "s3", None),
        (1007, "\n".join([line] * 4), "fr", "s1", 1), (1007, "\n".join([line] * 4), "fr", "s1", 1), (1007, "another text of the same id " + line, "fr", "s1", 1), (1008, "tab\tand  blanks \x0b \x0c here", "en", "s1", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, rows):
    """The same documents with extra columns named like what the operators make."""
    from pyspark.sql import functions as F

    names = ["score", "size", "shard", "slot", "key", "node", "body", "id", "words", "part", "taken", "h", "print", "n", "block", "kept"]
    return spark.createDataFrame(rows, SCHEMA).withColumns({x: F.lit("clash") for x in names})


def listed(df, *columns):
    """Rows as sorted tuples; nulls first."""
    out = [tuple(r[c] for c in columns) for r in df.collect()]
    return sorted(out, key=lambda t: [(x is not None, x) for x in t])


def same(a, b):
    order = lambda t: [(x is not None, x) for x in t]
    return sorted(a, key=order) == sorted(b, key=order)
