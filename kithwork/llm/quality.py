"""Quality by weak supervision, with DataFrame functions only.

Every rule votes good (1), bad (-1) or abstains (0). Votes of all documents are counted by pattern (at most
3 ** len(RULES) of them, whatever the input's size); expectation-maximisation over that table estimates each rule's
accuracy and coverage in good and in bad documents, and a document's posterior probability of being good follows
from its votes. No document is filtered because a single rule says so.

Defined results: a null text counts as empty; a text without words has all counts 0 and fails the base rule; equal
rows get equal results; an empty table gives no rows; only doc_id and text are read, whatever else the table has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithwork.functions.storage import stored

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8  # a power of 2: windows are hashed by doubling
ROUNDS = 60

# Frequent short words of four languages, lower case.
FUNCTION_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "are", "with", "as", "be", "this",
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "que", "est", "pour", "qui", "dans", "par", "pas",
    "der", "die", "und", "das", "von", "zu", "mit", "den", "ist", "im", "nicht", "ein", "eine", "auf", "sich",
    "el", "los", "las", "y", "por", "con", "para", "una", "su", "al", "del", "se", "no",
]


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row a document with the counts that the rules use."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"))
    flat = F.translate("body", BLANKS, " " * len(BLANKS))
    rows = rows.select(
        "doc_id",
        "body",
        F.filter(F.split(flat, " "), lambda w: w != "").alias("words"),
        F.filter(F.split("body", "\n"), lambda x: F.translate(x, BLANKS, "") != "").alias("lines"),
    )
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("body", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate("body", "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÇÑÓÍ", "")).alias("not_upper"),
        F.length("body").alias("n_chars"),
        F.length(F.translate("body", "0123456789", "")).alias("not_digit"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(FUNCTION_WORDS))).cast("long").alias("n_function"),
        F.size(F.filter("words", lambda w: F.substring(w, -1, 1).isin(".", "!", "?"))).cast("long").alias("n_stops"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    rows = rows.withColumn("n_distinct_words", F.size(F.array_distinct("hashes")).cast("long"))
    # a window's hash by doubling: of two words, of four, of eight; the places behind the last window are cut off
    rows = rows.withColumn("windows", F.col("hashes")).drop("hashes")
    for step in (1, 2, 4):
        later = F.slice("windows", step + 1, F.greatest(F.lit(0), F.size("windows") - step))
        rows = rows.withColumn("windows", F.zip_with("windows", later, lambda x, y: F.xxhash64(x, y)))
    rows = rows.withColumn("windows", F.slice("windows", 1, F.greatest(F.lit(0), F.col("n_words").cast("int") - (WINDOW - 1))))
    # only documents with a repeat pay for the sort
    sorted_ = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("ordered", F.when(F.size("windows") > F.size(F.array_distinct("windows")), sorted_).otherwise(F.expr("CAST(array() AS array<struct<h:bigint,i:int>>)"))).drop("windows")
    near = lambda x, k: (F.get("ordered", k - 1)["h"] == x["h"]) | (F.get("ordered", k + 1)["h"] == x["h"])
    hit = F.filter(F.transform("ordered", lambda x, k: F.when(near(x, k), x["i"])), lambda i: i.isNotNull())
    return rows.withColumn("n_repeat_words", _covered(F.sort_array(hit)).cast("long")).drop("ordered")


def _covered(places: Column) -> Column:
    """Size of the union of [p, p + WINDOW) over rising places."""
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum"))
    return F.aggregate(
        places,
        zero,
        lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("sum")),
        lambda acc: acc["sum"],
    )


def _band(value: Column, bad_below: float | None = None, good_from: float | None = None, good_to: float | None = None, bad_above: float | None = None) -> Column:
    """-1 outside the bad limits, 1 inside the good ones, 0 between and for null."""
    bad = F.lit(False)
    if bad_below is not None:
        bad = bad | (value < bad_below)
    if bad_above is not None:
        bad = bad | (value > bad_above)
    good = F.lit(True)
    if good_from is not None:
        good = good & (value >= good_from)
    if good_to is not None:
        good = good & (value <= good_to)
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0).cast("int")


def rules() -> dict[str, Column]:
    """Votes over the columns of counts(); each rule looks at one property."""
    words, chars, lines = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("n_chars"), F.lit(0)), F.nullif(F.col("n_lines"), F.lit(0))
    long_enough = lambda c, n: F.when(F.col("n_words") >= n, c)
    return {
        "length": _band(F.col("n_words"), bad_below=12, good_from=25),
        "word_length": _band(F.col("word_chars") / words, 2.5, 3.2, 9.0, 11.0),
        "symbols": _band(F.col("n_symbols") / words, good_to=0.05, bad_above=0.2),
        "dup_lines": _band(F.when(F.col("n_lines") >= 3, F.col("n_dup_lines") / lines), good_to=0.1, bad_above=0.3),
        "repeats": _band(long_enough(F.col("n_repeat_words") / words, 16), good_to=0.1, bad_above=0.25),
        "variety": _band(long_enough(F.col("n_distinct_words") / F.pow(F.col("n_words"), F.lit(0.75)), 40), bad_below=0.6, good_from=1.0),
        "function_words": _band(long_enough(F.col("n_function") / words, 25), bad_below=0.03, good_from=0.08),
        "upper": _band((F.col("n_chars") - F.col("not_upper")) / chars, good_to=0.1, bad_above=0.3),
        "digits": _band((F.col("n_chars") - F.col("not_digit")) / chars, good_to=0.05, bad_above=0.2),
        "sentences": _band(long_enough(F.col("n_stops") / words, 25), bad_above=0.5, good_from=0.02, good_to=0.3),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """(log odds of good before votes, a weight by vote and rule) from votes and how many documents cast them.

    Each rule has a distribution over its three votes in good and in bad documents (so accuracy and coverage may
    differ between them). Start: a document is good in proportion to its good votes. Pseudo-counts tie a rule weakly to
    being right more often than wrong, so the two classes cannot change places.
    """
    if not patterns:
        return 0.0, [{-1: 0.0, 0: 0.0, 1: 0.0} for _ in rules()]
    n_rules = len(patterns[0][0])
    total = sum(n for _, n in patterns)
    # a start that trusts any bad vote: rules are written so that a bad vote is rare in good text
    good = [0.95 if min(v) >= 0 else 0.3 if v.count(-1) == 1 else 0.05 for v, _ in patterns]
    prior_n = 0.01 * total + 1.0
    weights: list[dict[int, float]] = []
    odds = 0.0
    for _ in range(rounds):
        mass = [sum(g * n for g, (_, n) in zip(good, patterns, strict=True)), 0.0]
        mass[1] = total - mass[0]
        odds = math.log((mass[0] + 0.7 * prior_n) / (mass[1] + 0.3 * prior_n))
        weights = []
        for r in range(n_rules):
            tally = {v: [0.0, 0.0] for v in (-1, 0, 1)}
            for g, (votes, n) in zip(good, patterns, strict=True):
                tally[votes[r]][0] += g * n
                tally[votes[r]][1] += (1 - g) * n
            lean = {-1: (0.05, 0.6), 0: (0.2, 0.2), 1: (0.75, 0.2)}
            p = {v: [(tally[v][k] + prior_n * lean[v][k]) / (mass[k] + prior_n) for k in (0, 1)] for v in tally}
            weights.append({v: math.log(p[v][0] / p[v][1]) for v in p})
            weights[-1][0] = 0.0  # an abstention says nothing
        logits = [odds + sum(weights[r][v] for r, v in enumerate(votes)) for votes, _ in patterns]
        good = [1 / (1 + math.exp(-max(-40.0, min(40.0, x)))) for x in logits]
    return odds, weights


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts, the votes (``vote_<rule>``) and ``posterior``, the probability that a document is good; one row a document."""
    voted = stored(counts(docs, doc_id, text).withColumns({f"vote_{k}": v for k, v in rules().items()}), "quality-votes")
    names = [f"vote_{k}" for k in rules()]
    table = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("__kw_n")).collect()  # 3 ** len(names) rows at most
    odds, weights = fit(sorted((tuple(r[n] for n in names), r["__kw_n"]) for r in table))
    logit = F.lit(odds)
    for name, w in zip(names, weights, strict=True):
        logit = logit + F.when(F.col(name) == 1, w[1]).when(F.col(name) == -1, w[-1]).otherwise(0.0)
    return voted.withColumn("posterior", 1 / (1 + F.exp(-logit)))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
