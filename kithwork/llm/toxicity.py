"""Toxicity by a weighted lexicon matched with Aho-Corasick, normalised by length, with exception phrases.

Folding: lower case; characters that look alike (Cyrillic, Greek, full width, digits and signs used as letters) become
one skeleton letter; everything that is no letter becomes a blank. Text and lexicon are folded alike.

The lexicon is learned from labelled documents: beginnings of words (with the blank before them) that mark toxic
documents beyond chance (a binomial bound over all candidates), the same word between the same neighbours counted once
so that copies do not add up, each weighted by its log odds. Exception phrases are words, alone or with a neighbour, that begin like an entry but are seen in clean
documents at least as often as chance; a match inside one does not count. A score is the logistic of
``a + b * log(sum of weights) - c * log(words)``, fitted on the same documents, so the weight is normalised by a power
of the length.

What is learned is fitted on at most ``2 * SAMPLE`` labelled documents (chosen by a hash of their id) and held by the
driver; every document is scored over its whole text. Log odds are corrected from the classes' shares in the sample to
those among all usable labels, so a score is a probability at every size.

Defined results: a null, empty or blank text has no match and gets the lowest score; labels that are null do not
count, of several labels of a document the highest counts; equal rows get equal scores; an empty table gives no rows;
without any toxic or clean label all scores are the share of toxic labels.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents of either class that the model is fitted on, at most.
SAMPLE = 2500
#: Characters of a labelled text that count towards the sample's bound; whole texts are used, those that would pass it are left out, but for one of a class that had none.
SAMPLE_CHARS = 12_000_000
THRESHOLD = 0.3
SHORTEST, LONGEST = 4, 14
MIN_SUPPORT, MIN_ODDS = 4, 2.0
CHANCE = 0.01
MAX_ENTRIES = 400

# Characters that stand for a Latin letter; i, l and 1 share one skeleton.
LOOKALIKES = {
    "l": "i", "1": "i", "ı": "i", "і": "i", "ӏ": "i", "ι": "i", "ⅼ": "i", "ⅰ": "i",
    "0": "o", "о": "o", "ο": "o", "օ": "o", "3": "e", "е": "e", "ε": "e", "ҽ": "e", "4": "a", "@": "a", "а": "a", "α": "a",
    "5": "s", "$": "s", "ѕ": "s", "7": "t", "т": "t", "τ": "t", "8": "b", "в": "b", "β": "b", "9": "g", "ɡ": "g",
    "с": "c", "ϲ": "c", "р": "p", "ρ": "p", "у": "y", "γ": "y", "х": "x", "χ": "x", "н": "h", "һ": "h", "м": "m",
    "к": "k", "κ": "k", "ԁ": "d", "ո": "n", "η": "n", "υ": "u", "ν": "v", "ѵ": "v", "ԝ": "w", "ω": "w", "ј": "j", "ԛ": "q", "ʀ": "r", "г": "r",
}
#: Characters without width, which part a word without being seen.
HIDDEN = "​‌‍⁠﻿­"

_table: dict[int, str | None] = {ord(c): None for c in HIDDEN}
_table |= {i: " " for i in range(128) if not chr(i).isalnum()}
_table |= {ord(c): " " for c in "   «»“”„‘’–—…·•¡¿"}
_table |= {0xFEE0 + i: chr(i).lower() for i in range(0x21, 0x7F) if chr(i).isalnum()}
_table |= {ord(k): v for k, v in LOOKALIKES.items()}


def fold(text: str) -> str:
    """The skeleton of ``text``, one blank at either end."""
    return f" {text.lower().translate(_table)} "


@dataclass
class Model:
    """A lexicon and how sums of its weights become scores."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    intercept: float = -3.0
    by_weight: float = 0.0
    by_length: float = 0.0
    base: float = 0.0

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            out.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            # a phrase that is an entry as well is an exception
            out.add_word(phrase, (len(phrase), None))
        if len(out):
            out.make_automaton()
        return out

    def weigh(self, automaton, folded: str) -> float:
        """Sum of the weights matched outside exception phrases; at each place only the longest entry counts."""
        if not len(automaton):
            return 0.0
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif start not in best or best[start][0] < size:
                best[start] = (size, weight)
        for start, end in spared:
            for at in [k for k in best if start <= k and k + best[k][0] - 2 <= end]:
                del best[at]
        return sum(w for _, w in best.values())

    def logit(self, weight: float, n_words: int) -> float:
        if weight <= 0:
            return self.base
        return self.intercept + self.by_weight * math.log1p(weight) - self.by_length * math.log1p(n_words)

    def score(self, automaton, text: str | None) -> float:
        folded = fold(text or "")
        x = self.logit(self.weigh(automaton, folded), len(folded.split()))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _places(folded: Iterable[str]) -> Counter:
    """How often each word occurs, the same neighbours counted once, so that copies do not add up."""
    out: Counter = Counter()
    seen: set[int] = set()
    for t in set(folded):
        words = t.split()
        for place in zip(["", *words], words, [*words[1:], ""], strict=False):
            if len(place[1]) >= SHORTEST and (h := hash(place)) not in seen:
                seen.add(h)
                out[place[1]] += 1
    return out


def _beginnings(words: Counter) -> Counter:
    """Counts of the words' beginnings, and of the whole words (with the blank behind them)."""
    out: Counter = Counter()
    for word, n in words.items():
        for k in range(SHORTEST, min(len(word), LONGEST) + 1):
            out[f" {word[:k]}"] += n
        out[f" {word} "] += n
    return out


def train(texts: list[str], toxic: list[int], exceptions: list[str] = (), shift: float = 0.0) -> Model:
    """A model from labelled texts; ``exceptions`` are phrases known to be harmless, ``shift`` is the log of the true odds of a toxic document over those among ``texts``."""
    folded = [fold(t or "") for t in texts]
    y = np.array(toxic)
    n_toxic, n_clean = int((y == 1).sum()), int((y == 0).sum())
    share = (n_toxic + 0.5) / (len(y) + 1) if len(y) else 0.0
    prior = math.log(share / (1 - share)) if 0 < share < 1 else -3.0
    if not n_toxic or not n_clean:
        return Model(base=prior, intercept=prior)
    places = [_places(t for t, k in zip(folded, toxic, strict=True) if k == c) for c in (0, 1)]
    counts = [_beginnings(x) for x in places]
    sums = [max(1, sum(x.values())) for x in places]
    share_of_places = sums[1] / (sums[0] + sums[1])
    candidates = [x for x, n in counts[1].items() if n >= MIN_SUPPORT]
    # evidence above log(candidates / CHANCE) is not expected by chance for any of them
    least = math.log(max(1, len(candidates)) / CHANCE)

    def evidence(x: str) -> float:
        pos, neg = counts[1][x], counts[0][x]
        q, p = pos / (pos + neg), share_of_places
        return 0.0 if q <= p else (pos + neg) * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))

    def odds(x: str) -> float:
        return math.log((counts[1][x] + 0.3) / sums[1]) - math.log((counts[0][x] + 0.3) / sums[0])

    scored = sorted(((evidence(x), -len(x), x) for x in candidates if odds(x) >= MIN_ODDS), reverse=True)
    weights: dict[str, float] = {}
    longer: Counter = Counter()
    longer_by_one: dict[str, list[str]] = defaultdict(list)
    for start in counts[1]:
        if start[-1] != " ":
            longer_by_one[start[:-1]].append(start)
    for value, _, x in scored:
        if value < least or len(weights) >= MAX_ENTRIES:
            break
        if x in weights or any(x[:k] in weights for k in range(SHORTEST + 1, len(x))):
            continue  # a shorter beginning says as much
        if longer[x] >= 0.7 * counts[1][x]:
            continue  # longer ones that are chosen say most of it
        # as long as nearly all its words go on alike: " path" stands for " pathetic" only
        while more := [z for z in longer_by_one[x] if counts[1][z] >= 0.9 * counts[1][x]]:
            x = more[0]
        weights[x] = odds(x)
        for k in range(SHORTEST + 1, len(x)):
            longer[x[:k]] += counts[1][x]
    # words and word pairs that hold an entry but are seen in clean documents
    phrases = [Counter(), Counter()]
    starts = tuple(weights)
    for t, k in zip(folded, toxic, strict=True):
        words, seen = t.split(), set()
        for i, w in enumerate(words):
            if f" {w} ".startswith(starts):
                seen |= {f" {w} "} | ({f" {words[i - 1]} {w} "} if i else set()) | ({f" {w} {words[i + 1]} "} if i + 1 < len(words) else set())
        phrases[k].update(seen)
    harmless = [p for p, n in phrases[0].items() if n >= 2 and n * n_toxic >= 2 * phrases[1][p] * n_clean and p not in weights]
    model = Model(weights, sorted({*harmless, *(fold(x) for x in exceptions)}), base=prior + shift)
    automaton = model.automaton()
    s = np.array([model.weigh(automaton, t) for t in folded])
    n = np.array([len(t.split()) for t in folded])
    hit = s > 0
    model.base = math.log((y[~hit].sum() + 0.5) / ((1 - y[~hit]).sum() + 0.5)) + shift
    if hit.any():
        x = np.stack([np.ones(hit.sum()), np.log1p(s[hit]), np.log1p(n[hit])], 1)
        beta, goal = np.zeros(3), y[hit].astype(float)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            ridge = np.diag([0.01, 0.1, 0.1])
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (goal - p) - ridge @ beta)
            beta = beta + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        model.intercept, model.by_weight, model.by_length = float(beta[0]) + shift, float(beta[1]), float(-beta[2])
    return model


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from the labelled documents that are not held out, ``sample`` of either class at most."""
    usable = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)").filter(~held_out(F.col("id")))
    one = usable.groupBy("id").agg(F.max("y").alias("y"))
    picks = [one.filter(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    picked = picks[0].unionByName(picks[1])  # 2 * sample rows at most, so it may be broadcast
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("body")).join(F.broadcast(picked), "id")
    rows = rows.groupBy("id", "y").agg(F.min("body").alias("body"))
    counts = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}
    texts, toxic, held = [], [], 0
    too_long: dict[int, str] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").toLocalIterator():
        if held + len(r["body"] or "") > SAMPLE_CHARS:
            too_long.setdefault(r["y"], r["body"])
            continue
        held += len(r["body"] or "")
        texts.append(r["body"] or "")
        toxic.append(r["y"])
    for y, body in too_long.items():
        if y not in toxic:  # a class is never lost to the bound
            texts.append(body)
            toxic.append(y)
    return train(texts, toxic, shift=_shift(counts, sample))


def _shift(labels: dict[int, int], sample: int) -> float:
    """Log of the odds of a toxic label among all ``labels`` (by class) over those in a sample of ``sample`` of either class at most."""
    if len(labels) < 2:
        return 0.0
    clean, toxic = (labels[k] / max(1, min(labels[k], sample)) for k in (0, 1))
    return math.log(toxic / clean)


def score(docs: DataFrame, model: Model, columns: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """``columns`` of ``docs`` and ``out``: the probability that the whole text is toxic."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        automaton = own.automaton()
        for batch in batches:
            yield pa.array([own.score(automaton, x.as_py()) for x in batch], pa.float64())

    judge.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    rate = F.arrow_udf(judge, "double")
    return docs.select(*columns, rate(F.col(text)).alias(out))

