"""Plain versions of the operators, written for clarity and small tables only."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def decontaminate(docs, items, window=13):
    """{row: (n_words, n_hit, items)}"""
    grams = defaultdict(set)
    for item, text in items:
        w = TOKEN.findall(lower(text or ""))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            grams[tuple(w[i : i + size])].add("null" if item is None else str(item))
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        w = TOKEN.findall(lower(text or ""))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                g = tuple(w[i : i + size])
                if g in grams:
                    hit.update(range(i, i + size))
                    found |= grams[g]
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


def holds_window(text, items, window=13):
    """Whether a window of an item of at least that many words occurs in ``text``."""
    grams = set()
    for _, t in items:
        w = TOKEN.findall(lower(t or ""))
        grams |= {tuple(w[i : i + window]) for i in range(len(w) - window + 1)}
    w = TOKEN.findall(lower(text or ""))
    return any(tuple(w[i : i + window]) in grams for i in range(len(w) - window + 1))


def drop_lines(docs, least=10):
    holders = defaultdict(set)
    key = lambda x: lower(x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    big = float("inf")
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(big if doc is None else doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        own = big if doc is None else doc
        kept = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < 2 or min(holders[key(x)]) == own]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def drop_windows(docs, window=35):
    seen = defaultdict(list)
    rows = [(doc, WORD.findall(text or "")) for doc, text in docs]
    for k, (_, w) in enumerate(rows):
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])].append((k, i))
    gone = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k].update(range(i, i + window))
    return [(doc, len(w), len(gone[k]), sha(" ".join(x for i, x in enumerate(w) if i not in gone[k]))) for k, (doc, w) in enumerate(rows)]


def shingles(text, size=5):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near(docs):
    """[(doc, class, links)]"""
    return [x[:3] for x in classes(docs)]


def classes(docs):
    """[(doc, class, links, least row of the class)]"""
    sets = [shingles(t) for _, t in docs]
    links = defaultdict(set)
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a].add(b)
                links[b].add(a)
    out = []
    for a, (doc, _) in enumerate(docs):
        seen, todo = {a}, [a]
        while todo:
            for w in links[todo.pop()]:
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        ids = [docs[v][0] for v in seen if docs[v][0] is not None]
        out.append((doc, min(ids) if ids else None, len(links[a]), min(seen)))
    return out


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    again = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def _hash(value, seed):
    return xxhash.xxh64_intdigest(struct.pack("<q", value), seed)


def shard(doc_id, n):
    import math

    base = 42 if doc_id is None else _hash(doc_id, 42)
    signed = base - (1 << 64) if base >= 1 << 63 else base
    best = None
    for i in range(n):
        h = _hash(i, _hash(signed, 42))
        value = -1.0 / math.log(((h >> 11) + 0.5) / 2**53)
        if best is None or value > best[0]:
            best = (value, i)
    return best[1]


def crc(text):
    return zlib.crc32((text or "").encode())
