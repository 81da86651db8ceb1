"""Benchmark decontamination by a positional inverted index over the training tokens.

The index is cut by documents: one row holds the postings of a block of documents (some megabytes of text), that is
every distinct token with the sorted list of its positions. It is stored as a table in the shared folder, so it is
built without a shuffle, no token's list meets in one task however frequent the token is, and a lost executor rebuilds
only its blocks. Searching is a map over the blocks: a phrase is looked up by intersecting offset-adjusted lists from
its rarest term in the block on. Benchmark phrases go to the blocks in parts of at most PART_WORDS words, a
proven bound for what is broadcast; a larger benchmark takes more passes over the index.

Tokens are compared by a 64-bit hash. Phrases never cross documents.

Defined results: a null or empty text has no words and no hits; a benchmark item without words matches nothing; a null
item id is written as ``null``; equal documents and equal items are all reported; an empty documents table gives no
rows, an empty benchmark no hits; only the id and text columns are read, whatever else the tables have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithwork.functions.storage import stored
from kithwork.llm import words as W

#: Words of a window of a benchmark item.
WINDOW = 13
#: Places that a search holds at once; the list of one term may be longer.
CANDIDATES = 1 << 20
#: Words of benchmark text that one pass broadcasts at most (24 bytes each); a single longer item goes alone.
PART_WORDS = 2_000_000
INDEX_SCHEMA = "doc_ids binary, null_ids binary, starts binary, terms binary, lists binary, positions binary"


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased ASCII letters, digits and all other characters' runs: (rows, hashes, first word of each row)."""
    starts, ends, rows = W.spans(data, offsets, W.ALNUM)
    hashed = W.hashes(data, starts, ends, W.LOWER)
    return rows, hashed, np.searchsorted(rows, np.arange(len(offsets)))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index of ``docs``: one row a block of documents, with a number of its own (``block``)."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, end, data, offsets in W.chunks(batch.column(1)):
                _, hashed, starts = _tokens(data, offsets)
                order = np.argsort(hashed, kind="stable").astype(np.uint32)
                ranked = hashed[order]
                heads = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
                own = ids.slice(first, end - first)
                row = [own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), own.is_null().to_numpy(zero_copy_only=False), starts.astype(np.uint32), ranked[heads], np.append(heads, len(ranked)).astype(np.uint32), order]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], names=INDEX_SCHEMA.replace(" binary", "").split(", "))

    narrow = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("body"))
    return stored(narrow.mapInArrow(blocks, INDEX_SCHEMA).withColumn("block", F.monotonically_increasing_id()), "token-index")


class Block:
    """One row of the index."""

    def __init__(self, row: dict[str, bytes]):
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.null_ids = np.frombuffer(row["null_ids"], bool)
        self.starts = np.frombuffer(row["starts"], np.uint32).astype(np.int64)  # first word of each document, and the end
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.lists = np.frombuffer(row["lists"], np.uint32).astype(np.int64)
        self.positions = np.frombuffer(row["positions"], np.uint32)

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """Number of each term in this block, -1 if it does not occur."""
        if not len(self.terms):
            return np.full(len(hashed), -1)
        at = np.minimum(np.searchsorted(self.terms, hashed), len(self.terms) - 1)
        return np.where(self.terms[at] == hashed, at, -1)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.lists[term] : self.lists[term + 1]].astype(np.int64)

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1

    def phrase(self, numbers: np.ndarray) -> np.ndarray:
        """Positions at which the terms ``numbers`` (of this block, none missing) follow each other in one document."""
        return np.concatenate([at for _, at in self.phrases(numbers[None, :])])

    def phrases(self, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, position) of every place of the phrases ``numbers`` [row, term], CANDIDATES places at a time, about.

        All phrases at once: each starts from its rarest term's list, moved by the term's offset, and keeps the places
        that the other terms' lists have too, the rarer ones first. Lists lie behind each other by term, so one sorted
        array of (term, position) serves to look in any of them.
        """
        n = len(self.positions)
        size = self.lists[numbers + 1] - self.lists[numbers]
        order = np.argsort(size, axis=1, kind="stable")
        rows = np.arange(len(numbers))
        rarest = numbers[rows, order[:, 0]]
        count = size[rows, order[:, 0]]
        listed = np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.lists)) * n + self.positions
        ahead = np.concatenate(([0], np.cumsum(count)))
        first = 0
        while first < len(rows):
            end = max(first + 1, int(np.searchsorted(ahead, ahead[first] + CANDIDATES, "right")) - 1)
            row = np.repeat(rows[first:end], count[first:end])
            place = np.arange(len(row)) - (ahead[row] - ahead[first])
            at = self.positions[self.lists[rarest[row]] + place].astype(np.int64) - order[row, 0]
            inside = (at >= 0) & (at + numbers.shape[1] <= n)
            row, at = row[inside], at[inside]
            for k in range(1, numbers.shape[1]):
                if not len(at):
                    break
                wanted = numbers[row, order[row, k]] * n + at + order[row, k]
                has = listed[np.minimum(np.searchsorted(listed, wanted), n - 1)] == wanted
                row, at = row[has], at[has]
            whole = self.document(at) == self.document(at + numbers.shape[1] - 1)
            yield row[whole], at[whole]
            first = end

    def near(self, numbers: np.ndarray, width: int) -> np.ndarray:
        """Documents (numbers in the block) with all terms, in any order, inside ``width`` consecutive words."""
        lists = [self.postings(n) for n in np.unique(numbers)]
        lists.sort(key=len)
        hit: set[int] = set()
        # every match has some rarest-term occurrence p; the other terms lie in a span of width words around it
        for p in lists[0]:
            doc = self.document(np.array([p]))[0]
            low, high = max(self.starts[doc], p - width + 1), min(self.starts[doc + 1], p + width)
            around = [x[np.searchsorted(x, low) : np.searchsorted(x, high)] for x in lists]
            if all(len(x) for x in around):
                merged = sorted((int(at), i) for i, x in enumerate(around) for at in x)
                seen, missing, left = [0] * len(lists), len(lists), 0
                for at, which in merged:
                    missing -= seen[which] == 0
                    seen[which] += 1
                    while not missing:
                        if at - merged[left][0] < width:
                            hit.add(int(doc))
                        seen[merged[left][1]] -= 1
                        missing += seen[merged[left][1]] == 0
                        left += 1
        return np.array(sorted(hit), np.int64)


def _parts(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str, np.ndarray]]]:
    """(id, token hashes) of the items, in lists of at most PART_WORDS words."""
    part: list[tuple[str, np.ndarray]] = []
    held = 0
    for row in items.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        body = np.frombuffer((row[1] or "").encode(), np.uint8)
        _, hashed, _ = _tokens(body, np.array([0, len(body)]))
        if part and held + len(hashed) > PART_WORDS:
            yield part
            part, held = [], 0
        if len(hashed):
            part.append(("null" if row[0] is None else row[0], hashed))
            held += len(hashed)
    if part:
        yield part


HIT_SCHEMA = "block long, doc int, doc_id long, n_words long, spans array<struct<first:int,last:int>>, items array<string>"
HIT_ARROW = pa.schema([("block", pa.int64()), ("doc", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("items", pa.list_(pa.string()))])


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, items (sorted ids of the items with a window that occurs), spans of words hit.

    Of several passes each is written to the shared folder and its broadcast given up before the next one starts; only
    the first has a row for every document, the others only for those that they hit.
    """
    context = index.sparkSession.sparkContext
    parts = _parts(items, item_id, text)
    part, following = next(parts, []), next(parts, None)
    shared = context.broadcast(part)
    rows = _pass(index, shared, window, True)
    if following is not None:
        found = None
        while part is not None:
            done = stored(rows, "hits")
            shared.unpersist(blocking=True)
            found = done if found is None else found.unionByName(done)
            part, following = following, next(parts, None)
            if part is not None:
                shared = context.broadcast(part)
                rows = _pass(index, shared, window, False)
        rows = found.groupBy("block", "doc").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    # spans are few and short lists: they are merged in order
    ordered = F.array_sort("spans")
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n"))
    hit = F.aggregate(ordered, zero, lambda a, x: F.struct(F.greatest(a["last"], x["last"]).alias("last"), (a["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(a["last"], x["first"] - 1))).alias("n")), lambda a: a["n"])
    return rows.select("doc_id", "n_words", hit.cast("long").alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), ordered.alias("spans"))


def _windows(part: list[tuple[str, np.ndarray]], window: int) -> tuple[np.ndarray, np.ndarray]:
    """The items' terms, joined, and (item, first, length) of each window in them."""
    if not part:
        return np.zeros(0, np.uint64), np.zeros((0, 3), np.int64)
    words = np.array([len(h) for _, h in part], np.int64)
    size = np.minimum(words, window)
    count = words - size + 1
    item = np.repeat(np.arange(len(part)), count)
    place = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    first = (np.cumsum(words) - words)[item] + place
    return np.concatenate([h for _, h in part]), np.stack([item, first, size[item]], 1)


def _pass(index: DataFrame, part, window: int, all_rows: bool) -> DataFrame:
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [name for name, _ in part.value]
        joined, table = _windows(part.value, window)
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):  # one block in memory at a time
                block = Block(row)
                n = len(block.doc_ids)
                spans: list[set[tuple[int, int]]] = [set() for _ in range(n)]
                items: list[set[str]] = [set() for _ in range(n)]
                numbers = block.find(joined)
                # windows with a term that the block lacks are passed over at once
                lacking = np.concatenate(([0], np.cumsum(numbers < 0)))
                alive = table[lacking[table[:, 1] + table[:, 2]] == lacking[table[:, 1]]]
                for size in np.unique(alive[:, 2]):
                    own = alive[alive[:, 2] == size]
                    for which, at in block.phrases(numbers[own[:, 1, None] + np.arange(size)]):
                        docs = block.document(at)
                        for doc, p, item in zip(docs.tolist(), (at - block.starts[docs]).tolist(), own[which, 0].tolist(), strict=True):
                            spans[doc].add((p, p + int(size) - 1))
                            items[doc].add(names[item])
                told = range(n) if all_rows else [d for d in range(n) if spans[d]]
                words = np.diff(block.starts).tolist()
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": [row["block"]] * len(told),
                        "doc": list(told),
                        "doc_id": [None if block.null_ids[d] else int(block.doc_ids[d]) for d in told],
                        "n_words": [words[d] for d in told],
                        "spans": [[{"first": a, "last": b} for a, b in spans[d]] for d in told],
                        "items": [list(items[d]) for d in told],
                    },
                    schema=HIT_ARROW,
                )

    return index.mapInArrow(look, HIT_SCHEMA)


def phrases(index: DataFrame, queries: list[str], width: int | None = None) -> DataFrame:
    """Documents with each query's words as a phrase, or, with ``width``, all inside that many consecutive words: query, doc_id."""
    hashed = []
    for q in queries:
        body = np.frombuffer(q.encode(), np.uint8)
        hashed.append(_tokens(body, np.array([0, len(body)]))[1])
    asked = index.sparkSession.sparkContext.broadcast(hashed)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):  # one block in memory at a time
                block = Block(row)
                out: list[tuple[int, int | None]] = []
                for k, terms in enumerate(asked.value):
                    numbers = block.find(terms)
                    if len(terms) and (numbers >= 0).all():
                        hit = block.near(numbers, width) if width else np.unique(block.document(block.phrase(numbers)))
                        out += [(k, None if block.null_ids[d] else int(block.doc_ids[d])) for d in hit]
                yield pa.RecordBatch.from_pydict({"query": [k for k, _ in out], "doc_id": [d for _, d in out]}, schema=pa.schema([("query", pa.int32()), ("doc_id", pa.int64())]))

    return index.mapInArrow(look, "query int, doc_id long").distinct()


def holds_window(window: int = WINDOW, spans: str = "spans"):
    """At least one whole window of ``window`` words is hit (an item of fewer words has none)."""
    return F.exists(spans, lambda s: s["last"] - s["first"] + 1 >= window)


def contaminated(n_hit="n_hit", n_words="n_words"):
    """At least one word hit, and hits make up a twentieth of all words or more."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
