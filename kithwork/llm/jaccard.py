"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

1. Every document's set of SHINGLE-word sequences (white-space words, unchanged) gets MinHash values, grouped into
   bands. ``bands_for`` chooses the number of bands so that a pair at the threshold shares a band with the target
   recall. Documents with equal sets are one class at once, so copies are never joined with each other.
2. Classes are shuffled on band hashes. In every bucket the least class is the hub and is compared with the others on
   full sets, never all with all. Distances of sets obey the triangle inequality: what is linked to a class that is
   linked to the hub lies within twice the distance of a link. So classes within that are joined to the hub's family,
   classes linked to the hub are done with this bucket, and the others try again without it. After HUB_ROUNDS rounds the
   buckets left are joined unseen. Chance collisions of unlike texts thus do not make families.
3. Families are verified on full sets, a block of classes (some BLOCK of them, some BLOCK_SHINGLES in all) against
   another at a time: a task holds two blocks and counts common shingles by a matrix product, so every pair in a family
   is decided exactly while only counts of links and a spanning forest leave the task. A family of any size is split
   over tasks.
4. Components of the verified links are the near-duplicate classes.

Shingles are compared by a 64-bit hash, sets by 128 bits.

Defined results: a text of one to SHINGLE - 1 words has one shingle, all its words; a null or blank text has none and
is linked to nothing, its class is its own id; equal rows are separate documents linked to each other; a class id is
the least id in it that is not null; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithwork.functions.storage import discard, stored
from kithwork.llm import words as W
from kithwork.operators.components import components

SHINGLE = 5
#: The threshold as a fraction, so that it is tested in whole numbers.
THRESHOLD = (4, 5)
ROWS_A_BAND = 6
RECALL = 0.99999
#: Rounds in which hubs are compared before buckets are joined unseen; one tells the usual bucket of two apart.
HUB_ROUNDS = 1
#: Classes a block of a family should have, and shingles (8 bytes each); a longer text is a block of its own.
BLOCK, BLOCK_SHINGLES = 96, 1 << 18
#: Columns of the 0/1 matrix that a task holds at once.
COLUMNS = 8192


def bands_for(threshold: float, recall: float = RECALL, rows: int = ROWS_A_BAND) -> int:
    """Bands of ``rows`` values at which a pair of similarity ``threshold`` shares one with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, by row and then hash."""
    starts, ends, rows = W.spans(data, offsets, W.SOLID)
    words = W.hashes(data, starts, ends)
    at = np.flatnonzero(W.whole(rows, size))
    row, found = rows[at], W.sequences(words, size)[at] if len(at) else np.zeros(0, np.uint64)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.searchsorted(rows, short)
        # the words of a short text as one shingle; its length keeps it apart from longer ones
        own = [W.sequences(words[a : a + n], n)[0] ^ np.uint64(n) for a, n in zip(first, counts[short], strict=True)]
        row, found = np.concatenate((row, short)), np.concatenate((found, np.array(own, np.uint64)))
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (found[1:] != found[:-1]))) if len(row) else np.zeros(0, bool)
    return row[new], found[new]


def _signatures(rows: DataFrame, bands: int, per_band: int, size: int) -> DataFrame:
    """(key, id, set1, set2, n, bands) for ``rows`` (key, id, body)."""
    rng = np.random.default_rng(977)
    a, b = (rng.integers(0, 1 << 31, bands * per_band, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))
    mult = rng.integers(0, 1 << 62, per_band, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in W.chunks(batch.column(2)):
                row, found = shingles(data, offsets, size)
                n = np.bincount(row, minlength=end - first)
                full = np.flatnonzero(n)
                heads = np.searchsorted(row, full)
                banded = np.zeros((len(full), bands), np.uint64)
                set1, set2 = np.zeros(end - first, np.uint64), np.zeros(end - first, np.uint64)
                if len(full):
                    set1[full] = np.add.reduceat(W.mixed(found ^ np.uint64(0x1B873593)), heads)
                    set2[full] = np.add.reduceat(W.mixed(found ^ np.uint64(0x85EBCA6B)), heads)
                    x, y = (found >> np.uint64(32)).astype(np.uint32), found.astype(np.uint32)
                    for band in range(bands):
                        for k in range(per_band):
                            j = band * per_band + k
                            banded[:, band] += np.minimum.reduceat(a[j] * x + b[j] * y, heads).astype(np.uint64) * mult[k]
                    banded = W.mixed(banded + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum((n > 0) * bands))).astype(np.int32)), pa.array(banded.ravel().view(np.int64)))
                arrays = [batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), pa.array(set1.view(np.int64)), pa.array(set2.view(np.int64)), pa.array(n.astype(np.int32)), lists]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "id", "set1", "set2", "n", "bands"])

    return rows.mapInArrow(sign, "key long, id long, set1 long, set2 long, n int, bands array<long>")


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """(node, sets) with the shingles of ``rows`` (node, body) as bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in W.chunks(batch.column(1)):
                row, found = shingles(data, offsets, size)
                cuts = np.searchsorted(row, np.arange(end - first + 1))
                sets = pa.array([found[p:q].tobytes() for p, q in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), sets], names=["node", "sets"])

    return rows.select("node", "body").mapInArrow(cut, "node long, sets binary")


def _measure(edges: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """``edges`` (hub, node) with ``near`` (within twice the distance of a link) and ``linked``, by full ``sets`` (node, sets)."""
    a, b = threshold
    parts = edges.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    members = edges.join(parts, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), "node")
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("hub").alias("node"))
    both = hubs.unionByName(members).join(sets, "node").select("hub", "part", "side", "node", "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            hub, side, node = (batch.column(i).to_numpy() for i in (0, 2, 3))
            near, linked = np.zeros(len(hub), bool), np.zeros(len(hub), bool)
            for i in range(len(hub)):
                found = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint64)
                if side[i] == 0:
                    own = found.copy()
                    continue
                if len(found):
                    at = np.minimum(np.searchsorted(own, found), len(own) - 1)
                    both = int((own[at] == found).sum())
                    union = len(own) + len(found) - both
                    near[i], linked[i] = both * b >= (2 * a - b) * union, both * b >= a * union
            kept = side == 1
            yield pa.RecordBatch.from_arrays([pa.array(hub[kept]), pa.array(node[kept]), pa.array(near[kept]), pa.array(linked[kept])], names=["hub", "node", "near", "linked"])

    return both.repartition("hub", "part").sortWithinPartitions("hub", "part", "side").mapInArrow(compare, "hub long, node long, near boolean, linked boolean")


def _family_edges(open_: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> tuple[DataFrame, list[DataFrame]]:
    """((src, dst) that hold together all that may be linked, tables they are read from); ``open_`` (band, node) are buckets of two nodes or more."""
    found, held = open_.sparkSession.createDataFrame([], "src long, dst long"), [open_]
    for _ in range(HUB_ROUNDS):
        # written first and merged, so that a large bucket can be split
        hubs = stored(open_.groupBy("band").agg(F.min("node").alias("hub")), "hubs")
        rest = stored(open_.join(hubs.hint("merge"), "band").filter("node <> hub"), "buckets")
        measured = stored(_measure(rest.select("hub", "node").distinct(), sets, threshold), "measured")
        part = measured.filter("near").select(F.col("hub").alias("src"), F.col("node").alias("dst"))
        found = found.unionByName(part)
        held += [hubs, rest, measured]
        rest = rest.join(measured.filter("linked"), ["hub", "node"], "left_anti").select("band", "node")
        more = stored(rest.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band"), "hubs")
        held.append(more)
        open_ = stored(rest.join(more.hint("merge"), "band", "left_semi"), "buckets")
        held.append(open_)
        if open_.isEmpty():
            return found, held
    hubs = stored(open_.groupBy("band").agg(F.min("node").alias("hub")), "hubs")
    held.append(hubs)
    # a node's hubs (one a band at most) hang together through it: the least of them takes the others and the node, which
    # leaves about one edge a node instead of one for each of its bands
    own = open_.join(hubs.hint("merge"), "band").groupBy("node").agg(F.collect_set("hub").alias("hubs"))
    chains = own.select(F.array_min("hubs").alias("src"), F.explode(F.array_union("hubs", F.array("node"))).alias("dst"))
    return found.unionByName(chains.filter("src <> dst")), held


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common shingles of each two sets."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        p, q = np.searchsorted(column, (low, low + COLUMNS))
        part = np.zeros((n, COLUMNS), np.float32)
        part[owner[p:q], column[p:q] - low] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _decide(nodes: np.ndarray, weights: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, least node joined to it here, weight of its links here) for one block against another or itself."""
    sizes = np.array([len(s) for s in sets])
    both = _common(sets)
    linked = both * threshold[1] >= threshold[0] * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(linked, False)
    if (sides != sides[0]).any():
        linked &= sides[:, None] != sides[None, :]
    got = linked @ weights
    # least label by repeated spreading; a block has few nodes
    label = np.argsort(np.argsort(nodes))
    while True:
        spread = np.where(linked, label[None, :], label[:, None]).min(1, initial=len(label))
        spread = np.minimum(spread, label)
        if (spread == label).all():
            break
        label = spread
    hit = np.flatnonzero(linked.any(1))
    return nodes[hit], np.sort(nodes)[label[hit]], got[hit]


def _verify(pairs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(node, root, weight) of the linked nodes of each two blocks; ``pairs``: family, low, high, side, node, weight, sets."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 1 and (now[1] == now[2] or len({x[1] for x in held.values()}) > 1):
                rows = list(held.items())
                out = _decide(np.array([k for k, _ in rows], np.int64), np.array([x[0] for _, x in rows], np.int64), np.array([x[1] for _, x in rows]), [np.frombuffer(x[2], np.uint64) for _, x in rows], threshold)
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["node", "root", "weight"])

        for batch in batches:
            family, low, high, side, node, weight = (batch.column(i).to_pylist() for i in range(6))
            for i in range(batch.num_rows):
                key = (family[i], low[i], high[i])
                if key != now:
                    yield from flush()
                    now, held = key, {}
                held[node[i]] = (weight[i], side[i], batch.column(6)[i].as_py())  # rows that share a key are one class
        yield from flush()

    names = ["family", "low", "high"]
    return pairs.repartition(*names).sortWithinPartitions(*names).mapInArrow(decide, "node long, root long, weight long")


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, row_key (hash of id and text), class_node (null if the text has no words), class_id, n_links (other documents at the threshold or above)."""
    bands = bands_for(threshold[0] / threshold[1], recall)
    rows = docs.select(F.xxhash64(doc_id, text).alias("key"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("body"))
    signed = _signatures(rows, bands, ROWS_A_BAND, size)
    signed = stored(signed.withColumn("node", F.when(F.col("n") > 0, F.xxhash64("set1", "set2", "n"))).drop("set1", "set2"), "signatures")
    classes = signed.filter("n > 0").groupBy("node").agg(F.min("key").alias("key"), F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes, "classes")

    dealt = classes.select("node", F.explode("bands").alias("band"))
    shared = dealt.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("band")
    buckets = stored(dealt.join(shared.hint("merge"), "band").select("band", "node"), "buckets")
    # texts are fetched once, for classes that share a bucket with another
    wanted = classes.select("node", "key").join(buckets.select("node").distinct(), "node", "left_semi")
    sets = stored(_sets(rows.join(wanted.hint("merge"), "key").dropDuplicates(["key"]), size), "sets")
    edges, held = _family_edges(buckets, sets, threshold)
    families = components(edges.distinct()).withColumnRenamed("component", "family")

    members = stored(families.join(classes.select("node", "weight", "n"), "node"), "members")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy("family").agg(blocks.alias("blocks"))
    placed = members.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64(F.col("node")), F.col("blocks")).cast("int")).join(sets, "node")
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = other.select("family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.col("block").alias("side"), "node", "weight", "sets")
    links = stored(_verify(pairs, threshold), "links")
    discard(sets, members, *held)

    joined = components(links.filter("node <> root").select(F.col("root").alias("src"), F.col("node").alias("dst")).distinct())
    counted = links.groupBy("node").agg(F.sum("weight").alias("links"))
    nodes = classes.select("node", "id", "weight").join(counted, "node", "left").join(joined, "node", "left")
    nodes = all_nodes = stored(nodes.select("node", "id", F.coalesce("component", "node").alias("class_node"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "nodes")
    discard(classes, links)
    named = nodes.groupBy("class_node").agg(F.min("id").alias("class_id"))
    nodes = nodes.join(named, "class_node").select("node", "class_node", "class_id", "n_links")
    found = signed.select(F.col("id").alias("doc_id"), F.col("key").alias("row_key"), "node").join(nodes, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    out = found.select("doc_id", "row_key", "class_node", own.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out._read_from = (signed, all_nodes)
    return out


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate class (the least id) and all without words; columns unchanged."""
    found = near_duplicates(docs, doc_id=doc_id, text=text)
    per_key = found.filter("class_node IS NOT NULL").groupBy("class_node", "row_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("times"))
    first = per_key.groupBy("class_node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key", "times")).alias("least"))
    empty = found.filter("class_node IS NULL").groupBy("row_key").agg(F.lit(1).cast("long").alias("times"))
    keys = first.select(F.col("least.row_key").alias("__kw_key"), F.col("least.times").alias("__kw_times")).unionByName(empty.select(F.col("row_key").alias("__kw_key"), F.col("times").alias("__kw_times")))
    keys = stored(keys, "kept")
    discard(*found._read_from)
    # the keys grow with the documents, so they are never broadcast: the plan is the same at every size
    kept = docs.withColumn("__kw_key", F.xxhash64(doc_id, text)).join(keys.hint("merge"), "__kw_key")
    # rows alike in id and text: only these need another shuffle
    single = kept.filter("__kw_times = 1")
    return single.unionByName(kept.filter("__kw_times > 1").dropDuplicates(["__kw_key"])).drop("__kw_key", "__kw_times").select(*docs.columns)
