"""Line dedup through a sharded minimal perfect hash.

1. Every line's key (blanks stripped at both ends, A-Z lowered) is hashed once, over its bytes, to 64 bits and 32 more.
   Document, line number and hashes are written to the shared folder; all later steps read that narrow table.
2. Hashes are grouped, with partial sums before the shuffle: how often, and the least and greatest document holding
   the line. Distinct line hashes are dealt to shards of some SHARD_KEYS keys. A shard builds a minimal perfect hash
   (levels of bit arrays in which a key alone at its bit stays, the others go one level down) that indexes compact
   arrays: a fingerprint, a count, and the first document.
3. Documents probe: their hashes go to the shards in packets, never the lines, and a shard answers from its arrays only
   for line numbers that a document must drop. A shard that many probes go to (a line in a third of all documents) is
   copied to as many tasks as its counts ask for. Equal rows probe and are answered once.

Defined results: a null or empty text is one empty line; keys shorter than the minimum are always kept; a line found
only in one document stays however often; rows that share an id are one document; a null id comes after all others, so
such rows lose a line that any other document holds, and among themselves count as one document; an empty table gives
no rows; only the id and text columns are read, whatever else the table has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithwork.functions.storage import discard, stored
from kithwork.llm.words import mixed

MIN_CHARS = 10
#: Distinct lines of a shard, about.
SHARD_KEYS = 200_000
MAX_SHARDS = 1 << 16
#: Probes that one copy of a shard should answer.
COPY_PROBES = 500_000
#: Lines that a task holds before it sends them on.
BUFFER = 1 << 18
#: Bits of a level for each key that reaches it; levels before the rest goes to a sorted list.
GAMMA, LEVELS = 2, 24
#: Stands for a null id; greater than any other.
NO_ID = (1 << 63) - 1


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: each key to a number below their count."""

    def __init__(self, levels: list[np.ndarray], sizes: np.ndarray, rest: np.ndarray):
        self.levels, self.sizes, self.rest = levels, sizes, rest
        # set bits before each 8-byte word of all levels
        self.ranks, before = [], 0
        for bits in levels:
            ones = np.bitwise_count(bits.view(np.uint64)).astype(np.int64)
            self.ranks.append(before + np.concatenate(([0], np.cumsum(ones)[:-1])))
            before += int(ones.sum())
        self.n = before + len(rest)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels, sizes = keys, [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-GAMMA * len(left) // 64) * 64
            place = cls._place(left, level, size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            left = left[~alone[place]]
        return cls(levels, np.array(sizes, np.int64), np.sort(left))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """A number for each key; keys that were not built in get any number, or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, ranks, size) in enumerate(zip(self.levels, self.ranks, self.sizes, strict=True)):
            place = self._place(keys[open_], level, int(size))
            word = bits.view(np.uint64)[place >> 6]
            low = (place & 63).astype(np.uint64)
            hit = (word >> low) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (ranks[place >> 6] + below)[hit]
            open_ = open_[~hit]
            if not len(open_):
                return out
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            found = self.rest[at] == keys[open_]
            out[open_[found]] = self.n - len(self.rest) + at[found]
        return out

    def pack(self) -> list[bytes]:
        return [np.concatenate(self.levels).tobytes() if self.levels else b"", self.sizes.tobytes(), self.rest.tobytes()]

    @classmethod
    def unpack(cls, levels: bytes, sizes: bytes, rest: bytes) -> PerfectHash:
        size = np.frombuffer(sizes, np.int64)
        cuts = np.concatenate(([0], np.cumsum(size // 8)))
        flat = np.frombuffer(levels, np.uint8)
        return cls([flat[a:b].copy() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], size, np.frombuffer(rest, np.uint64))


KEY_SCHEMA = "key long, id long, line int, h long, print int"
INDEX_SCHEMA = "shard int, probes long, levels binary, sizes binary, rest binary, prints binary, counts binary, firsts binary"
BLOBS = [f"blob{i}" for i in range(6)]
PACKET_SCHEMA = "shard int, copy int, kind int, " + ", ".join(f"{x} binary" for x in BLOBS)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, id, body): ``key`` tells rows apart that differ in id or text, ``id`` is NO_ID for null."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("body"))


def line_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The stored table (key, id, line, h, print): hashes of every line long enough to be dropped."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        rows: list[int] = []
        lines: list[int] = []
        found: list[bytes] = []

        def flush(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            at = np.array(rows, np.int64)
            both = np.frombuffer(b"".join(found), np.dtype([("h", "<i8"), ("print", "<i4"), ("rest", "<i4")]))
            arrays = [pa.array(keys[at]), pa.array(ids[at]), pa.array(np.array(lines, np.int32)), pa.array(both["h"].copy()), pa.array(both["print"].copy())]
            for held in (rows, lines, found):
                held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["key", "id", "line", "h", "print"])

        for batch in batches:
            keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, body in enumerate(batch.column(2)):
                if not body.is_valid:
                    continue
                for number, line in enumerate(body.as_buffer().to_pybytes().split(b"\n")):
                    line = line.strip()  # of bytes: exactly the six ASCII blanks
                    if len(line) < min_chars or len(line) < 4 * min_chars and not line.isascii() and len(line.decode("utf-8", "replace")) < min_chars:
                        continue
                    rows.append(row)
                    lines.append(number)
                    found.append(digest(line.lower()))
                    if len(found) >= BUFFER:
                        yield flush(keys, ids)
            if found:
                yield flush(keys, ids)

    return stored(_rows(docs, doc_id, text).select("key", "id", "body").mapInArrow(cut, KEY_SCHEMA), "line-keys")


def build_index(keys: DataFrame) -> tuple[DataFrame, int]:
    """(the stored index over line_keys(), one row a shard; the number of shards)."""
    grouped = keys.groupBy("h", "print").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    counted = stored(grouped, "line-counts")
    shards = max(1, min(MAX_SHARDS, -(-counted.count() // SHARD_KEYS)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, prints, n, least = (np.concatenate(x) for x in zip(*held, strict=True))
            keys = keys.view(np.uint64)
            # two lines with one 64-bit hash: both stay findable, by fingerprint, in the list behind the levels
            order = np.argsort(keys, kind="stable")
            twin = np.concatenate(([False], keys[order][1:] == keys[order][:-1]))
            keys = keys.copy()
            keys[order[twin]] ^= mixed(prints[order[twin]].view(np.uint32).astype(np.uint64) + np.uint64(1))
            table = PerfectHash.build(keys)
            at = table.index(keys)
            # counts in the least width that holds the shard's greatest
            out = [np.empty(len(keys), t) for t in (np.uint32, np.min_scalar_type(int(n.max())), np.int64)]
            for own, values in zip(out, (prints.view(np.uint32), n, least), strict=True):
                own[at] = values
            blobs = [*table.pack(), *(x.tobytes() for x in out)]
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([int(n.sum())], pa.int64()), *(pa.array([x], pa.binary()) for x in blobs)], names=[x.split()[0] for x in INDEX_SCHEMA.split(", ")])

        for batch in batches:
            shard, *columns = (batch.column(i).to_numpy() for i in range(5))
            cuts = np.concatenate(([0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if shard[a] != now and held:
                    yield from flush()
                    held = []
                now = int(shard[a])
                held.append([c[a:b].copy() for c in columns])
        if held:
            yield from flush()

    dealt = counted.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h", "print", "n", "least")
    index = stored(dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(build, INDEX_SCHEMA), "line-index")
    discard(counted)
    return index, shards


class Shard:
    """One row of the index: what is known of each of its lines."""

    def __init__(self, levels: bytes, sizes: bytes, rest: bytes, prints: bytes, counts: bytes, firsts: bytes):
        self.table = PerfectHash.unpack(levels, sizes, rest)
        self.prints, self.firsts = np.frombuffer(prints, np.uint32), np.frombuffer(firsts, np.int64)
        self.counts = np.frombuffer(counts, f"u{len(counts) // max(1, len(self.prints))}")

    def look(self, h: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Place of each line in the arrays, -1 if the shard does not have it."""
        at = self.table.index(h)
        other = (at < 0) | (self.prints[at] != prints)
        if other.any():  # the second of two lines with one hash
            at[other] = self.table.index(h[other] ^ mixed(prints[other].astype(np.uint64) + np.uint64(1)))
        return np.where((at >= 0) & (self.prints[at] == prints), at, -1)


def dropped_lines(keys: DataFrame) -> DataFrame:
    """(key, lines): numbers of the lines that each document of line_keys() loses, only documents that lose any."""
    index, shards = build_index(keys)
    probes = dict(tuple(r) for r in index.select("shard", "probes").collect())  # one number a shard, MAX_SHARDS at most
    copies = np.array([max(1, -(-probes.get(s, 0) // COPY_PROBES)) for s in range(shards)], np.int64)
    shared = keys.sparkSession.sparkContext.broadcast(copies)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, id_, line, h, prints = (np.concatenate(x) for x in zip(*held, strict=True))
            shard = np.mod(h, shards)
            copy = (mixed(key.view(np.uint64)) % shared.value[shard].astype(np.uint64)).astype(np.int64)
            order = np.lexsort((line, key, copy, shard))
            shard, copy, key, id_, line, h, prints = (x[order] for x in (shard, copy, key, id_, line, h, prints))
            # equal rows ask once
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (line[1:] != line[:-1])))
            shard, copy, key, id_, line, h, prints = (x[new] for x in (shard, copy, key, id_, line, h, prints))
            cuts = np.concatenate(([0], np.flatnonzero((shard[1:] != shard[:-1]) | (copy[1:] != copy[:-1])) + 1, [len(shard)]))
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            blobs = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (key, id_, line.astype(np.int32), h, prints)]
            yield pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]].astype(np.int32)), pa.array(copy[cuts[:-1]].astype(np.int32)), pa.array(np.ones(len(spans), np.int32)), *blobs, pa.nulls(len(spans), pa.binary())], names=["shard", "copy", "kind", *BLOBS])

        for batch in batches:
            held.append([batch.column(i).to_numpy().copy() for i in range(5)])
            size += batch.num_rows
            if size >= BUFFER:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now, held = None, None, []

        def flush() -> Iterator[pa.RecordBatch]:
            key, line = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((line, key))
            key, line = key[order], line[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (line[1:] != line[:-1])))
            key, line = key[new], line[new]
            heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(key[heads]), pa.ListArray.from_arrays(pa.array(np.append(heads, len(key)).astype(np.int32)), pa.array(line))], names=["key", "lines"])

        for batch in batches:
            for i in range(batch.num_rows):
                one = [batch.column(c)[i] for c in range(9)]
                name = (one[0].as_py(), one[1].as_py())
                if name != now and held:
                    yield from flush()
                    held = []
                now = name
                blobs = [x.as_py() for x in one[3:]]
                if one[2].as_py() == 0:
                    shard = Shard(*blobs)
                    continue
                key, id_, line, h, prints = (np.frombuffer(x, t) for x, t in zip(blobs[:5], (np.int64, np.int64, np.int32, np.uint64, np.uint32), strict=True))
                at = shard.look(h, prints)
                # a line that only one document has names that document as its first
                lost = (at >= 0) & (shard.counts[at] > 1) & (shard.firsts[at] != id_)
                if lost.any():
                    held.append((key[lost], line[lost]))
        if held:
            yield from flush()

    # one short row a shard, at most MAX_SHARDS: safe to broadcast
    many = keys.sparkSession.createDataFrame([(s, int(n)) for s, n in enumerate(copies) if s in probes], "shard int, copies int")
    blobs = [x.split()[0] for x in INDEX_SCHEMA.split(", ")[2:]]
    tables = index.join(F.broadcast(many), "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), *(F.col(x).alias(y) for x, y in zip(blobs, BLOBS, strict=True)))
    packets = tables.unionByName(keys.mapInArrow(send, PACKET_SCHEMA)).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    # a line's number comes from one shard only, so the lists of a document have nothing in common
    return packets.mapInArrow(answer, "key long, lines array<int>").groupBy("key").agg(F.flatten(F.collect_list("lines")).alias("lines"))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, with_text: bool = True) -> DataFrame:
    """One row a document: doc_id, n_lines, n_dropped, kept_sha256 and, if asked for, ``kept``, the text that is left."""
    keys = line_keys(docs, doc_id, text, min_chars)
    rows = _rows(docs, doc_id, text).select("doc_id", "key", F.coalesce("body", F.lit("")).alias("body"))
    # shuffled at every size, never broadcast: the plan is the same for all inputs
    joined = rows.join(dropped_lines(keys).hint("merge"), "key", "left").select("doc_id", "body", "lines")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, hashed, left = [], [], [], []
            for body, gone in zip(batch.column(1), batch.column(2), strict=True):
                kept = body.as_buffer().to_pybytes()
                n, lost = kept.count(b"\n") + 1, 0
                if gone.is_valid:
                    numbers = gone.values.to_numpy()
                    stays = np.ones(n, bool)
                    stays[numbers] = False
                    kept, lost = b"\n".join(x for x, y in zip(kept.split(b"\n"), stays.tolist(), strict=True) if y), len(numbers)
                n_lines.append(n)
                n_dropped.append(lost)
                hashed.append(hashlib.sha256(kept).hexdigest())
                left.append(kept if with_text else None)
            arrays = [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(hashed, pa.string()), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"])

    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("n_lines long, n_dropped long, kept_sha256 string, kept string")])
    result = joined.mapInArrow(cut, schema)
    return result if with_text else result.drop("kept")
