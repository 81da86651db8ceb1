"""Exact substring dedup over word windows, behind a count-min prefilter.

A window is ``window`` consecutive words of one document; it is repeated if the same words start anywhere else. A word
is removed if a repeated window covers it.

Pass 1 sketches. Every window is represented by its minimizer: the leftmost smallest hash among the GRAM-word
sequences inside it. Equal windows have equal minimizers at equal offsets, so a window's count is at most the count
of the minimizer's places, and about ten windows share one place. Every partition counts its places in a sparse
count-min sketch; the sketches are merged by slices of cells into counts that never underestimate.

Pass 2 sends on only the windows whose minimizer's estimate is 2 or more, with a 64-bit hash of the window and 32 more
bits of the minimizer's. Equal windows that meet in one task's buffer are known to be repeated there; they go on once,
without their places. So a passage in a third of all documents gives each reducer one entry a buffer, not one a
document. What is left is grouped exactly. Windows are dealt to buckets by minimizer, which keeps neighbours together;
those of a minimizer estimated HOT or more go by their own hash, so that no bucket gets all contexts of a short
common phrase. Repeated places go back to their documents as runs.

The sketch grows with the text up to 2 ** MAX_BITS cells a row. Three bitmaps of it, of 2 ** bits / 8 bytes each, are
all that reaches the driver and is broadcast: cells of either row estimated 2 or more, and cells of the first row
estimated HOT or more. That is 192 MB at the bound; past it more windows pass the filter, and the result stays the same.

Defined results: a null or empty text has no words; documents shorter than the window keep all words; equal rows count
as two occurrences; an empty table gives no rows; only the id and text columns are read, whatever else the table has.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithwork.llm import words as W

WINDOW = 35
GRAM = 16
HOT = 64
SLICES = 64
MIN_BITS, MAX_BITS = 16, 29
#: Candidate windows that a task holds before it looks for equals among them and sends them on.
BUFFER = 1 << 20
#: Windows a bucket may hold if every window passes the filter.
BUCKET = 1 << 20
_KNOWN = 0xFFFFFFFF


def _minimizers(words: np.ndarray, rows: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of whole windows, place of each one's minimizer, all grams' hashes)."""
    at = np.flatnonzero(W.whole(rows, window))
    grams = W.sequences(words, gram)
    if not len(at):
        return at, at, grams
    # leftmost minimum over `span` places by doubling
    span, width = window - gram + 1, 1
    place = np.arange(len(grams))
    while width * 2 <= span:
        left, right = place[: len(place) - width], place[width:]
        place, width = np.where(grams[right] < grams[left], right, left), width * 2
    if width < span:
        rest = span - width
        left, right = place[: len(place) - rest], place[rest:]
        place = np.where(grams[right] < grams[left], right, left)
    return at, place[at], grams


def _cells(hashed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return (hashed & mask).astype(np.uint32), ((hashed >> np.uint64(32)) & mask).astype(np.uint32)


def sketch_bits(n_bytes: int, window: int = WINDOW, gram: int = GRAM) -> int:
    """Cells a row, as a power of 2: some four times the expected number of minimizer places, a whole byte a slice at least."""
    places = max(1.0, n_bytes / 6 * 2 / (window - gram + 2))
    return max(MIN_BITS, min(MAX_BITS, math.ceil(math.log2(4 * places))), int(math.log2(SLICES)) + 3)


def sketch_bytes(bits: int) -> int:
    """Bytes of the bitmaps that are collected and broadcast."""
    return 3 * (1 << bits) // 8


def _sketch(texts: DataFrame, bits: int, window: int, gram: int) -> tuple[list[bytes], bytes]:
    """Bitmaps of the cells with a count of 2 or more, one for each row of the sketch, and of the first row's cells with HOT or more."""
    inner = bits - int(math.log2(SLICES))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            hashed = np.concatenate(held)
            for row, cells in enumerate(_cells(hashed, bits)):
                cell, n = np.unique(cells, return_counts=True)
                n = np.minimum(n, 255).astype(np.uint8)
                cuts = np.searchsorted(cell, np.arange(SLICES + 1, dtype=np.int64) << inner)
                found = [s for s in range(SLICES) if cuts[s] < cuts[s + 1]]
                arrays = [
                    pa.array([row * SLICES + s for s in found], pa.int32()),
                    pa.array([(cell[cuts[s] : cuts[s + 1]] - np.uint32(s << inner)).tobytes() for s in found], pa.binary()),
                    pa.array([n[cuts[s] : cuts[s + 1]].tobytes() for s in found], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["slice", "cells", "counts"])

        for batch in batches:
            for _, _, data, offsets in W.chunks(batch.column(0)):
                starts, ends, rows = W.spans(data, offsets, W.SOLID)
                at, place, grams = _minimizers(W.hashes(data, starts, ends), rows, window, gram)
                if len(at):
                    held.append(grams[place[np.concatenate(([True], place[1:] != place[:-1]))]])
                    size += len(held[-1])
                if size > 4 * BUFFER:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, cells, counts in zip(*(batch.column(i) for i in range(3)), strict=True):
                sums = total.setdefault(s.as_py(), np.zeros(1 << inner, np.uint8))
                cell = np.frombuffer(cells.as_buffer(), np.uint32)
                sums[cell] = np.minimum(sums[cell].astype(np.uint16) + np.frombuffer(counts.as_buffer(), np.uint8), 255)
        for s, sums in total.items():
            bitmaps = [np.packbits(sums >= least, bitorder="little").tobytes() for least in (2, HOT)]
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array(bitmaps[:1], pa.binary()), pa.array([bitmaps[1] if s < SLICES else None], pa.binary())], names=["slice", "twice", "hot"])

    merged = texts.mapInArrow(local, "slice int, cells binary, counts binary").repartition("slice").mapInArrow(merge, "slice int, twice binary, hot binary")
    maps = [bytearray((1 << bits) // 8) for _ in range(3)]
    size = (1 << inner) // 8
    for s, twice, hot in merged.collect():  # 2 * SLICES rows, sketch_bytes(bits) in all
        row, part = divmod(s, SLICES)
        for own, bitmap in ((maps[row], twice), (maps[2], hot)):
            if bitmap is not None:
                own[part * size : (part + 1) * size] = bitmap
    return [bytes(maps[0]), bytes(maps[1])], bytes(maps[2])


def _set(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1


def _runs(keys: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """(key, [first place, number of places, ...]) for each key."""
    order = np.lexsort((places, keys))
    keys, places = keys[order], places[order].astype(np.int64)
    new_key = np.concatenate(([True], keys[1:] != keys[:-1]))
    head = np.flatnonzero(new_key | np.concatenate(([True], places[1:] > places[:-1] + 1)))
    length = places[np.append(head[1:], len(places)) - 1] - places[head] + 1
    flat = np.stack([places[head], length], 1).astype(np.int32).ravel()
    firsts = np.flatnonzero(new_key[head])
    offsets = np.append(firsts, len(head)).astype(np.int32) * 2
    return pa.RecordBatch.from_arrays([pa.array(keys[head][firsts].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "runs"])


PROBE_SCHEMA = "bucket int, hashes binary, grams binary, keys binary, places binary"


def repeated(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, runs) for ``rows`` (key long, body string): places of repeated windows as [first, number, ...], several rows a key."""
    spark = rows.sparkSession
    gram = min(gram, window)
    n_bytes = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bits = sketch_bits(n_bytes, window, gram)
    buckets = max(8, -(-n_bytes // (6 * BUCKET)))
    filter_ = spark.sparkContext.broadcast(_sketch(rows.select("body"), bits, window, gram))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = [np.frombuffer(x, np.uint8) for x in filter_.value[0]]
        hot = np.frombuffer(filter_.value[1], np.uint8)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            hashed, grams, many, keys, places = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((grams, hashed))
            h, g = hashed[order], grams[order]
            head = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
            group = np.cumsum(head) - 1
            known = np.empty(len(h), bool)
            known[order] = np.bincount(group)[group] > 1
            first = np.zeros(len(h), bool)
            first[order[head]] = True
            if known.any():
                # their places need no count: they go back to their documents by way of any bucket
                for key in np.array_split(np.flatnonzero(known), max(1, int(known.sum()) >> 16)):
                    yield _payload(int(keys[key[0]] % np.uint64(buckets)), np.zeros(0, np.uint64), np.zeros(0, np.uint32), keys[key], places[key])
            send = np.flatnonzero(~known | first)
            bucket = (W.mixed(np.where(many[send], hashed[send], grams[send])) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            send, bucket = send[order], bucket[order]
            cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
            place = np.where(known, _KNOWN, places)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    own = send[a:b]
                    yield _payload(int(bucket[a]), hashed[own], (grams[own] >> np.uint64(32)).astype(np.uint32), keys[own], place[own])

        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for first, _, data, offsets in W.chunks(batch.column(1)):
                starts, ends, rows_ = W.spans(data, offsets, W.SOLID)
                words = W.hashes(data, starts, ends)
                at, place, grams = _minimizers(words, rows_, window, gram)
                if not len(at):
                    continue
                mini = grams[place]
                low, high = _cells(mini, bits)
                keep = np.flatnonzero(_set(twice[0], low) & _set(twice[1], high))
                if not len(keep):
                    continue
                at, mini = at[keep], mini[keep]
                many = _set(hot, low[keep]).astype(bool)
                row = rows_[at]
                first_word = np.searchsorted(rows_, row)
                held.append((W.sequences(words, window)[at], mini, many, own[first + row], (at - first_word).astype(np.uint32)))
                size += len(at)
                if size > BUFFER:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            hashed, grams, keys, places = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((grams, hashed))
            h, g = hashed[order], grams[order]
            group = np.cumsum(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))) - 1
            sent_known = (places == _KNOWN)[order]
            times = np.bincount(group) + np.bincount(group, sent_known)
            back = order[(times[group] > 1) & ~sent_known]
            if len(back):
                yield _runs(keys[back], places[back])

        for batch in batches:
            for i in range(batch.num_rows):
                bucket, *parts = (batch.column(c)[i] for c in range(5))
                hashed, grams, keys, places = (np.frombuffer(x.as_buffer(), t) for x, t in zip(parts, (np.uint64, np.uint32, np.uint64, np.uint32), strict=True))
                if not len(hashed):
                    yield _runs(keys, places)
                    continue
                if bucket.as_py() != now and held:
                    yield from flush()
                    held = []
                now = bucket.as_py()
                held.append((hashed.copy(), grams.copy(), keys.copy(), places.copy()))
        if held:
            yield from flush()

    probes = rows.select("key", "body").mapInArrow(probe, PROBE_SCHEMA)
    return probes.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(decide, "key long, runs array<int>")


def _payload(bucket: int, hashed: np.ndarray, grams: np.ndarray, keys: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    blobs = (hashed, grams, keys.astype(np.uint64), places.astype(np.uint32))
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names=PROBE_SCHEMA.replace(" int", "").replace(" binary", "").split(", "))


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, ``kept``: the words left, joined by one space."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(doc_id, text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    # equal rows share a key, and tasks find the same runs for them: a set holds each once
    back = repeated(rows, window).groupBy("key").agg(F.flatten(F.collect_set("runs")).alias("runs"))
    # shuffled at every size, never broadcast
    joined = rows.join(back.hint("merge"), "key", "left").select("id", "body", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": batch.column(0), "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
            for body, runs in zip(batch.column(1), batch.column(2), strict=True):
                words = body.as_buffer().to_pybytes().split() if body.is_valid else []
                n = len(words)
                if runs.is_valid and len(runs):
                    flat = runs.values.to_numpy().astype(np.int64).reshape(-1, 2)
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, flat[:, 0], 1)
                    np.add.at(edge, flat[:, 0] + flat[:, 1] + window - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    words = [w for w, x in zip(words, gone, strict=True) if not x]
                kept = b" ".join(words)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(words))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept if with_text else None)
            out["kept"] = pa.array(out["kept"], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(out)

    result = joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return result if with_text else result.drop("kept")
