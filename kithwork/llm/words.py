"""Words of many texts at once: positions and 64-bit hashes by numpy over the UTF-8 bytes, without a loop over words.

Hashes stand for words and word sequences in the operators. A word's hash is a polynomial over random 64-bit values of
its bytes, then mixed with its length; sequences are hashed the same way over word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text is handled alone.
CHUNK_BYTES = 2 << 20

_U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _U(0x9E3779B97F4A7C15)
_SEQ = _U(0xD6E8FEB86659FD93)

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but white space.
SOLID = ~BLANK
#: ASCII digits and letters, and all bytes of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of an Arrow string array; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word: a run of bytes of ``inside`` in one row."""
    in_word = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(in_word)
    before[:1] = False
    before[1:] = in_word[:-1]
    starts = np.flatnonzero(in_word & (~before | edge[:-1]))
    after = np.empty_like(in_word)
    after[-1:] = False
    after[:-1] = in_word[1:]
    ends = np.flatnonzero(in_word & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A hash of each word; ``fold`` maps bytes first."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    total = int(lengths.sum())
    if total == len(data):
        used = data
    else:
        cover = np.zeros(len(data) + 1, np.int8)
        cover[starts] += 1
        cover[ends] -= 1
        used = data[np.cumsum(cover[:-1], dtype=np.int8).astype(bool)]
    place = np.arange(total) - np.repeat(firsts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _STEP, np.uint64))
    table = _BYTES if fold is None else _BYTES[fold]
    sums = np.add.reduceat(table[used] * powers[place], firsts)
    return mixed(sums + lengths.astype(np.uint64) * _SEQ)


def sequences(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each place of the ``n`` words from there on, regardless of rows; shorter than ``words`` by n - 1."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    # doubling: the hash of 2k words is that of k, shifted, plus that of the next k
    out, width = None, 0
    block, size, block_power = words, 1, _SEQ
    rest = n
    square = lambda x: np.uint64(int(x) ** 2 & 0xFFFFFFFFFFFFFFFF)
    while rest:
        if rest & 1:
            if out is None:
                out, width = block, size
            else:
                m = min(len(out), len(block) - width)
                out = out[:m] * block_power + block[width : width + m]
                width += size
        rest >>= 1
        if rest:
            m = len(block) - size
            block = block[:m] * block_power + block[size : size + m]
            size, block_power = size * 2, square(block_power)
    return mixed(out[: len(words) - n + 1])


def whole(rows: np.ndarray, n: int) -> np.ndarray:
    """For each place, whether the ``n`` words from there on are in one row."""
    return rows[: len(rows) - n + 1] == rows[n - 1 :] if len(rows) >= n else np.zeros(0, bool)
