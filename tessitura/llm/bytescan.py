"""Vectorised scans over the byte buffer of an Arrow text column.

Texts of a batch lie one after the other in one byte buffer.  Word borders and
word hashes of a whole stretch of documents are found with a few NumPy passes
over that buffer, so no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18  # what a few arrays of 8 bytes per byte leave in the processor's cache

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def _byte_table(seed: int) -> np.ndarray:
    """256 fixed 64-bit values drawn from the splitmix64 sequence of ``seed``."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BYTE_VALUE = _byte_table(0x5DEECE66D)
LOWER_VALUE = BYTE_VALUE[LOWER]


def powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, CHUNK_BYTES * 4), base & _MASK, dtype=np.uint64)
        p[0] = 1
        have = _powers[base] = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def text_chunks(column: pa.Array, target: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into stretches of about ``target`` bytes.

    Yields (first row, row after the last, bytes, offsets): row ``first + i`` is
    ``bytes[offsets[i]:offsets[i + 1]]``.  Null counts as empty.  A single text
    longer than ``target`` makes a stretch of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, off_buf, data = column.buffers()
    off = np.frombuffer(off_buf, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + target, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_spans(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive) and document numbers of the maximal runs of word bytes; no run crosses documents."""
    inside = is_word[buf]
    n = len(inside)
    if n == 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = off[:-1][off[:-1] < off[1:]]
    before[firsts] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    lasts = off[1:][off[:-1] < off[1:]] - 1
    after[lasts] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """64-bit hash of every span; equal bytes (after the table ``values``) give equal hashes wherever they lie."""
    n = len(buf)
    with np.errstate(over="ignore"):
        run = np.empty(n + 1, dtype=np.uint64)
        run[0] = 0
        np.cumsum(values[buf] * powers(n, _BASE), dtype=np.uint64, out=run[1:])
        h = (run[ends] - run[starts]) * powers(n + 1, _INVERSE)[starts]
        return mix(h + (ends - starts).astype(np.uint64))


def lower_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document number) of every white-space separated word, A-Z lower-cased."""
    starts, ends, doc = word_spans(buf, off, ~SPACE)
    return span_hashes(buf, starts, ends, LOWER_VALUE), doc
