"""Words and shingles of whole texts as 64-bit hashes, computed on Arrow buffers.

Words are ``[^\\x20\\x09-\\x0D]+``: white space is the space and the five control characters
that ``bytes.split`` knows. A text is read as UTF-8 bytes, whole; null is the empty text.
Equal words have equal hashes on every executor. Different words or shingles share a hash with
odds of about 2**-64 a pair; results that rest on equality say so.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SEGMENT = 1 << 17
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out, x = np.empty(n, U), 1
    for i in range(n):
        out[i] = x
        x = x * base & _MASK
    return out


_POW = _powers(0x9E3779B97F4A7C15 | 1, 1 << 16)
_BYTE = np.random.default_rng(0x5EED).integers(1, 2**64 - 1, 256, dtype=U)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the word."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row in them (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def _word_hashes(raw: np.ndarray, edges: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of the words of one segment; ``edges`` are row starts inside it."""
    space = _SPACE[raw]
    before = np.empty(len(raw), bool)
    before[0], before[1:] = True, space[:-1]
    before[edges] = True
    starts = np.flatnonzero(before & ~space)
    if not len(starts):
        return starts, np.empty(0, U)
    at = np.arange(len(raw)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(raw)]))))
    value = _BYTE[_LOWER[raw] if lower else raw] * _POW[at & 0xFFFF]
    value[space] = 0
    sums = np.add.reduceat(value, starts)
    return starts, mix(sums)


def hash_words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the index of each row's first word (one more than rows).

    Long texts are read in segments that end at white space or at a row, so memory stays bounded.
    """
    found, places, a, n = [], [], 0, len(raw)
    while a < n:
        b = min(n, a + _SEGMENT)
        if b < n:
            row = offsets[np.searchsorted(offsets, b, "right") - 1]
            gaps = np.flatnonzero(_SPACE[raw[a:b]])
            b = max(int(row), a + int(gaps[-1]) + 1 if len(gaps) else 0)
            while b <= a:  # one word longer than a segment
                at, step = a, a
                while b <= a:
                    step = min(n, at + _SEGMENT)
                    more = np.flatnonzero(_SPACE[raw[at:step]])
                    nxt = offsets[np.searchsorted(offsets, a, "right")] if a < n else n
                    b = min(int(nxt), at + int(more[0]) + 1 if len(more) else step if step == n else int(nxt) if nxt <= step else 0)
                    at = step
        edges = offsets[np.searchsorted(offsets, a):np.searchsorted(offsets, b)] - a
        starts, hashes = _word_hashes(raw[a:b], edges, lower)
        places.append(starts + a)
        found.append(hashes)
        a = b
    places = np.concatenate(places) if places else np.empty(0, np.int64)
    found = np.concatenate(found) if found else np.empty(0, U)
    return found, np.searchsorted(places, offsets)


def shingles(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each row, in order, and each row's first one.

    A row with fewer words, but some, has its whole word sequence as its only shingle.
    """
    counts = np.diff(first)
    n_out = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(n_out)))
    row = np.repeat(np.arange(len(counts)), n_out)
    at = np.arange(begin[-1]) - begin[row] + first[row]
    long_row = counts[row] >= size
    acc = np.zeros(len(at), U)
    last = len(words) - 1
    for j in range(size):
        here = words[np.minimum(at + j, last)] if last >= 0 else np.zeros(len(at), U)
        inside = long_row | (j < counts[row])
        acc = np.where(inside, acc * U(0x100000001B3) + here, acc)
    width = np.where(long_row, size, counts[row]).astype(U)
    return mix(acc + width * U(0x9E3779B97F4A7C15)), begin


def runs(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingles``, but rows with fewer words than ``size`` have none."""
    counts = np.diff(first)
    short = counts < size
    out, begin = shingles(words, first, size)
    if short.any():
        keep = np.repeat(~short, np.diff(begin))
        out, begin = out[keep], np.concatenate(([0], np.cumsum(np.where(short, 0, np.diff(begin)))))
    return out, begin


def release() -> None:
    """Gives memory that a finished pass no longer uses back to the system: workers live on for the next stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not a glibc
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``size`` bytes of text, one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        total, a = np.concatenate(([0], np.cumsum(lengths.astype(np.int64)))), 0
        while a < len(lengths):
            b = max(a + 1, int(np.searchsorted(total, total[a] + size, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b
    release()
