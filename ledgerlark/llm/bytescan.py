r"""Words of whole texts as 64-bit hashes, straight from Arrow's buffers, some megabytes at a time.

A word is a run of bytes other than \x20 and \x09-\x0D. Its hash is multilinear: the sum, modulo 2**64, of a random value of
each byte times a random value of its place in the word, mixed at the end with the length. No relation between places can be
used to write down colliding words, as it can for polynomials; n different words collide with a chance of about n**2 / 2**65.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
SLICE = 1 << 20
GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
_EXACT = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 64, 256, dtype=U64)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(29)
    h = h * U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(32)
    return h


def _of_places(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(0x632BE59BD9B4E019))


_PLACES = _of_places(4096)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end and the n + 1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(data: np.ndarray, off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of about `limit` bytes that end at a gap or a text's end; a longer word stays whole."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + limit, n)
        if end < n:
            border = int(off[np.searchsorted(off, end, "right") - 1])
            gaps = np.flatnonzero(GAP[data[at:end]])
            cut = max(border, at + int(gaps[-1]) + 1 if len(gaps) else at)
            while cut <= at:  # one word fills the slice: go on to its end
                border = int(off[np.searchsorted(off, end, "right")])
                ahead = np.flatnonzero(GAP[data[end : min(end + limit, border)]])
                cut = end + int(ahead[0]) + 1 if len(ahead) else border if border <= end + limit else at
                end += limit
            end = cut
        yield at, end
        at = end


def spans(data: np.ndarray, off: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, counted from lo, of the words in data[lo:hi]."""
    inside = ~GAP[data[lo:hi]]
    firsts = off[np.searchsorted(off, lo) : np.searchsorted(off, hi)] - lo
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[firsts] = inside[firsts]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    lasts = firsts[firsts > 0] - 1
    end[lasts] = inside[lasts]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def hashed(data: np.ndarray, lo: int, hi: int, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    size = ends - starts
    if not len(size):
        return np.zeros(0, U64)
    first = np.cumsum(size) - size
    kind = np.int32 if hi - lo < 1 << 31 else np.int64
    place = np.arange(int(size.sum()), dtype=kind)
    place -= np.repeat(first.astype(kind), size)
    places = _PLACES if int(size.max()) <= len(_PLACES) else _of_places(int(size.max()))
    values = places[place]
    place += np.repeat(starts.astype(kind), size)
    values *= (_FOLDED if fold else _EXACT)[data[lo:hi][place]]
    return mixed(np.add.reduceat(values, first) + size.astype(U64) * U64(0x2545F4914F6CDD1D))


def word_hashes(column: pa.Array, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and n + 1 bounds: text i has words bounds[i]:bounds[i + 1]. fold: A-Z as a-z."""
    data, off = text_buffer(column)
    found, bounds = [np.zeros(0, U64)], np.zeros(len(off), np.int64)
    for lo, hi in slices(data, off):
        starts, ends = spans(data, off, lo, hi)
        found.append(hashed(data, lo, hi, starts, ends, fold))
        bounds += np.searchsorted(starts + lo, off)
    return np.concatenate(found), bounds


def doc_groups(bounds: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `limit` words together, one text at least."""
    at, n = 0, len(bounds) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, min(end, n)
        at = end


def give_back() -> None:
    """Free memory back to the system: Python workers stay, and what one stage has freed the next one's executor needs."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def byte_parts(batches: Iterator[pa.RecordBatch], at: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `limit` bytes of column `at`, one row at least; memory that is free goes back in between."""
    for batch in batches:
        _, off = text_buffer(batch.column(at))
        for lo, hi in doc_groups(off, limit):
            yield batch.slice(lo, hi - lo)
        del batch, off  # the last one too, before the worker waits for its next task
        give_back()
