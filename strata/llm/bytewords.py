"""Vectorised word work on Arrow text columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  Those bytes
are ASCII, so working on UTF-8 bytes gives the same words as working on
characters.  Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes that part words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes handled at once: what bounds the temporary arrays of a task.
CHUNK_BYTES = 1 << 20

_BASES = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))
_TABLES = tuple(np.random.default_rng(7 + k).integers(1, 2**63, 256, dtype=np.uint64) for k in range(2))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: workers are kept and reused, also by stages that follow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # no such call here


def giving_back(rows):
    """``rows``, a function of an iterator or of tables, that gives memory back when it is done."""
    if inspect.isgeneratorfunction(rows):

        @functools.wraps(rows)
        def of_batches(batches):
            yield from rows(batches)
            give_back()

        return of_batches

    @functools.wraps(rows)
    def of_tables(a, b):
        out = rows(a, b)
        give_back()
        return out

    return of_tables


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if which not in _powers or len(_powers[which][0]) < n:
        size, out = max(n, 1 << 16), []
        for b in (int(_BASES[which]), pow(int(_BASES[which]), -1, 2**64)):
            a = np.full(size, b, U64)
            a[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(a))
        _powers[which] = tuple(out)
    up, down = _powers[which]
    return up[:n], down[:n]


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in one array, and each text's start in it, with the end at the last."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of whole texts of about ``size`` bytes; a longer text is a run of its own."""
    raw, offsets = flat(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``raw``, and each text's first word in them, with the count at the last."""
    solid = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(raw), bool)
    if len(raw):
        before[0] = False
        before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    if len(raw):
        after[-1] = False
        after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; ``which`` picks one of two independent functions."""
    up, down = _power(which, len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, U64)
        np.cumsum(_TABLES[which][raw] * up[:-1], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        return mix(h + (ends - starts).astype(U64) * _BASES[1 - which])


def run_hashes(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every k consecutive items of ``h``, at the place of the first."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = _power(which, len(h) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(h) + 1, U64)
        np.cumsum(h * up[:-1], out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * down[:n])


def slide(x: np.ndarray, w: int, reduce: np.ufunc) -> np.ndarray:
    """``reduce`` (minimum or maximum) over every w consecutive items, at the place of the first."""
    width, out = 1, x
    while 2 * width <= w:
        out = reduce(out[:-width], out[width:])
        width *= 2
    return reduce(out[: len(x) - w + 1], out[w - width : len(x) - width + 1]) if width < w else out


def fits(first: np.ndarray, k: int) -> np.ndarray:
    """For each word: whether the k words from it on lie in one text. ``first`` is what ``words`` gives."""
    total = int(first[-1])
    ok = np.zeros(total + 1, np.int32)
    counts = np.diff(first)
    whole = counts >= k
    np.add.at(ok, first[:-1][whole], 1)
    np.add.at(ok, first[:-1][whole] + counts[whole] - k + 1, -1)
    return np.cumsum(ok[:-1]) > 0
