"""Whole-batch word hashing over Arrow string buffers.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``.  All delimiters are ASCII,
so working on UTF-8 bytes gives the same words as working on code points.  Every
function takes many texts at once and runs in numpy; nothing loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64

#: Texts are worked on in slices of about this many bytes (one text may be longer; its words are hashed in such slices too).
SLICE_BYTES = 1 << 20

_DELIM = np.zeros(256, bool)
_DELIM[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _LOWER[97:123]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        row = np.full(max(n, 1 << 16), base, U)
        row[0] = 1
        have = np.cumprod(row, dtype=U)
        if len(have) <= 2 * SLICE_BYTES:  # a longer table is for one long text and not kept
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (splitmix finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ``n + 1`` offsets of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` text bytes, so that memory does not follow the batch size."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    _, offs = text_buffers(col)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and ``n + 1`` word offsets by text."""
    inside = ~_DELIM[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offs[(offs > 0) & (offs < len(data))]
    first[edge] |= inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] |= inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, other: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes (of its A-Z-lowered bytes, if asked; with ``other``, a second one).  ``starts`` and ``ends`` rise."""
    out = np.zeros(len(starts), U)
    table = _LOWER if lower else _BYTES
    if other:
        table = mix(table)
    at = 0
    while at < len(starts):
        begin = int(starts[at])
        to = int(np.searchsorted(ends, begin + SLICE_BYTES, "right"))
        if to <= at:  # one word longer than a slice
            to, total = at + 1, 0
            for k in range(begin, int(ends[at]), SLICE_BYTES):
                piece = data[k : min(k + SLICE_BYTES, int(ends[at]))]
                total += int((table[piece] * _power(_BASE, len(piece))).sum(dtype=U)) * pow(_BASE, k - begin, 1 << 64)
            out[at] = U(total % (1 << 64))
        else:
            piece = data[begin : int(ends[to - 1])]
            total = np.zeros(len(piece) + 1, U)
            np.cumsum(table[piece] * _power(_BASE, len(piece)), dtype=U, out=total[1:])
            s = starts[at:to] - begin
            out[at:to] = (total[ends[at:to] - begin] - total[s]) * _power(_INVERSE, len(piece))[s]
        at = to
    return mix(out + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes (``len(h) - width + 1`` of them)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * _power(_BASE, len(h)), dtype=U, out=total[1:])
    return mix((total[width:] - total[:n]) * _power(_INVERSE, len(h))[:n])


def run_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run ``h[start:end]``."""
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * _power(_BASE, len(h)), dtype=U, out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_INVERSE, len(h) + 1)[starts] + (ends - starts).astype(U))


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes laid end to end: each element's group, and its place in it."""
    counts = np.asarray(counts, np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return owner, np.arange(int(counts.sum())) - begin[owner]
