"""Token ids in Huffman-coded shard files.

Codes are canonical and at most ``LIMIT`` bits long (package-merge over the global
counts).  A shard holds its ids as independent blocks of ``BLOCK`` ids; the bit offset
of every block is stored, so that any block can be decoded alone, and many are decoded
in step by table look-ups in numpy.

Defined results: a null text is an empty one and encodes as the end id alone; equal
doc_ids keep a row each, ordered by their ids; a null doc_id comes first; no documents
give no shards.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LIMIT = 18
BLOCK = 512
_MAGIC = b"HUFIDS01"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for every id with a count (package-merge)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    rows, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        weight = np.concatenate([leaf, packages])
        at = np.argsort(weight, kind="stable")
        rows.append(at < len(leaf))
        weight = weight[at]
        pairs = len(weight) // 2
        packages = weight[0 : 2 * pairs : 2] + weight[1 : 2 * pairs : 2]
    take = 2 * (len(leaf) - 1)
    lengths = np.zeros(len(leaf), np.int64)
    for is_leaf in reversed(rows):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    size = lengths[order].astype(np.int64)
    step = np.left_shift(np.int64(1), LIMIT - size)
    first = np.cumsum(step) - step
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = first >> (LIMIT - size)
    return codes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit string as big-endian 32-bit words, and the bit offset of every block."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    value = codes[ids] << (np.uint64(64) - (size + (at & 31)).astype(np.uint64))
    n = int(end[-1]) // 32 + 2 if len(ids) else 1
    word = at >> 5
    # bits never overlap, so sums below 2**53 are exact
    out = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n) if len(ids) else np.zeros(1)
    return out.astype(np.uint64).astype(">u4"), at[::BLOCK].copy()


def decode(words: np.ndarray, offsets: np.ndarray, n: int, lengths: np.ndarray) -> np.ndarray:
    """The ``n`` ids; all blocks advance together, one table look-up an id."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = np.left_shift(1, LIMIT - lengths[order].astype(np.int64))
    symbol = np.repeat(order, span)
    symbol = np.concatenate([symbol, np.zeros((1 << LIMIT) - len(symbol), symbol.dtype)]).astype(np.int64)
    size = lengths.astype(np.int64)[symbol]
    bits = np.concatenate([words.astype(np.uint64), np.zeros(2, np.uint64)])
    at = offsets.astype(np.int64).copy()
    out = np.zeros((len(offsets), BLOCK), np.uint32)
    last = n - BLOCK * (len(offsets) - 1)
    for k in range(min(BLOCK, n)):
        if k == last:
            at = at[:-1]  # only the last block may be short
        word = at >> 5
        pair = (bits[word] << np.uint64(32)) | bits[word + 1]
        key = (pair >> (np.uint64(64 - LIMIT) - (at & 31).astype(np.uint64))).astype(np.int64) & ((1 << LIMIT) - 1)
        out[: len(at), k] = symbol[key]
        at += size[key]
    return out.reshape(-1)[:n]


def pack_shard(doc_ids: np.ndarray, n_tokens: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, nulls: int = 0) -> bytes:
    """One shard file: header with the number of leading rows without an id, zlib-packed code lengths, document table and block offsets, then the bits, each with a CRC."""
    words, offsets = encode(ids, lengths, codes)
    parts = [zlib.compress(x, 1) for x in (lengths.tobytes(), doc_ids.astype("<i8").tobytes(), n_tokens.astype("<i8").tobytes(), offsets.astype("<i8").tobytes())] + [words.tobytes()]
    head = struct.pack("<8sQQ", _MAGIC, nulls, len(ids)) + b"".join(struct.pack("<QI", len(p), zlib.crc32(p)) for p in parts)
    return head + b"".join(parts)


def unpack_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """doc_ids, token counts and all ids of a shard file, and how many leading rows have no doc_id."""
    magic, nulls, n = struct.unpack_from("<8sQQ", data)
    if magic != _MAGIC:
        raise ValueError("not a shard of Huffman-coded ids")
    at, parts = 24 + 12 * 5, []
    for k in range(5):
        size, crc = struct.unpack_from("<QI", data, 24 + 12 * k)
        part = data[at : at + size]
        if len(part) != size or zlib.crc32(part) != crc:
            raise ValueError(f"section {k} of the shard is damaged")
        parts.append(part)
        at += size
    lengths, docs, counts, offsets = (zlib.decompress(p) for p in parts[:4])
    ids = decode(np.frombuffer(parts[4], ">u4"), np.frombuffer(offsets, "<i8"), n, np.frombuffer(lengths, np.uint8)) if n else np.zeros(0, np.uint32)
    return np.frombuffer(docs, "<i8"), np.frombuffer(counts, "<i8"), ids, nulls
