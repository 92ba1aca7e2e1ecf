"""Byte-level BPE in DuckDB.

Each task holds the merge table in an in-process DuckDB.  Encoding a set of pieces is
one recursive query: rows are (word, position, token id); every round joins neighbours
with the merge table, takes each word's minimum-rank pair, leftmost first, and
contracts it, until no word has a pair left.  Decoding joins ids with the vocabulary
and puts the bytes together by ordered aggregation.

Distinct pieces of the split pattern are encoded once per worker and remembered, within
``MEMORY_BYTES``, so the query works on distinct pieces, not on all words.  Pieces longer than
``LONG`` bytes take a heap that contracts in the same order, since the recursive query's rows
grow with the square of a piece's length.

Defined results: null and empty texts have no ids and decode to no bytes; ids outside
the vocabulary raise an error; repeated and null doc_ids keep a row each.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import memory, wordhash

#: Bytes of remembered pieces per Python worker.
MEMORY_BYTES = 40 << 20
LONG = 512
#: Text bytes of one encoding round, pieces of one encoding query, and ids of one decoding query.
ROUND_BYTES, ROUND_PIECES, ROUND_IDS = 1 << 20, 25_000, 1 << 18
#: Rounds after which the allocator's free pages go back to the system.
TIDY = 8

_CONTRACT = """
WITH RECURSIVE t(word, pos, id, done) AS (
  SELECT word, pos, id, false FROM seed
  UNION ALL
  (WITH best AS (
     SELECT a.word, min((g.merged << 32) | a.pos) AS pick
     FROM t a JOIN t n ON n.word = a.word AND n.pos = a.pos + 1 JOIN merges g ON g.pair = (a.id << 20) | n.id
     WHERE NOT a.done AND NOT n.done GROUP BY a.word)
   SELECT t.word,
          CASE WHEN t.pos > (pick & 4294967295) THEN t.pos - 1 ELSE t.pos END,
          CASE WHEN t.pos = (pick & 4294967295) THEN pick >> 32 ELSE t.id END,
          pick IS NULL
   FROM t LEFT JOIN best USING (word)
   WHERE NOT t.done AND (pick IS NULL OR t.pos <> (pick & 4294967295) + 1)))
SELECT word, pos, id FROM t WHERE done
"""
_DECODE = "SELECT row, string_agg(spelled, '' ORDER BY pos) AS spelled FROM given JOIN vocabulary USING (id) GROUP BY row"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = load_ranks(ranks_path)
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "96MB"})
        pairs, merged = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left << 20 | right)
                    merged.append(rank)
        self._table("merges", pa.table({"pair": pa.array(pairs, pa.int64()), "merged": pa.array(merged, pa.int64())}))
        # a byte b is spelled as the character U+0100 + b, so that any bytes make valid text
        self._table("vocabulary", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "spelled": ["".join(chr(256 + b) for b in token) for token in self.ranks]}))
        self.top = max(self.ranks.values())
        self.pieces = memory.Memory(MEMORY_BYTES)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.con.register("incoming", rows)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS FROM incoming")
        self.con.unregister("incoming")

    # -- encoding --

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word, by the recursive query."""
        size = np.array([len(w) for w in words])
        word, pos = wordhash.ragged(size)
        seed = pa.table({"word": word, "pos": pos, "id": self.single[np.frombuffer(b"".join(words), np.uint8)]})
        self.con.register("seed", seed)
        got = self.con.sql(_CONTRACT).to_arrow_table()
        self.con.unregister("seed")
        word, pos, ids = (got.column(c).to_numpy() for c in ("word", "pos", "id"))
        ids = ids[np.lexsort((pos, word))].astype("<u4")
        cut = 4 * np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def contract_long(self, word: bytes) -> bytes:
        """The same contraction order with a heap and a linked list, for very long pieces."""
        ids: list = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < len(ids):
                joined = ids[i] + ids[after[i]]
                if (rank := self.ranks.get(joined)) is not None:
                    heapq.heappush(heap, (rank, i, joined))

        for i in range(len(ids)):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            if ids[i] is None or after[i] >= len(ids) or ids[i] + ids[after[i]] != joined:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = joined, None, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return np.array([self.ranks[t] for t in ids if t is not None], "<u4").tobytes()

    def _learn(self, unknown: list[str]) -> None:
        ask, keys = [], []
        for piece in unknown:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.pieces.learn([piece], [rank.to_bytes(4, "little")])
            elif len(raw) > LONG:
                self.pieces.learn([piece], [self.contract_long(raw)])
            else:
                ask.append(raw)
                keys.append(piece)
        for k in range(0, len(ask), ROUND_PIECES):
            self.pieces.learn(keys[k : k + ROUND_PIECES], self.contract(ask[k : k + ROUND_PIECES]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        self.pieces.shrink()
        split = [self.pattern.findall(t) for t in texts]
        self._learn(list(set().union(*split) - self.pieces.keys()))
        known = self.pieces.__getitem__
        return [b"".join(map(known, pieces)) for pieces in split]

    # -- decoding --

    def decode(self, rows: list[bytes]) -> list[bytes]:
        """The bytes that each row of little-endian 32-bit ids stands for."""
        size = np.array([len(r) // 4 for r in rows], np.int64)
        out: list[bytes] = [b""] * len(rows)
        cut = np.concatenate([[0], np.cumsum(size)])
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(cut, cut[at] + ROUND_IDS, "right")) - 1)
            row, pos = wordhash.ragged(size[at:to])
            ids = np.frombuffer(b"".join(rows[at:to]), "<u4").astype(np.int64)
            if len(ids) and (ids > self.top).any():
                raise ValueError(f"id {ids.max()} is not in the vocabulary")
            self.con.register("given", pa.table({"row": row.astype(np.int32), "pos": pos.astype(np.int32), "id": ids.astype(np.int32)}))
            got = self.con.sql(_DECODE).to_arrow_table()
            self.con.unregister("given")
            for k, text in zip(got.column("row").to_pylist(), got.column("spelled").to_pylist(), strict=True):
                out[at + k] = text.encode("utf-16-le")[::2]
            at = to
        return out


_workers: dict[tuple[str, str], Codec] = {}
memory.keeps("bpe", _workers.clear)


def codec(ranks_path: str, pattern: str) -> Codec:
    """This worker's codec; a worker that serves many tasks builds it once."""
    key = (ranks_path, pattern)
    if key not in _workers:
        _workers[key] = Codec(*key)
    return _workers[key]


def _encoded(batches, ranks_path: str, pattern: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    done = 0
    for batch in batches:
        for part in wordhash.slices(batch, limit=ROUND_BYTES):
            done += 1
            if done % TIDY == 0:
                memory.release()
            yield part, codec(ranks_path, pattern).encode([t or "" for t in part.column("text").to_pylist()])


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian 32-bit)."""

    @memory.task("bpe")
    def run(batches):
        for part, ids in _encoded(batches, ranks_path, pattern):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``bytes`` of rows of ids."""

    @memory.task("bpe")
    def run(batches):
        for batch in batches:
            for part in wordhash.slices(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["doc_id", "ids"]), "ids", ROUND_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codec(ranks_path, pattern).decode([x or b"" for x in part.column(1).to_pylist()]), pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encode, decode the ids, and keep counts and digests of both sides (and the ids themselves, if asked)."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    @memory.task("bpe")
    def run(batches):
        for part, ids in _encoded(batches, ranks_path, pattern):
            back = codec(ranks_path, pattern).decode(ids)
            digests = [pa.array([hashlib.sha256(x).hexdigest() for x in side]) for side in (ids, back)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), *digests, *[pa.array(ids, pa.binary())] * keep_ids], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)
