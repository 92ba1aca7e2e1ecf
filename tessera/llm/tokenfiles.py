"""Encode a corpus to token ids and keep them in Huffman-coded shard files (see ``huffman``).

The tokenizer's pre-tokenizer never joins across ASCII white space, and its normalizer
(NFC, white space folding, lower case) composes nothing across it.  In a chunk between
white space that is plain ASCII, without an apostrophe and without the first byte of an added
token, every run of letters, every digit and every run of other characters is one pre-token.  So
these, and all other chunks as they are, are encoded once per worker through the library
and their ids are reused; the ids are those of encoding the whole text.  Finding,
looking up and gathering them works on whole slices in numpy.

Defined results: null and empty texts have the end id alone; rows that share a doc_id (or have none)
keep a row each, null first, equal ids in the order of their token ids.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import huffman, memory, store, wordhash

#: Distinct pieces that a worker remembers (about 40 bytes each); those unused for longest go when full.
REMEMBERED = 1_000_000
#: Ids in a shard file, about.
SHARD_IDS = 4 << 20

_CLASS = np.full(256, 3, np.uint8)  # 0 white space, 1 letter, 2 digit, 3 other
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32


class PieceEncoder:
    """Ids of texts by way of their distinct pieces; one per Python worker, whatever tasks it serves."""

    def __init__(self, tokenizer_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        vocabulary = self._tokenizer.get_vocab()
        if len(vocabulary) > 1 << 16:
            raise ValueError("ids are kept in 16 bits; this vocabulary is larger")
        self._closes = np.zeros(1 << 16, bool)  # ids that end a pre-token
        self._closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._odd = np.zeros(256, bool)  # bytes whose chunk is a piece as a whole
        self._odd[:32] = self._odd[127:] = self._odd[ord("'")] = True
        self._odd[[t.content.encode()[0] for t in self._tokenizer.get_added_tokens_decoder().values()]] = True
        self._round = 0
        # by falling or rising time of use nothing is ordered here: keys rise, the rest lies along them
        self._key, self._check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self._at, self._size, self._used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._pool = np.zeros(0, np.uint16)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        got = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(g.ids, np.uint16) for g in got]

    def _pieces(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes with plain chunks lowered, starts and ends of all pieces, and whether each is an odd chunk."""
        starts, ends, _ = wordhash.words(data, offs)
        kind = _CLASS[data]
        held = np.concatenate([[0], np.cumsum(self._odd[data] & (kind > 0))])
        odd = held[ends] > held[starts]
        whole = np.zeros(len(data), bool)
        whole[kind > 0] = np.repeat(odd, ends - starts)
        first = kind == 2
        first[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0)
        first &= ~whole
        first[starts] = True
        begin = np.flatnonzero(first)
        chunk = np.searchsorted(starts, begin, "right") - 1
        end = np.append(begin[1:], 0)
        last = np.append(chunk[1:] != chunk[:-1], True)[: len(begin)]
        end[last] = ends[chunk[last]]
        return np.where(whole, data, _LOWERED[data]), begin, end, odd[chunk]

    def _learn(self, pieces: list[bytes], odd: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces laid end to end, and their numbers.

        Pieces of a known number of pre-tokens are encoded many as one text, and cut at the closing ids.
        """
        spelled, tokens, alone = [], [], []
        for i, (piece, is_odd) in enumerate(zip(pieces, odd, strict=True)):
            if not is_odd:
                spelled.append(piece)
                tokens.append(1)
                continue
            word = piece.rstrip(b".,")
            if not word.isascii() and _one_letter_run(word.decode()):
                tail = piece[len(word) :]
                spelled.append(word + b" " + tail if tail else word)
                tokens.append(2 if tail else 1)
            else:
                spelled.append(b"")
                tokens.append(0)
                alone.append(i)
        out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(pieces)
        for k in range(0, len(alone), 8192):
            some = alone[k : k + 8192]
            for i, ids in zip(some, self._plain([pieces[i].decode() for i in some]), strict=True):
                out[i] = ids
        joined = [i for i in range(len(pieces)) if tokens[i]]
        groups = [joined[k : k + 256] for k in range(0, len(joined), 256)]
        for k in range(0, len(groups), 64):
            some = groups[k : k + 64]
            for group, ids in zip(some, self._plain([b" ".join([spelled[i] for i in g]).decode() for g in some]), strict=True):
                close = np.flatnonzero(self._closes[ids]) + 1
                upto = np.cumsum([tokens[i] for i in group])
                cut = close[upto - 1].tolist() if len(close) == upto[-1] else None
                parts = map(ids.__getitem__, map(slice, [0, *cut], cut)) if cut else self._plain([pieces[i].decode() for i in group])
                for i, part in zip(group, parts, strict=True if not cut else False):
                    out[i] = part
        return np.concatenate([*out, np.zeros(0, np.uint16)]), np.array([len(x) for x in out], np.int64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(self._key, keys), max(len(self._key) - 1, 0))
        return place, self._key[place] == keys if len(self._key) else np.zeros(len(keys), bool)

    def _forget(self) -> None:
        keep = self._used > np.partition(self._used, len(self._used) // 2)[len(self._used) // 2]
        row, place = wordhash.ragged(self._size[keep])
        self._pool = self._pool[self._at[keep][row] + place]
        self._key, self._check, self._size, self._used = (x[keep] for x in (self._key, self._check, self._size, self._used))
        self._at = np.cumsum(self._size) - self._size

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """16-bit ids of all texts laid end to end, and ``n + 1`` offsets."""
        if len(self._key) > REMEMBERED:
            self._forget()
        self._round += 1
        data, begin, end, odd = self._pieces(data, offs)
        hashes, other = wordhash.word_hashes(data, begin, end), wordhash.word_hashes(data, begin, end, other=True)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place, known = self._find(keys)
        fresh = first[~known]
        if len(fresh):
            raw = data.tobytes()
            ids, size = self._learn([raw[a:b] for a, b in zip(begin[fresh].tolist(), end[fresh].tolist(), strict=True)], odd[fresh].tolist())
            to = np.searchsorted(self._key, keys[~known])
            self._at = np.insert(self._at, to, len(self._pool) + np.cumsum(size) - size)
            self._size = np.insert(self._size, to, size)
            self._used = np.insert(self._used, to, self._round)
            self._check = np.insert(self._check, to, other[fresh])
            self._key = np.insert(self._key, to, keys[~known])
            self._pool = np.concatenate([self._pool, ids])
            place, _ = self._find(keys)
        if len(keys) and not (self._check[place][inverse] == other).all():
            raise ValueError("two pieces of text share a 64-bit hash")  # expected once in 10**13 distinct pieces of a worker
        if len(keys):
            self._used[place] = self._round
        size, at = (self._size[place][inverse], self._at[place][inverse]) if len(keys) else (np.zeros(0, np.int64),) * 2
        upto = np.concatenate([[0], np.cumsum(size)])
        gather = np.repeat(at - upto[:-1], size) + np.arange(upto[-1])
        return self._pool[gather], upto[np.searchsorted(begin, offs)]


def _one_letter_run(word: str) -> bool:
    """Whether the normalizer leaves a word one run of letters, so that it is one pre-token whatever follows."""
    return word.isalpha() and word.lower().isalpha() and unicodedata.is_normalized("NFC", word)


_encoders: dict[str, PieceEncoder] = {}
memory.keeps("tokenfiles", _encoders.clear)


def _encoder(tokenizer_path: str) -> PieceEncoder:
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = PieceEncoder(tokenizer_path)
    return _encoders[tokenizer_path]


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """``doc_id`` and ``ids`` (16-bit, little-endian, closed by ``end_id``)."""

    @memory.task("tokenfiles")
    def run(batches):
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            for part in wordhash.slices(batch):
                ids, cut = encoder.encode(*wordhash.text_buffers(part.column("text")))
                n = part.num_rows
                out = np.insert(ids.astype("<u2"), cut[1:], end_id)
                offs = (2 * (cut + np.arange(n + 1))).astype(np.int32)
                packed = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), packed], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def global_counts(encoded: DataFrame) -> np.ndarray:
    """Occurrences of every id (at most 65,536 rows reach the driver)."""

    @memory.task("tokenfiles")
    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            data, _ = _binary(batch.column(0))
            total += np.bincount(data.view("<u2"), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": at.astype(np.int32), "n": total[at]})

    rows = encoded.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << 16, np.int64)
    out[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return out


def _binary(col) -> tuple[np.ndarray, np.ndarray]:
    col = col.cast(pa.large_binary())
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def write_shards(encoded: DataFrame, folder: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Shard files in ascending doc_id order; returns ``path``, ``part``, ``number`` and ``tokens`` of each.

    ``encoded`` is read twice (counts, then files), so it should be a written table.
    Range partitions grow in number with the corpus; each is written file by file.
    """
    counts = global_counts(encoded)
    lengths = huffman.code_lengths(counts)
    shared = encoded.sparkSession.sparkContext.broadcast(lengths)  # 64 KB
    parts = max(8, int(-(-int(counts.sum()) // shard_ids)))

    @memory.task("tokenfiles")
    def run(batches):
        from pyspark import TaskContext

        size = shared.value
        codes = huffman.canonical_codes(size)
        part, held, total, done = TaskContext.get().partitionId(), [], 0, []

        def close():
            nonlocal held, total
            path = f"{folder}/part-{part:06d}-{len(done):05d}.hufids"
            docs, nulls = np.concatenate([h[0] for h in held]), sum(h[3] for h in held)
            n = np.concatenate([h[1] for h in held])
            store.write_file(path, [huffman.pack_shard(docs, n, np.concatenate([h[2] for h in held]), size, codes, nulls)])
            done.append((path, part, len(done), total))
            held, total = [], 0

        for batch in batches:
            at, limit = 0, 0
            while at < batch.num_rows:
                limit = min(batch.num_rows, at + 512)
                piece = batch.slice(at, limit - at)
                data, offs = _binary(piece.column(1))
                ids = data.view("<u2")
                held.append((piece.column(0).fill_null(0).to_numpy(), np.diff(offs) // 2, ids.copy(), piece.column(0).null_count))
                total += len(ids)
                if total >= shard_ids:
                    close()
                at = limit
        if held:
            close()
        if done:
            yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "part": pa.array([d[1] for d in done], pa.int32()), "number": pa.array([d[2] for d in done], pa.int32()), "tokens": [d[3] for d in done]})

    dealt = encoded.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    return dealt.select("doc_id", "ids").mapInArrow(run, "path string, part int, number int, tokens long")


def read_shards(files: DataFrame, keep_ids: bool = True) -> DataFrame:
    """Decode the files of ``write_shards``: per document ``start``, ``n_tokens``, ``ids_crc32`` and, if asked, its ``ids``.

    Only a row per shard file reaches the driver, to lay the files' starts end to end.
    """
    rows = sorted(files.collect(), key=lambda r: (r["part"], r["number"]))
    starts = np.cumsum([0] + [r["tokens"] for r in rows])
    spark = files.sparkSession
    listed = spark.createDataFrame([(r["path"], int(s)) for r, s in zip(rows, starts, strict=False)], "path string, start long")

    @memory.task("tokenfiles")
    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs, n, ids, nulls = huffman.unpack_shard(store.read_file(path))
                end = np.cumsum(n)
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(end - n, end, strict=True)]
                for k in range(0, len(docs), 2000):
                    to = min(k + 2000, len(docs))
                    columns = [pa.array(docs[k:to], mask=np.arange(k, to) < nulls), pa.array(start + (end - n)[k:to]), pa.array(n[k:to]), pa.array(crc[k:to], pa.int64())]
                    if keep_ids:
                        offs = np.concatenate([[0], end[k:to] - (end[k] - n[k])]).astype(np.int32)
                        columns.append(pa.ListArray.from_arrays(pa.array(offs), pa.array(raw[end[k] - n[k] : end[to - 1]].astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return listed.repartition(max(1, len(rows))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids)
