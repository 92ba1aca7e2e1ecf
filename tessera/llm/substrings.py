"""Removal of passages that repeat: every word in a window of ``width`` words that starts anywhere else too.

Each window has a minimiser, the least hash among its ``gram``-word runs (leftmost of equals), so
equal windows share it.  Successive windows with one minimiser make a segment.  Equal segments are
counted as one with a weight before anything else is done with them.  Segments whose
minimiser occurs once can't repeat and go no further.  The others are dealt to
shards by minimiser, so a shard holds every occurrence
of its windows.  Each shard builds an FM-index of its segments and streams them through
it: matching statistics by backward search over a wavelet matrix, windows of ``width`` or more
with a weighted count of two or more being reported.  Reports go back by segment to the
texts that hold it.

Minimisers with more than ``HOT`` different segments (the edges of a passage that very many texts
share) are dealt window by window, keyed also by both ends of the window; keys that occur
once are dropped.  So shards stay bounded by number, whatever one passage holds.  Tables are written before
they are joined on a key that may be hot, since adaptive execution splits only joins of plain exchanges.  Words are
compared as 64-bit hashes, texts and segments told apart by 128 bits.

Defined results: null and empty texts have no words; texts shorter than a window keep all;
windows may overlap their own repeats; equal texts and rows of one or no doc_id are
separate documents.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import memory, store, wordhash as wh
from tessera.llm.fmindex import FMIndex, matching_statistics

GRAM = 8
#: Words that a shard indexes, about.
SHARD_WORDS = 400_000
HOT = 4096
_PLACE = 26


def segments(h: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, minimiser's hash and text of every segment; texts are ``h[at[i]:at[i + 1]]``."""
    none = np.zeros(0, np.int64)
    if len(h) < width:
        return none, none, none, none
    grams = wh.window_hashes(h, GRAM)
    span = width - GRAM + 1
    keys = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
    low, have = keys, 1
    while have < span:  # sliding minimum by doubling
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    best = (low & np.uint64((1 << _PLACE) - 1)).astype(np.int64)  # by window: place of its minimiser
    count = np.maximum(np.diff(at) - width + 1, 0)
    owner, place = wh.ragged(count)
    window = at[:-1][owner] + place
    m = best[window]
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return window[first], np.diff(np.append(first, len(m))), grams[m[first]].view(np.int64), owner[first]


#: What tells a text, and a segment, from others.
TEXT, NAME = ["tid", "tid2"], ["minimiser", "n1", "n2"]


def describe(docs: DataFrame, width: int) -> DataFrame:
    """A row for each different text: ``TEXT``, ``copies`` and its segments (start, windows, ``NAME``)."""

    @memory.task("substrings")
    def run(batches):
        for batch in batches:
            for part in wh.slices(batch):
                data, offs = wh.text_buffers(part.column("text"))
                starts, ends, at = wh.words(data, offs)
                h = wh.word_hashes(data, starts, ends)
                window, count, minimiser, owner = segments(h, at, width)
                names = [wh.run_hashes(x, window, window + count + width - 1).view(np.int64) if len(window) else np.zeros(0, np.int64) for x in (h, wh.mix(h + np.uint64(1)))]
                cut = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cut, pa.array(v, t)) for v, t in ((window - at[:-1][owner], pa.int32()), (count, pa.int32()), (minimiser, pa.int64()), *((n, pa.int64()) for n in names))]
                yield pa.RecordBatch.from_arrays([part.column("tid"), part.column("tid2"), *lists], [*TEXT, "start", "windows", *NAME])

    rows = docs.select(*TEXT, "text").mapInArrow(run, "tid long, tid2 long, start array<int>, windows array<int>, minimiser array<long>, n1 array<long>, n2 array<long>").where(F.size("start") > 0)
    return rows.groupBy(*TEXT).agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("start", "windows", *NAME)))


def occurrences(texts: DataFrame) -> DataFrame:
    return texts.select(*TEXT, "copies", F.explode(F.arrays_zip("start", "windows", *NAME)).alias("s")).select(*TEXT, "copies", "s.*")


def repeated_segments(texts: DataFrame) -> DataFrame:
    """Segments whose minimiser occurs twice or more, once each, with their weight and one place that holds them."""
    each = occurrences(texts)
    one = each.groupBy(*NAME).agg(F.sum("copies").alias("weight"), F.min(F.struct(*TEXT, "start", "windows")).alias("r"))
    one = store.materialise(one.select(*NAME, "weight", "r.*"), "segments")
    often = one.groupBy("minimiser").agg(F.sum("weight").alias("held"), F.count("*").alias("forms")).where("held > 1")
    often = store.materialise(often.select("minimiser", (F.col("forms") > HOT).alias("hot")), "minimisers")
    out = store.materialise(one.join(often, "minimiser"), "segments")
    store.discard(one, often)
    return out


def contents(docs: DataFrame, once: DataFrame, width: int) -> DataFrame:
    """Each segment with the hashes of its words, fetched from one text that holds it; hot minimisers window by window."""
    asked = once.groupBy(*TEXT).agg(F.collect_list(F.struct("start", "windows", *NAME, "weight", "hot")).alias("asked"))

    @memory.task("substrings")
    def run(batches):
        for batch in batches:
            for part in wh.slices(batch):
                data, offs = wh.text_buffers(part.column("text"))
                starts, ends, at = wh.words(data, offs)
                h = wh.word_hashes(data, starts, ends)
                flat = part.column("asked").flatten()
                start, windows, minimiser, n1, n2, weight, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(7))
                owner = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(part.column("asked")).to_numpy())
                begin = at[:-1][owner] + start
                warm = ~hot
                which, j = wh.ragged(np.where(hot, windows, 0))
                lo = np.concatenate([begin[warm], begin[which] + j])
                size = np.concatenate([windows[warm] + width - 1, np.full(len(which), width)])
                key = minimiser[warm]
                if len(which):
                    grams = wh.window_hashes(h, GRAM)
                    at_j = begin[which] + j
                    ends_hash = wh.mix(minimiser[which].view(np.uint64) ^ wh.mix(grams[at_j]) ^ wh.mix(wh.mix(grams[at_j + width - GRAM]) + np.uint64(1)))
                    key = np.concatenate([key, ends_hash.view(np.int64)])
                row, place = wh.ragged(size)
                raw = h[lo[row] + place]
                cut = (np.concatenate([[0], np.cumsum(size)]) * 8).astype(np.int32)
                blob = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(raw.tobytes())])
                both = np.concatenate([np.flatnonzero(warm), which])
                number = np.concatenate([np.zeros(int(warm.sum()), np.int32), j.astype(np.int32)])
                single = np.arange(len(both)) >= warm.sum()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, minimiser[both], n1[both], n2[both], number, weight[both], single)] + [blob], ["key", *NAME, "first", "weight", "single", "words"])

    # equal texts may lie in several rows: any one of them will do, and aggregation settles on one a task
    return docs.groupBy(*TEXT).agg(F.first("text").alias("text")).join(asked, TEXT).select("text", "asked").mapInArrow(run, "key long, minimiser long, n1 long, n2 long, first int, weight long, single boolean, words binary")


def report(given: DataFrame, width: int, parts: int) -> DataFrame:
    """Per segment the numbers of its windows that repeat, found shard by shard."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        blob = table.column("words").cast(pa.large_binary()).combine_chunks()
        blob = pa.concat_arrays(blob.chunks) if isinstance(blob, pa.ChunkedArray) else blob
        data, offs = wh.text_buffers(blob)
        weight = table.column("weight").to_numpy()
        size = np.diff(offs) // 8
        row, place = wh.ragged(size + 1)  # one separator behind each
        text = np.zeros(len(row), np.int64)
        word = place < size[row]
        _, number = np.unique(data.view(np.uint64), return_inverse=True)
        text[word] = number + 1
        index = FMIndex(text, weight[row], 64 if width <= 37 else 2 * width)
        begin = np.cumsum(size + 1) - (size + 1)
        windows = size - width + 1
        owner, j = wh.ragged(np.where(weight > 1, 0, windows))
        length = matching_statistics(index, text, begin[owner] + j + width - 1, width)
        hit = length >= width
        every, number = wh.ragged(np.where(weight > 1, windows, 0))  # a segment that occurs twice repeats as a whole
        owner, j = np.concatenate([owner[hit], every]), np.concatenate([j[hit], number])
        j = j + table.column("first").to_numpy()[owner]
        order = np.argsort(owner, kind="stable")
        some, begin = np.unique(owner[order], return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(order)), pa.int32()), pa.array(j[order], pa.int32()))
        return pa.table({**{c: table.column(c).combine_chunks().take(pa.array(some)) for c in NAME}, "repeated": lists})

    dealt = given.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(parts)))
    found = dealt.groupBy("shard").applyInArrow(run, "minimiser long, n1 long, n2 long, repeated array<int>")
    # at most a row for each window of a segment
    return found.groupBy(*NAME).agg(F.flatten(F.collect_list("repeated")).alias("repeated"))


def drop_repeats(docs: DataFrame, width: int = 35) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, the kept words' digest and ``kept``, the kept words joined by a space."""
    if width < GRAM:
        raise ValueError(f"windows have at least {GRAM} words")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"tid": F.xxhash64("text"), "tid2": F.xxhash64(F.lit(1), "text")})
    texts = store.materialise(describe(rows, width), "texts")
    once = repeated_segments(texts)
    given0 = given = store.materialise(contents(rows, once, width), "contents")
    store.discard(once)
    lone = given.where("single").groupBy("key").agg(F.sum("weight").alias("n")).where("n > 1").select("key")
    given = given.where("NOT single").unionByName(given.where("single").join(lone, "key").select(given.columns))
    total = given.agg(F.sum(F.octet_length("words")).alias("n")).first()["n"] or 0
    marks = store.materialise(report(given, width, max(1, -(-int(total) // (8 * SHARD_WORDS)))), "repeated")
    store.discard(given0)
    hits = occurrences(texts).select(*TEXT, "start", *NAME).join(marks, NAME).groupBy(*TEXT).agg(F.collect_list(F.struct("start", "repeated")).alias("hits"))
    hits = store.materialise(hits, "hits")
    store.discard(texts, marks)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    @memory.task("substrings")
    def run(batches):
        for batch in batches:
            for part in wh.slices(batch):
                texts, hits = part.column("text").to_pylist(), part.column("hits")
                kept, n_words, n_removed = [], [], []
                for i, text in enumerate(texts):
                    words = text.encode().split()
                    n_words.append(len(words))
                    if hits[i].is_valid:
                        flat = hits[i].values
                        start, lists = flat.field("start").to_numpy(), flat.field("repeated")
                        begin = np.repeat(start, pa.compute.list_value_length(lists).to_numpy()) + lists.flatten().to_numpy()
                        cover = np.zeros(len(words) + 1, np.int64)
                        np.add.at(cover, begin, 1)
                        np.add.at(cover, begin + width, -1)
                        keep = np.cumsum(cover)[:-1] == 0
                        words = list(compress(words, keep.tolist()))
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array([k.decode() for k in kept])], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.join(hits, TEXT, "left").select("doc_id", "text", "hits").mapInArrow(run, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, kept string")
