"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised separately (k-means over a bounded sample), and
rows are listed by their pair of centroids, their cell.  One index holds the whole table: cell
sizes are counted over all rows, and cells in order make up the blocks that rows are dealt to.
A query ranks the cells by the sum of its halves' inner products with the two centroids: a heap
walks the pairs from the best sum down (multi-sequence traversal) until the cells hold
``SHARE`` of all rows, and never fewer than ``k`` besides itself.  It goes to the blocks of those
cells alone, and their entries are reranked by the exact inner product.

Quality: recall of the 20 nearest against brute force is in the README; ``SHARE`` sets it.
Defined results: as ``vectors.clean`` says; zero vectors take no part; ties go to the
smaller id; with fewer candidates than ``k`` all are returned.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import memory, store, vectors, wordhash

#: Centroids of a half, and the most rows that they are fitted on.
CENTROIDS = 128
SAMPLE = 8_000
#: Part of all rows that a query reranks.
SHARE = 0.45


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's algorithm from k-means++-like seeds; fewer centroids if there are fewer distinct points."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    rng = np.random.default_rng(seed)
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        owner = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        count = np.bincount(owner, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, owner, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def traverse(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, want: int) -> list[tuple[int, int]]:
    """Centroid pairs with entries in order of falling ``left[i] + right[j]``, until they list ``want`` of them.

    The heap holds the next pair of every row opened so far; a row is opened when the one above is first left.
    """
    a, b = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    u, v = left[a].tolist(), right[b].tolist()
    rows = sizes[a][:, b].tolist()
    heap, out, got = [(-(u[0] + v[0]), 0, 0)], [], 0
    while heap and got < want:
        _, i, j = heap[0]
        if rows[i][j]:
            out.append((i, j))
            got += rows[i][j]
        if j + 1 < len(v):
            heapq.heapreplace(heap, (-(u[i] + v[j + 1]), i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(u):
            heapq.heappush(heap, (-(u[i + 1] + v[0]), i + 1, 0))
    return [(int(a[i]), int(b[j])) for i, j in out]


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, components added in order."""
    out = np.zeros(len(a))
    for c in range(a.shape[1]):
        out += a[:, c] * b[:, c]
    return out


class Quantiser:
    """Centroids of both halves; components beyond those of the sample are not indexed, only reranked."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        self.cells = len(first) * len(second)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half, width = self.first.shape[1], self.first.shape[1] + self.second.shape[1]
        x = vectors.widen(x, width)
        return x[:, :half], x[:, half:width]

    def cell(self, x: np.ndarray) -> np.ndarray:
        near = lambda v, c: ((c**2).sum(1) - 2 * v @ c.T).argmin(1)
        a, b = self.halves(x)
        return near(a, self.first) * len(self.second) + near(b, self.second)


def rerank(query_ids: np.ndarray, queries: np.ndarray, asked: list[np.ndarray], row_ids: np.ndarray, rows: np.ndarray, cell: np.ndarray, k: int, at_once: int = 128):
    """Each query's best ``k`` among the rows of the cells that it asks for."""
    order = np.argsort(cell, kind="stable")
    rows, row_ids, cell = rows[order], row_ids[order], cell[order]
    held, begin = np.unique(cell, return_index=True)
    cut = np.append(begin, len(cell))
    places, got, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for at in range(0, len(queries), at_once):
        some = np.arange(at, min(at + at_once, len(queries)))
        table = queries[some] @ rows.T
        wanted = np.zeros((len(some), len(held)), bool)
        for r, i in enumerate(some):
            c = np.searchsorted(held, asked[i])
            c[c == len(held)] = 0
            wanted[r, c[held[c] == asked[i]]] = True
        table[~np.repeat(wanted, np.diff(cut), axis=1)] = -np.inf
        table[query_ids[some][:, None] == row_ids[None]] = -np.inf
        n = min(k, len(rows))
        floor = np.partition(table, len(rows) - n, 1)[:, len(rows) - n]
        # the product's rounding may differ from the ordered sum's: keep what is as good as the kth but for that
        r, p = np.nonzero((table >= (floor - 1e-12 * (1 + np.abs(floor)))[:, None]) & (table > -np.inf))
        score = inner(queries[some[r]], rows[p])
        rank = np.lexsort((row_ids[p], -score, r))
        r, p, score = r[rank], p[rank], score[rank]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        places.append(some[r[keep]])
        got.append(row_ids[p[keep]])
        scores.append(score[keep])
    return np.concatenate(places), np.concatenate(got), np.concatenate(scores)


def fit(rows: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE) -> Quantiser:
    """Centroids of both halves, from at most ``sample`` rows picked by a hash of their id."""
    picked = rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(sample).select("vector").toArrow().column("vector")
    x = vectors.matrix(picked) if len(picked) else np.zeros((1, 1))
    half = (x.shape[1] + 1) // 2
    return Quantiser(kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids) if x.shape[1] > half else np.zeros((1, 0)))


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, share: float = SHARE) -> DataFrame:
    """Top ``k`` by inner product for queries whose vec_id is divisible by ``every``."""
    spark = embeddings.sparkSession
    rows = vectors.clean(embeddings, nonzero=True)
    quantiser = fit(rows)
    shared = spark.sparkContext.broadcast(quantiser)  # two small matrices of fixed size

    @memory.task("multiindex")
    def place(batches):
        for batch in batches:
            if batch.num_rows:
                cell = shared.value.cell(vectors.matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["vec_id", "vector", "cell"])

    placed = store.materialise(rows.select("vec_id", "vector").mapInArrow(place, "vec_id long, vector array<double>, cell int"), "multi-index")
    is_query = F.col("vec_id") % every == 0
    counted = placed.groupBy("cell").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("queries")).collect()  # at most CENTROIDS ** 2 rows
    sizes = np.zeros(quantiser.cells, np.int64)
    for r in counted:
        sizes[r["cell"]] = r["n"]
    n = int(sizes.sum())
    first, parts = vectors.blocks_of(sizes, vectors.block_limit(n))
    listed = spark.sparkContext.broadcast((sizes, first, parts))  # three numbers a cell
    want = max(int(np.ceil(n * share)), min(k + 1, n))
    query_blocks = max(1, -(-sum(r["queries"] for r in counted) // vectors.QUERY_BLOCK))

    @memory.task("multiindex")
    def deal(batches):
        _, first, parts = listed.value
        for batch in batches:
            cell = batch.column(2).to_numpy()
            block = first[cell] + batch.column(3).to_numpy() % parts[cell]
            yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns[:3]], ["rb", "vec_id", "vector", "cell"])

    @memory.task("multiindex")
    def route(batches):
        sizes, first, parts = listed.value
        index = shared.value
        table = sizes.reshape(len(index.first), len(index.second))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                a, b = index.halves(vectors.matrix(piece.column(1)))
                left, right = a @ index.first.T, b @ index.second.T
                who, block, cells = [], [], []
                for r in range(piece.num_rows):
                    c = np.array([i * len(index.second) + j for i, j in traverse(left[r], right[r], table, want)])
                    owner, step = wordhash.ragged(parts[c])
                    target = first[c][owner] + step
                    order = np.argsort(target, kind="stable")
                    stop, at_block = np.unique(target[order], return_index=True)
                    who += [r] * len(stop)
                    block += stop.tolist()
                    cells += np.split(c[owner][order].astype(np.int32), at_block[1:])
                taken = piece.take(pa.array(who, pa.int64()))
                yield pa.RecordBatch.from_arrays([taken.column(2), pa.array(block, pa.int64()), taken.column(0), taken.column(1), pa.array(cells, pa.list_(pa.int32()))], ["qb", "rb", "vec_id", "vector", "cells"])

    def local(visitors, queries, members, x):
        asked = [c.values.to_numpy() for c in visitors.column("cells").combine_chunks()]
        return rerank(visitors.column("vec_id").to_numpy(), queries, asked, members.column("vec_id").to_numpy(), x, members.column("cell").to_numpy(), k)

    dealt = placed.select("vec_id", "vector", "cell", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30)).alias("h")).mapInArrow(deal, "rb long, vec_id long, vector array<double>, cell int")
    asking = placed.where(is_query).select("vec_id", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("qb"))
    visits = store.materialise(asking.mapInArrow(route, "qb int, rb long, vec_id long, vector array<double>, cells array<int>"), "visits")
    return vectors.ranked(vectors.visit(dealt, visits, k, "double", local), k)
