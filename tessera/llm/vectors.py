"""Shared frame of the vector searches: a stated query set against all rows, block by block.

An index deals rows to blocks of bounded size and says which blocks each query visits.  A
group is a block and those of its visitors that share a query block; only each query's best
``k`` leave it.  Blocks grow in number with the data, not in size: what an index would
put in one larger block (a vector that many rows share, say) is split by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 16_384
ROW_BLOCK = (4_096, 65_536)


def clean(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """``vec_id`` and ``vector`` (doubles) of the rows that take part.

    Vectors null, empty, or with a null or non-finite component are left out (zero
    vectors too, if ``nonzero``), and null ids.  A repeated vec_id counts once, with
    its smallest vector.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))
    rows = rows.where((F.size("vector") > 0) & fine)
    if nonzero:
        rows = rows.where(F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks()
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    offs, values = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
    size = np.diff(offs)
    out = np.zeros((len(size), int(size.max())))
    for width in np.unique(size):  # shorter vectors are as if filled up with zeros
        at = np.flatnonzero(size == width)
        out[at, :width] = values[offs[at][:, None] + np.arange(width)]
    return out


def blocks_of(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For index cells of these sizes, in order: each one's first block, and over how many blocks it is split.

    Neighbouring small cells share a block of about ``limit`` rows.
    """
    parts = np.maximum(1, -(-sizes // limit))
    first = np.zeros(len(sizes), np.int64)
    block, held = 0, 0
    for c, (n, p) in enumerate(zip(sizes.tolist(), parts.tolist(), strict=True)):
        if held and held + n > limit:
            block, held = block + 1, 0
        first[c] = block
        if p > 1:
            block, held = block + p, 0
        else:
            held += n
    return first, parts


def block_limit(n: int) -> int:
    return int(np.clip(n // 32, *ROW_BLOCK))


def matrix(col) -> np.ndarray:
    """A list column as a matrix; shorter vectors are as if filled up with zeros."""
    if len(col) == 0:
        return np.zeros((0, 1))
    return _matrix(col if isinstance(col, pa.ChunkedArray) else pa.chunked_array([col]))


def widen(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))


def visit(rows: DataFrame, visits: DataFrame, k: int, score_type: str, local: Callable) -> DataFrame:
    """Best ``k`` finds of each query in the blocks that it visits: query_id, vec_id, score.

    ``rows`` are (rb, cell, vec_id, vector), ``visits`` (qb, rb, vec_id, vector and what else the index gives along).
    ``local(visitors, queries, members, vectors)`` searches one group: its two tables and their
    matrices; it returns (place of the query, row id, score) arrays without a query's own id.
    """
    kind = pa.float64() if score_type == "double" else pa.int64()
    pairs = visits.select(F.col("qb").alias("by"), F.col("rb").alias("of")).distinct()  # a row a group
    dealt = rows.join(pairs, F.col("rb") == F.col("of")).select(F.col("by").alias("qb"), F.col("of").alias("rb"), "cell", "vec_id", "vector")

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            q, x = _matrix(left.column("vector")), _matrix(right.column("vector"))
            width = max(q.shape[1], x.shape[1])
            ids = left.column("vec_id").to_numpy()
            place, got, score = local(left, widen(q, width), right, widen(x, width))
        else:
            ids, place, got, score = np.zeros(1, np.int64), *(np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": pa.array(ids[place], pa.int64()), "vec_id": pa.array(got, pa.int64()), "score": pa.array(score, kind)})

    return visits.groupBy("qb", "rb").cogroup(dealt.groupBy("qb", "rb")).applyInArrow(pair, f"query_id long, vec_id long, score {score_type}")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of each query's best ``k``; ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
