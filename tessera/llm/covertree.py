"""Exact top-k by inner product: dual-tree search over cover trees.

Queries and rows are each put in a cover tree: a node at scale ``s`` has a centre and
covers its points within ``BASE**s``; its children are a greedy net at the next smaller scale.
Where a net would fall into near-singletons, as in many dimensions, the node takes
``FAN`` of its points as members instead, and small ones stay leaves, scored as one matrix product.  A pair of nodes can score at most
``cq.cx + rq |cx| + rx |cq| + rq rx`` (radii as measured); the pair is dropped when that is
below the worst kth score of any query in the query node.  Pairs are visited from the
highest bound down, so the kth scores rise early.  At a pair of leaves the same bound, for each query by
itself, keeps queries out of the product.  Ties go to the smaller id, and a
bound that equals the kth score is followed.

Across machines the same is done at two levels.  A top tree over a bounded sample gives areas, each
row goes to the nearest centre's area, and an area's radius covers all its rows.  Queries first search their own
area.  With the kth scores found there they go on to those other areas alone that their bound
doesn't rule out, so vectors are sent only where they may score.

Defined results: as ``vectors.clean`` says, and zero vectors take part.  Scores of 45 bits or more take
slower integer products, and a possible score outside 64 bits, which no long holds, is an error.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import memory, store, vectors, wordhash

#: Points of a row leaf and of a query leaf.
LEAF, QUERY_LEAF = 512, 256
PLACE_BITS = 17
#: Rows of the top tree's sample, which also bounds the number of areas.
SAMPLE = 8192
#: Distances come from inner products; radii are widened by more than their rounding.
SLACK = 1e-6
NONE = np.int64(-(2**62))
#: Children smaller than this on average make no better search than their parent's matrix product.
THIN = 4
#: Children of a node whose net is thin.
FAN = 8
#: Ratio of the covering radii of successive scales.
BASE = 1.2


class Node:
    __slots__ = ("centre", "norm", "radius", "points", "children", "worst")

    def __init__(self, centre, radius, points):
        self.centre, self.norm, self.radius, self.points = centre, float(np.linalg.norm(centre)), radius, points
        self.children: list[Node] = []
        self.worst = -np.inf


def build(x: np.ndarray, leaf_size: int = LEAF) -> Node:
    """The cover tree of the rows of ``x``."""
    square = (x * x).sum(1)

    def far(points, centre):
        return np.sqrt(np.maximum(square[points] - 2 * (x[points] @ centre) + centre @ centre, 0))

    def grow(points: np.ndarray, centre: np.ndarray, dist: np.ndarray) -> Node:
        node = Node(centre, float(dist.max()), points)
        if len(points) <= leaf_size or node.radius == 0:
            return node
        groups = net(points, centre, dist, node.radius)
        if len(groups) * THIN > sum(len(g[0]) for g in groups) or sum(len(g[0]) for g in groups) < len(points):
            groups = spread(points, dist)
        if len(groups) > 1:
            node.children = [grow(*g) for g in groups]
        return node

    def net(points, centre, dist, radius):
        """Greedy net at the next smaller scale; given up when it turns thin."""
        total = len(points)
        cover = BASE ** (np.ceil(np.log(radius) / np.log(BASE) - 1e-9) - 1)
        groups, inside, c, d = [], dist <= cover, centre, dist
        while True:
            if inside.any():  # the parent's own centre need not cover a point
                groups.append((points[inside], c, d[inside]))
                points = points[~inside]
            if not len(points) or len(groups) * THIN > total - len(points) + 64:
                return groups
            c = x[points[0]]
            d = far(points, c)
            inside = d <= cover

    def spread(points, dist):
        """Members taken evenly along the node's points; each point goes to its nearest member."""
        members = points[:: -(-len(points) // FAN)]
        d = np.stack([far(points, x[m]) for m in members])
        owner = d.argmin(0)
        groups = [(points[owner == m], x[members[m]], d[m][owner == m]) for m in range(len(members)) if (owner == m).any()]
        # equal points near a member can't be parted by nearness: a group of all points is halved by place
        return groups if len(groups) > 1 else [(h, centre_of(h), far(h, centre_of(h))) for h in np.array_split(points, 2)]

    def centre_of(points):
        return x[points].mean(0)

    mean = x.mean(0)
    everything = np.arange(len(x))
    return grow(everything, mean, far(everything, mean))


@dataclass
class Tally:
    """Query-row pairs that were scored."""

    scored: int = 0


def dual_search(query_ids: np.ndarray, queries: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, k: int, least: np.ndarray | None = None, tally: Tally | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's ``k`` highest-scoring rows of other ids: (place of the query, row id, score).

    With ``least``, a score a query, finds below it are of no use and are left out.
    """
    span = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * queries.shape[1]
    if span >= 2**63:
        raise OverflowError("a score may lie outside 64 bits")
    if len(rows) > 1 << PLACE_BITS:
        raise ValueError("a block holds at most 2**17 rows")
    packed = span < 2**45
    order = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[order], row_ids[order]
    # a packed key holds score and place in one number; places follow ids, so ties go to the smaller id
    last = (1 << PLACE_BITS) - 1
    best = np.full((len(queries), k), NONE, np.int64)
    where = np.full((len(queries), k), len(rows), np.int64)  # used where keys are scores alone
    floor = np.full(len(queries), -np.inf) if least is None else least.astype(float)
    bar = np.where(np.isfinite(floor), np.where(np.isfinite(floor), floor, 0).astype(np.int64) << (PLACE_BITS if packed else 0), NONE)  # the least key of use
    whole_q, whole_x = (None, None) if packed else (queries.astype(np.int64), rows.astype(np.int64))
    length = np.linalg.norm(queries, axis=1)
    q_root, x_root = build(queries, QUERY_LEAF), build(rows)

    def wide(node: Node) -> float:
        return node.radius + SLACK * (1 + node.norm + node.radius)

    def bound(q: Node, x: Node) -> float:
        r, s = wide(q), wide(x)
        return q.centre @ x.centre + r * x.norm + s * q.norm + r * s + 1e-6

    def kth(points: np.ndarray) -> np.ndarray:
        low = best[points, 0]
        return np.maximum(np.where(low == NONE, -np.inf, (low >> PLACE_BITS if packed else low).astype(float)), floor[points])

    def leaf(q: Node, x: Node) -> None:
        reach = queries[q.points] @ x.centre + length[q.points] * wide(x)
        at = q.points[reach + SLACK * (1 + np.abs(reach)) >= kth(q.points)]
        if not len(at):
            return
        if tally is not None:
            tally.scored += len(at) * len(x.points)
        itself = query_ids[at][:, None] == row_ids[x.points][None]
        if packed:
            key = (np.rint(queries[at] @ rows[x.points].T).astype(np.int64) << PLACE_BITS) | (last - x.points)
            key[itself] = NONE
            live = np.flatnonzero((key >= np.maximum(best[at, 0] + 1, bar[at])[:, None]).any(1))
            if len(live):
                both = np.concatenate([best[at[live]], key[live]], 1)
                both.partition(both.shape[1] - k, 1)
                kept = both[:, both.shape[1] - k :]
                kept.sort(1)
                best[at[live]] = kept
        else:
            key = whole_q[at] @ whole_x[x.points].T
            key[itself] = NONE
            both, spot = np.concatenate([best[at], key], 1), np.concatenate([where[at], np.broadcast_to(x.points, key.shape)], 1)
            kept = np.lexsort((-spot, both), axis=1)[:, -k:]
            best[at], where[at] = np.take_along_axis(both, kept, 1), np.take_along_axis(spot, kept, 1)
        q.worst = float(kth(q.points).min())

    def visit(q: Node, x: Node, top: float) -> None:
        if top < q.worst:
            return
        if not q.children and not x.children:
            leaf(q, x)
        elif x.children and (not q.children or x.radius >= q.radius):
            pairs = sorted(((bound(q, c), i) for i, c in enumerate(x.children)), reverse=True)
            for b, i in pairs:
                visit(q, x.children[i], b)
        else:
            for c in q.children:
                visit(c, x, bound(c, x))
            q.worst = min(c.worst for c in q.children)

    def start(q: Node) -> None:
        for c in q.children:
            start(c)
        q.worst = min(c.worst for c in q.children) if q.children else float(kth(q.points).min())

    start(q_root)
    visit(q_root, x_root, np.inf)
    place, rank = np.nonzero((best != NONE) & (best >= bar[:, None]))
    found = best[place, rank]
    if packed:
        return place, row_ids[last - (found & last)], found >> PLACE_BITS
    return place, row_ids[where[place, rank]], found


def centres(x: np.ndarray, n: int) -> np.ndarray:
    """Centres of about ``n`` nodes of the cover tree of ``x`` that hold all its points; the largest node is opened first."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    root = build(x, max(1, len(x) // (4 * n)))
    heap, done = [(-len(root.points), 0, root)], []
    count = 1
    while heap and len(heap) + len(done) < n:
        _, _, node = heapq.heappop(heap)
        if node.children:
            for c in node.children:
                heapq.heappush(heap, (-len(c.points), count, c))
                count += 1
        else:
            done.append(node)
    return np.unique(np.array([node.centre for *_, node in heap] + [node.centre for node in done]), axis=0)


def exact_top_k(embeddings: DataFrame, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """Top ``k`` by integer inner product of ``floor(scale * x)`` vectors, for queries whose vec_id is divisible by ``every``."""
    spark = embeddings.sparkSession
    rows = vectors.clean(embeddings, nonzero=False)
    rows = store.materialise(rows.select("vec_id", F.transform("vector", lambda x: F.floor(x * scale).cast("double")).alias("vector")), "whole-vectors")
    is_query = F.col("vec_id") % every == 0
    total = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max(F.size("vector")).alias("width")).first()
    limit, width = vectors.block_limit(total["n"]), total["width"] or 1
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(SAMPLE).select("vector").toArrow().column("vector")
    top = centres(vectors.widen(vectors.matrix(sample), width), min(SAMPLE // 4, max(1, 2 * total["n"] // limit)))
    shared = spark.sparkContext.broadcast(top)  # at most SAMPLE / 4 centres

    @memory.task("covertree")
    def place(batches):
        mid = shared.value
        square = (mid * mid).sum(1)
        for batch in batches:
            if batch.num_rows:
                x = vectors.widen(vectors.matrix(batch.column(1)), width)
                far = square - 2 * x @ mid.T
                area = far.argmin(1)
                away = np.sqrt(np.maximum(((x - mid[area]) ** 2).sum(1), 0))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(area.astype(np.int32)), pa.array(away)], ["vec_id", "vector", "cell", "away"])

    placed = store.materialise(rows.mapInArrow(place, "vec_id long, vector array<double>, cell int, away double"), "areas")
    sizes, radius = np.zeros(len(top), np.int64), np.zeros(len(top))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():  # at most SAMPLE / 4 rows
        sizes[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    parts = np.maximum(1, -(-sizes // limit))
    first = np.cumsum(parts) - parts
    listed = spark.sparkContext.broadcast((sizes, radius * (1 + SLACK) + SLACK, parts, first))
    query_blocks = max(1, -(-total["q"] // vectors.QUERY_BLOCK))

    @memory.task("covertree")
    def deal(batches):
        _, _, parts, first = listed.value
        for batch in batches:
            cell = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(first[cell] + batch.column(3).to_numpy() % parts[cell]), *batch.columns[:3]], ["rb", "vec_id", "vector", "cell"])

    def route(own: bool):
        @memory.task("covertree")
        def run(batches):
            mid = shared.value
            sizes, radius, parts, first = listed.value
            norm = np.linalg.norm(mid, axis=1)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    piece = batch.slice(at, 256)
                    q = vectors.widen(vectors.matrix(piece.column(1)), width)
                    cell, least = piece.column(2).to_numpy(), piece.column(4).to_numpy(zero_copy_only=False)
                    if own:
                        who, area = np.arange(piece.num_rows), cell
                    else:
                        top = q @ mid.T + np.linalg.norm(q, axis=1)[:, None] * radius[None]
                        top += SLACK * (1 + np.abs(top) + norm[None])
                        go = (top >= np.where(np.isnan(least), -np.inf, least)[:, None]) & (sizes > 0)[None]
                        go[np.arange(piece.num_rows), cell] = False
                        who, area = np.nonzero(go)
                    owner, step = wordhash.ragged(parts[area])
                    taken = piece.take(pa.array(who[owner]))
                    yield pa.RecordBatch.from_arrays([taken.column(3), pa.array(first[area][owner] + step), taken.column(0), taken.column(1), taken.column(4)], ["qb", "rb", "vec_id", "vector", "least"])

        return run

    def local(visitors, queries, members, x):
        least = visitors.column("least").to_numpy()
        return dual_search(visitors.column("vec_id").to_numpy(), queries, members.column("vec_id").to_numpy(), x, k, np.where(np.isnan(least), -np.inf, least))

    visit = "qb int, rb long, vec_id long, vector array<double>, least double"
    dealt = placed.select("vec_id", "vector", "cell", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30)).alias("h")).mapInArrow(deal, "rb long, vec_id long, vector array<double>, cell int")
    asking = placed.where(is_query).select("vec_id", "vector", "cell", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("qb"))
    home = store.materialise(asking.withColumn("least", F.lit(float("nan"))).mapInArrow(route(True), visit), "own-areas")
    near = store.materialise(vectors.visit(dealt, home, k, "long", local), "own-finds")
    kth = vectors.ranked(near, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("least"))
    onward = asking.join(kth, "vec_id", "left").select("vec_id", "vector", "cell", "qb", F.coalesce("least", F.lit(float("nan"))).alias("least"))
    abroad = store.materialise(onward.mapInArrow(route(False), visit), "other-areas")
    return vectors.ranked(near.unionByName(vectors.visit(dealt, abroad, k, "long", local)), k)
