"""Vector searches against brute force."""

import numpy as np
import pytest

from tessera.llm import covertree, multiindex, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def rows(n=700, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[100:200] = x[100]  # one vector that many rows share
    out = [(i, [float(v) for v in x[i]], 0, "x") for i in range(n)]
    out += [(n, None, 0, "x"), (n + 20, [float("nan")] * dim, 0, "x"), (n + 40, [None] * dim, 0, "x"), (n + 60, [0.0] * dim, 0, "x"), (None, [1.0] * dim, 0, "x"), (n + 80, [], 0, "x"), (3, [float(v) for v in x[3]], 0, "x")]
    return out


def brute(data, k, every, change=lambda v: v, nonzero=False):
    x = {i: change(np.array(v, float)) for i, v, *_ in data if i is not None and v and None not in v and np.isfinite(v).all()}
    if nonzero:
        x = {i: v for i, v in x.items() if v.any()}
    out = set()
    for q in x:
        if q % every == 0:
            best = sorted(((-float(x[q] @ v), i) for i, v in x.items() if i != q))[:k]
            out |= {(q, r + 1, i, round(-s, 9)) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("blocks", [(16384, (4096, 65536)), (7, (90, 90))])
def test_cover_tree_is_exact(spark, blocks, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(vectors, "ROW_BLOCK", blocks[1])
    got = {(r[0], r[1], r[2], float(r[3])) for r in covertree.exact_top_k(spark.createDataFrame(rows(), SCHEMA), 20, 20).collect()}
    assert got == brute(rows(), 20, 20, lambda v: np.floor(64 * v))


def test_dual_search_at_random():
    rng = np.random.default_rng(1)
    for n, d, hi in ((1, 3, 2), (5, 2, 2), (700, 2, 3), (1500, 4, 40), (1200, 3, 1), (2000, 16, 30)):
        x = rng.integers(-hi, hi + 1, (n, d)).astype(float)
        ids = rng.permutation(n * 3)[:n]
        q = ids % 4 == 0
        if q.any():
            place, got, score = covertree.dual_search(ids[q], x[q], ids, x, 20)
            s = x[q] @ x.T
            want = []
            for i in range(len(s)):
                other = ids != ids[q][i]
                o = np.lexsort((ids[other], -s[i][other]))[:20]
                want += [(i, a, b) for a, b in zip(ids[other][o], s[i][other][o], strict=True)]
            assert sorted(zip(place, got, score, strict=True)) == sorted(want)


def test_traversal_takes_best_sums_first():
    rng = np.random.default_rng(2)
    left, right, sizes = rng.normal(size=5), rng.normal(size=6), np.ones((5, 6), int)
    order = multiindex.traverse(left, right, sizes, 30)
    sums = [left[i] + right[j] for i, j in order]
    assert sums == sorted(sums, reverse=True) and len(set(order)) == 30
    assert len(multiindex.traverse(left, right, sizes, 4)) == 4


def test_multi_index_recall_and_scores(spark):
    data = rows(3000, 16)
    got = {(r[0], r[1], r[2], round(r[3], 9)) for r in multiindex.nearest(spark.createDataFrame(data, SCHEMA), 20, 20).collect()}
    want = brute(data, 20, 20, nonzero=True)
    key = lambda s: {(q, i) for q, _, i, _ in s}
    assert len(key(got) & key(want)) >= 0.9 * len(want) and len(got) == len(want)


def test_few_or_no_rows(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0], 0, "")], SCHEMA)
    assert covertree.exact_top_k(one).count() == 0 and multiindex.nearest(one).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0], 0, ""), (1, [1.0], 0, "")], SCHEMA)
    assert [tuple(r) for r in multiindex.nearest(two).collect()] == [(0, 1, 1, 1.0)]
    assert covertree.exact_top_k(one.limit(0)).count() == 0 and multiindex.nearest(one.limit(0)).count() == 0


def test_dual_search_prunes_clusters():
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(60, 16))
    centre = np.rint(2000 * centre / np.linalg.norm(centre, axis=1)[:, None])
    x = np.concatenate([c + rng.integers(-30, 31, (150, 16)) for c in centre]).astype(float)
    ids = rng.permutation(len(x))
    q = ids % 20 == 0
    tally = covertree.Tally()
    place, got, score = covertree.dual_search(ids[q], x[q], ids, x, 20, tally=tally)
    s = x[q] @ x.T
    s[ids[q][:, None] == ids[None]] = -np.inf
    assert sorted(score[place == 0].tolist()) == sorted(np.sort(s[0])[-20:].tolist())
    assert sorted(score.tolist()) == sorted(np.sort(s, 1)[:, -20:].ravel().tolist())
    assert tally.scored < 0.5 * q.sum() * len(x)


def test_cover_tree_sends_queries_only_where_they_may_score(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROW_BLOCK", (100, 100))
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 8))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    data = [(i, [float(v) for v in centre[i % 12] + rng.normal(size=8) * 0.02], 0, "x") for i in range(1200)]
    sent = []
    plain = vectors.visit

    def counting(dealt, visits, *rest):
        sent.append(visits.select("vec_id").count())
        return plain(dealt, visits, *rest)

    monkeypatch.setattr(vectors, "visit", counting)
    got = {(r[0], r[1], r[2], float(r[3])) for r in covertree.exact_top_k(spark.createDataFrame(data, SCHEMA), 20, 20).collect()}
    assert got == brute(data, 20, 20, lambda v: np.floor(64 * v))
    assert len(sent) == 2 and sum(sent) < 60 * 24 / 2


@pytest.mark.parametrize("high", [10**6, 3 * 10**7])
def test_scores_beyond_45_bits(high):
    rng = np.random.default_rng(6)
    x = rng.integers(-high, high + 1, (900, 5)).astype(float)
    x[300:320] = x[300]
    ids = rng.permutation(900)
    q = ids % 20 == 0
    place, got, score = covertree.dual_search(ids[q], x[q], ids, x, 7)
    exact = x[q].astype(np.int64) @ x.astype(np.int64).T
    want = []
    for i, me in enumerate(ids[q]):
        other = ids != me
        o = np.lexsort((ids[other], -exact[i][other]))[:7]
        want += [(i, a, b) for a, b in zip(ids[other][o], exact[i][other][o], strict=True)]
    assert sorted(zip(place, got, score, strict=True)) == sorted(want)
    with pytest.raises(OverflowError):
        covertree.dual_search(ids[q], x[q] * 1e12, ids, x, 7)


def test_multi_index_with_one_block_a_few_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROW_BLOCK", (60, 60))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    data = rows(900, 6, seed=3)
    got = {(r[0], r[2], round(r[3], 9)) for r in multiindex.nearest(spark.createDataFrame(data, SCHEMA), 20, 20, share=1.0).collect()}
    # with every row reranked the index is exact, whatever the blocks
    assert got == {(q, i, s) for q, _, i, s in brute(data, 20, 20, nonzero=True)}
