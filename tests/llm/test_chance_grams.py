"""N-grams that unrelated texts share by chance, and tries that hold mostly one component."""

import random

import numpy as np

from tessera.llm import ngramjoin
from tests.llm.test_text_operators import SCHEMA, links


def test_chance_gives_no_blocks(spark, monkeypatch):
    rng = random.Random(8)
    rows = [[i, " ".join(rng.choice("abcdefghijkl") for _ in range(300)), "en", "s", 0] for i in range(60)]  # three-word n-grams: 1,728 in all, most are shared
    rows[7][1] = rows[50][1].replace("a b", "b a", 1)
    tables = {}
    write = ngramjoin.store.materialise

    def keep(df, name):
        tables[name] = out = write(df, name)
        return out

    monkeypatch.setattr(ngramjoin.store, "materialise", keep)
    rule = ngramjoin.Rule(3, 80, 100)
    docs = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    got = {r[0]: (r[1], r[2]) for r in ngramjoin.near_duplicates(docs, rule).collect()}
    assert got == links(rows, 3, 80, 100)
    shared = tables["mixed"].where(f"held > {ngramjoin.SMALL}").groupBy("node", "n").count().collect()
    # a text's most shared n-grams have no block: one fewer than a pair must have in common of them
    spared = [min(r["count"], (least := int(rule.common(rule.need(np.int64(r["n"]))))) - -(-least // 8)) for r in shared]
    assert sum(spared) > 0.2 * sum(r["count"] for r in shared)
    assert 0 < tables["blocks"].count() <= sum(r["count"] for r in shared) - sum(spared)


def test_trie_leaves_branches_of_one_component():
    rule, visited = ngramjoin.Rule(2, 50, 100), []

    class Place(int):
        """Tells when the search looks at it."""

        def __and__(self, other):
            visited.append(self)
            return int(self) & other

    one = [(i, 1, (10, 6, 99), 0, [Place(1), *(Place(2 * (10 * i + k)) for k in range(1, 6))]) for i in range(40)]
    other = (99, 2, (10, 6, 99), 0, list(one[0][4]))
    assert ngramjoin.trie_pairs(1, [*one, other], rule, False) == [(0, 99)]
    assert len(visited) < 41 * 10  # not each with each


def test_rarest_first():
    place, token = ngramjoin._rarest_first(np.array([5, 9, 7, 9]), np.array([35, 2, 34, 2], np.int8), 7)
    assert place.tolist() == [5, 0, 3, 0] and token == 3
