"""Queries read whole tables and whole texts: no id subset, no prefix."""

import re
from types import SimpleNamespace

from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.queries import CATALOG, relations, scalars, state


def test_provenance_has_late_orders(spark):
    t = SimpleNamespace(
        lineitem=spark.createDataFrame([(1, 1, 7, 3), (399, 1, 7, 3), (400, 1, 7, 3), (90000, 2, 8, 4)], "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long"),
        part=spark.createDataFrame([(7, "seven", 30), (8, "eight", 2)], "p_partkey long, p_name string, p_size int"),
        supplier=spark.createDataFrame([(3, "three", 1), (4, "four", 1)], "s_suppkey long, s_name string, s_nationkey int"),
    )
    got = sorted(map(tuple, relations.evidence_provenance(t).collect()))
    assert got == [(1, 1, "seven", "three"), (399, 1, "seven", "three"), (400, 1, "seven", "three"), (90000, 2, "eight", None)]
    assert "WHERE" not in CATALOG["evidence_provenance"][1]


def test_keepset_tags_and_reconcile_read_late_orders(spark):
    lines = spark.createDataFrame([(1, 5, 3, "R", "F"), (60, 4, 3, "R", "O"), (5000, 9, 7, "R", "F"), (5000, 9, 7, "N", "F")], "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string")
    t = SimpleNamespace(lineitem=lines, orders=spark.createDataFrame([(1,), (60,), (5000,), (7000,)], "o_orderkey long"))
    assert sorted(map(tuple, state.retention_keepset(t).collect())) == [(3, "4,5", 4, True), (7, "9", 9, False)]
    tags = {(r["l_orderkey"], r["tag"]): r["n"] for r in scalars.unnest_keep_nulls(t).collect()}
    assert tags == {(1, "R"): 1, (1, "F"): 1, (1, None): 1, (60, "R"): 1, (60, "O"): 1, (60, None): 1, (5000, "R"): 1, (5000, "N"): 1, (5000, "F"): 2, (5000, None): 2}
    ruled = lambda: dict(map(tuple, relations.multiset_reconcile(t).collect()))
    assert ruled() == {"orders_in_lineitem": False, "flags_in_lineitem": True}
    t.orders = t.orders.where("o_orderkey < 7000")
    assert ruled() == {"orders_in_lineitem": True, "flags_in_lineitem": True}


def test_terms_and_masks_reach_the_end_of_long_texts(spark):
    words = [f"w{i}é" for i in range(20_000)]
    text = " ".join(words) + " Last@x aeiou"
    t = SimpleNamespace(documents=spark.createDataFrame([(1, text), (2, "ab"), (3, None)], "doc_id long, text string"))
    got = {r["doc_id"]: r["terms"] for r in scalars.tokenise(t).collect()}
    assert got == {1: " ".join(sorted([*words, "last", "aeiou"])), 2: "ab", 3: None}
    masked = {r["doc_id"]: r["masked"] for r in scalars.scalar_regex_suite(t).collect()}
    assert masked == {1: re.sub("[aeiou]+", "_", text), 2: "_b", 3: None}


def test_graphs_take_every_part(spark):
    n = 300
    t = SimpleNamespace(spark=spark, part=spark.range(n).select(F.col("id").alias("p_partkey")))
    want = set()
    for root in range(n):
        node, depth = root, 0
        want.add((root, node, depth))
        while node > 1:
            node, depth = node // 2, depth + 1
            want.add((root, node, depth))
    assert set(map(tuple, relations.ancestry_closure(t).collect())) == want

    chains = {}
    for root in range(n):
        trail, outcome = [root], "resolved"
        while trail[-1] % 4 and outcome == "resolved":
            nxt = trail[-1] * 3 % (n - 3)
            outcome = "cycle" if nxt in trail else "depth_limit" if len(trail) == 60 else "resolved"
            trail.append(nxt)
        chains[root] = (trail[-1], len(trail) - 1, outcome)
    assert {r["root"]: (r["target"], r["depth"], r["outcome"]) for r in relations.alias_chain(t).collect()} == chains

    seen, edge = {1: 0}, [1]
    for node in edge:
        for nxt in (node * 2 % n, (node * 5 + 1) % n):
            if nxt not in seen:
                seen[nxt] = seen[node] + 1
                edge.append(nxt)
    assert dict(map(tuple, relations.frontier_closure(t).collect())) == seen and max(seen) > 101


def test_walks_have_no_row_limit(spark):
    roots = spark.range(1_000_001).select(F.col("id").alias("node"))
    assert graph.walk(spark, spark.createDataFrame([(1, 2)], "src long, dst long"), roots, 3).count() == 1_000_002
