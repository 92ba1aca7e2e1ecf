import pytest
from pyspark.sql import functions as F

from tessera.functions.identity import relation_digest, row_fingerprint
from tessera.functions.text import path_suffix, query_terms, terms, url_parts
from tessera.operators import graph
from tessera.operators.relational import InvariantError, after, budget_prefix, changed_keys, consensus, distinct_rows, holds_all, keep_best, page_boundary, pick, require_empty, touching, under
from tessera.plans import policy, search


def test_terms_keep_two_byte_words(spark):
    assert query_terms("Runtime runtime :: Widget é x") == ["runtime", "widget", "é"]
    row = spark.createDataFrame([("Runtime runtime :: Widget é x",)], "t string").select(terms(F.col("t")).alias("x")).first()
    assert row["x"] == ["runtime", "widget", "é"]
    with pytest.raises(ValueError):
        query_terms(" ".join(f"w{i}" for i in range(65)))


def test_symbol_scores(spark):
    rows = spark.createDataFrame([("a::b", "b", None, "a needle here", None, False), ("m::X", "X", None, None, None, False), ("m::Y", "Y", None, None, None, True)], "path string, name string, sig string, sum string, docs string, re boolean")
    rank = lambda q: {r["name"]: r["r"] and (r["r"]["score"], [f["factor"] for f in r["r"]["factors"]]) for r in rows.select("name", search.rank_symbol(q, *map(F.col, ("path", "name", "sig", "sum", "docs", "re"))).alias("r")).collect()}
    assert rank("needle") == {"b": (85, ["summary_token", "definition_path"]), "X": None, "Y": None}
    assert rank("X")["X"] == (805, ["path_suffix", "definition_path"])


def test_empty_query_matches_nothing(spark):
    rows = spark.createDataFrame([("", "text")], "s string, t string")
    assert rows.select(search.rank_fragment("  ", F.col("s"), F.col("t")).alias("r")).first()["r"] is None


def test_dedupe_keeps_conflicting_rows(spark):
    rows = spark.createDataFrame([("a", (None, [1])), ("a", (None, [1])), ("a", ("", [1])), ("b", ("x", []))], "id string, value struct<o: string, s: array<int>>")
    assert distinct_rows(rows).count() == 3


def test_fingerprint_tells_null_from_empty_and_orders_lists(spark):
    rows = spark.createDataFrame([(None, [1, 2], {"a": 1}), ("", [1, 2], {"a": 1}), (None, [2, 1], {"a": 1}), (None, None, {"a": 1})], "s string, l array<int>, m map<string,int>")
    assert rows.select(row_fingerprint(rows).alias("h")).distinct().count() == 4


def test_digest_ignores_order_partitions_and_repeats(spark):
    a = spark.range(50).withColumn("x", F.col("id") % 7)
    b = a.unionByName(a).repartition(9).orderBy(F.rand(3))
    assert relation_digest(a).first() == relation_digest(b).first()
    assert relation_digest(a).first() != relation_digest(a.where("id < 49")).first()
    assert relation_digest(a.limit(0)).first()["rows"] == 0


def test_keyset_page_is_strict(spark):
    rows = spark.createDataFrame([(5, 1), (5, 2), (4, 1), (6, 9)], "score int, id int")
    got = rows.where(after([("score", False, 5), ("id", True, 1)])).collect()
    assert sorted(map(tuple, got)) == [(4, 1), (5, 2)]


@pytest.mark.parametrize("total, offset, size, want", [(0, 0, 5, (0, False, None)), (5, 0, 5, (5, False, None)), (6, 0, 5, (5, True, 5)), (6, 9, 5, (0, False, None))])
def test_page_boundary(spark, total, offset, size, want):
    row = spark.range(1).select(F.lit(total).alias("n")).select(*(c.alias(k) for k, c in page_boundary(F.col("n"), offset, size).items())).first()
    assert tuple(row) == want


def test_budget_prefix(spark):
    rows = spark.createDataFrame([("a",), ("bb",), ("ccc",)], "v string")
    count = lambda budget: budget_prefix(rows, [F.asc("v")], F.octet_length("v"), budget, 100).count()
    assert [count(0), count(1), count(5), count(6)] == [0, 1, 2, 3]


def test_pick_and_keep_best_with_ties(spark):
    rows = spark.createDataFrame([("k", 1, 2), ("k", 2, 2), ("l", 3, 1)], "k string, id int, s int")
    assert [r["id"] for r in pick(rows, ["k"], [F.desc("s"), F.asc("id")]).orderBy("k").collect()] == [1, 3]
    assert keep_best(rows, ["k"], "s").count() == 3


def test_changed_keys_counts_null_as_a_value(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, ""), (2, "x"), (4, "z")], "k int, v string")
    assert {tuple(r) for r in changed_keys(a, b, ["k"]).collect()} == {(1, "changed"), (3, "removed"), (4, "added")}


def test_touching_finds_either_end(spark):
    edges = spark.createDataFrame([(1, 10, 20), (2, 20, 30), (3, 40, 50)], "id int, a int, b int")
    assert {r["id"] for r in touching(edges, ["a", "b"], spark.createDataFrame([(20,)], "k int"), "k").collect()} == {1, 2}


def test_under_compares_components_not_characters(spark):
    rows = spark.createDataFrame([("a/b/c",), ("a/bc",), ("a/b",)], "p string")
    assert {r["p"] for r in under(rows, "p", spark.createDataFrame([("a/b",)], "root string"), "root").collect()} == {"a/b/c", "a/b"}


def test_multiset_containment(spark):
    have = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    ok = lambda rows: holds_all(spark.createDataFrame(rows, "x int"), have).first()[0]
    assert ok([(1,), (1,)]) and ok([]) and not ok([(1,), (1,), (1,)]) and not ok([(3,)])


def test_consensus(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "k string, v int")
    assert dict(rows.groupBy("k").agg(consensus(F.col("v")))
                .collect()) == {"a": 1, "b": None}


def test_walks_end_at_cycles_and_depth(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)] + [(i, i + 1) for i in range(100, 170)], "src long, dst long")
    loop = graph.walk(spark, edges, spark.createDataFrame([(1,)], "node long"), 10).collect()
    assert [(r["node"], r["cycle"]) for r in sorted(loop, key=lambda r: r["depth"])] == [(1, False), (2, False), (3, False), (1, True)]
    assert graph.walk(spark, edges, spark.createDataFrame([(100,)], "node long"), 64).count() == 65
    assert graph.closure(edges, spark.createDataFrame([(1,)], "node long")).count() == 3


def test_violations_raise(spark):
    require_empty(spark.range(0), "none", "test")
    with pytest.raises(InvariantError, match="some rule"):
        require_empty(spark.range(20), "some rule", "test")


def test_url_parts_and_policy(spark):
    urls = ["https://a.example/x", "http://a.example/", "nonsense", "https://10.0.0.1/", "https://user:pw@a.example/", "https://localhost/", "https://8.8.8.8/"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    got = rows.select(policy.refusal(url_parts(F.col("u")), F.lit(0), 5, F.lit(False)).alias("r"), url_parts(F.col("u"))["has_credentials"].alias("c")).collect()
    assert [r["r"] for r in got] == [None, "scheme", "invalid_url", "private_address", None, "private_address", None]
    assert got[4]["c"] is True


def test_path_suffix(spark):
    rows = spark.createDataFrame([(["a", "b", "C"],), (["C"],), ([],)], "c array<string>")
    assert [r[0] for r in rows.select(path_suffix(F.col("c"), ["b", "C"])).collect()] == [True, False, False]


def test_cache_decisions(spark):
    rows = spark.createDataFrame([(404, 5), (404, 50), (200, 5)], "status int, age int")
    assert [r[0] for r in rows.select(policy.reuse(F.col("status"), F.col("age"), 10, F.lit(False))).collect()] == [True, False, False]
