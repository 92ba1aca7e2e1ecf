"""Joins, aggregates, windows, set operations and recursion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.identity import relation_digest, row_fingerprint
from tessera.operators import graph
from tessera.operators.relational import changed_keys, consensus, distinct_rows, holds_all, keep_best, ordered_list, ordered_set, pick, touching, violations
from tessera.queries.registry import query


def money(column):
    """A sum of cents that no order of addition changes."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


@query("SELECT n_name, r_name, count(*) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def inner_join_rollup(t):
    by_nation = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), money("c_acctbal").alias("balance"))  # aggregated before the join
    return by_nation.join(t.nation, "n_nationkey").join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "customers", "balance")


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#13') OR l_suppkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#13')")
def relationship_endpoints_semi(t):
    chosen = t.part.where("p_brand = 'Brand#13'")
    return touching(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], chosen, "p_partkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def observation_semi(t):
    return t.customer.join(t.orders.where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def unmatched_anti(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("WITH x AS (SELECT * FROM customer WHERE c_mktsegment = 'NO SUCH') SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT c_custkey FROM x) OR NOT EXISTS (SELECT 1 FROM x)")
def exists_gate(t):
    c = t.customer.withColumn("exact", F.col("c_mktsegment") == "NO SUCH")
    gate = c.agg(F.coalesce(F.bool_or("exact"), F.lit(False)).alias("any_exact"))  # one row
    return c.crossJoin(F.broadcast(gate)).where("exact OR NOT any_exact").select("c_custkey")


@query("SELECT c.c_custkey, n.o_orderkey AS newest_order FROM customer c LEFT JOIN (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) n ON true")
def newest_scalar_attach(t):
    newest = t.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select(F.col("o_orderkey").alias("newest_order"))
    return t.customer.select("c_custkey").join(F.broadcast(newest), F.lit(True), "left")  # the right side is one row


@query("WITH s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) SELECT coalesce(s.k, c.k) AS nationkey, suppliers, customers, CASE WHEN s.k IS NULL THEN 'missing_left' WHEN c.k IS NULL THEN 'missing_right' WHEN suppliers <> customers THEN 'differs' ELSE 'same' END AS state FROM s FULL JOIN c ON s.k = c.k")
def full_outer_vector(t):
    s = t.supplier.groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    c = t.customer.groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    state = F.when(F.col("suppliers").isNull(), "missing_left").when(F.col("customers").isNull(), "missing_right").when(F.col("suppliers") != F.col("customers"), "differs").otherwise("same")
    return s.join(c, "nationkey", "full").withColumn("state", state)


def provenance(lines, part, supplier):
    on = (F.col("l_suppkey") == F.col("s_suppkey")) & ((F.col("p_size") > 25) | (F.col("s_nationkey") == 3))
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, on, "left").select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("SELECT l.l_orderkey, l.l_linenumber, p.p_name, s.s_name FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey AND (p.p_size > 25 OR s.s_nationkey = 3)")
def evidence_provenance(t):
    return provenance(t.lineitem, t.part, t.supplier)


@query("SELECT a.p_name, a.p_partkey AS first_key, b.p_partkey AS second_key FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey")
def self_join_pairs(t):
    a = t.part.select("p_name", "p_brand", F.col("p_partkey").alias("first_key"))
    b = t.part.select("p_name", "p_brand", F.col("p_partkey").alias("second_key"))
    return a.join(b, ["p_name", "p_brand"]).where("first_key < second_key").select("p_name", "first_key", "second_key")


@query("WITH a AS (SELECT doc_id, nullif(quality, 0) AS q FROM labels), b AS (SELECT DISTINCT nullif(toxic, 1) AS q FROM labels) SELECT a.doc_id, a.q FROM a JOIN b ON a.q IS NOT DISTINCT FROM b.q")
def null_safe_join(t):
    a = t.labels.select("doc_id", F.nullif("quality", F.lit(0)).alias("q"))
    b = t.labels.select(F.nullif("toxic", F.lit(1)).alias("q2")).distinct()
    return a.join(b, F.col("q").eqNullSafe(F.col("q2"))).select("doc_id", "q")


@query("SELECT p_brand, count(*) AS parts, count(DISTINCT p_name) AS names, count(DISTINCT (p_type, p_size)) AS kinds, min(p_size) AS least, max(p_size) AS most, count(*) FILTER (WHERE p_size > 25) AS large, CAST(sum(p_size) FILTER (WHERE p_type = 'ECONOMY') AS BIGINT) AS economy_size FROM part GROUP BY p_brand HAVING count(*) > 1")
def filtered_aggregates(t):
    return t.part.groupBy("p_brand").agg(F.count("*").alias("parts"), F.count_distinct("p_name").alias("names"), F.count_distinct(F.struct("p_type", "p_size")).alias("kinds"), F.min("p_size").alias("least"), F.max("p_size").alias("most"), F.expr("count(*) FILTER (WHERE p_size > 25)").alias("large"), F.expr("sum(p_size) FILTER (WHERE p_type = 'ECONOMY')").alias("economy_size")).where("parts > 1")


@query("SELECT p_name, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS brand, count(DISTINCT p_brand) AS brands FROM part GROUP BY p_name")
def consensus_attribute(t):
    return t.part.groupBy("p_name").agg(consensus(F.col("p_brand")).alias("brand"), F.count_distinct("p_brand").alias("brands"))


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_name DESC) AS nations, array_to_string(list(n_nationkey ORDER BY n_name), ',') AS keys FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def ordered_string_agg(t):
    j = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.expr("listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC)").alias("nations"), F.array_join(ordered_list(F.col("n_nationkey").cast("string"), F.col("n_name")), ",").alias("keys"))


@query("SELECT p_type, array_to_string(list(DISTINCT p_brand ORDER BY p_brand), ',') AS brands, bool_and(p_size > 0) AS all_sized, bool_or(p_size > 48) AS any_large, arg_min(p_name, p_partkey) AS first_name FROM part GROUP BY p_type")
def set_and_boolean_aggregates(t):
    return t.part.groupBy("p_type").agg(F.array_join(ordered_set(F.col("p_brand")), ",").alias("brands"), F.bool_and(F.col("p_size") > 0).alias("all_sized"), F.bool_or(F.col("p_size") > 48).alias("any_large"), F.min_by("p_name", "p_partkey").alias("first_name"))


@query("SELECT p_brand, array_to_string(list(p_name ORDER BY p_retailprice DESC, p_partkey) FILTER (WHERE pos <= 3), ';') AS samples, count(*) AS members FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS pos FROM part) GROUP BY p_brand")
def bounded_samples(t):
    top = pick(t.part, ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3).groupBy("p_brand").agg(F.array_join(ordered_list(F.col("p_name"), -F.col("p_retailprice"), F.col("p_partkey")), ";").alias("samples"))
    return t.part.groupBy("p_brand").agg(F.count("*").alias("members")).join(top, "p_brand").select("p_brand", "samples", "members")


@query("SELECT count(DISTINCT (r_regionkey, r_name)) AS rows FROM region")
def relation_digest_rows(t):
    twice = t.region.unionByName(t.region).repartition(3)
    a, b = relation_digest(t.region), relation_digest(twice)
    return a.join(b.select("digest"), "digest").select("rows")


@query("WITH q AS (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1), d AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), w AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) SELECT 'orders_in_lineitem' AS rule, bool_and(coalesce(d.n, 0) >= q.n) AS contained FROM q LEFT JOIN d USING (k) UNION ALL SELECT 'flags_in_lineitem', bool_and(coalesce(v.n, 0) >= w.n) FROM w LEFT JOIN w v USING (l_returnflag, l_linestatus)")
def multiset_reconcile(t):
    flags = t.lineitem.select("l_returnflag", "l_linestatus")
    keys = holds_all(t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k")))
    return keys.select(F.lit("orders_in_lineitem").alias("rule"), "contained").unionByName(holds_all(flags, flags).select(F.lit("flags_in_lineitem").alias("rule"), "contained"))


@query("SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders)")
def dedup_fingerprint(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    return distinct_rows(o.unionByName(o))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_state(t):
    latest = t.events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("x"))  # combines before the shuffle
    return latest.select("user_id", "x.*")


@query("SELECT f.event_id, f.user_id, p.event_id AS before_id, p.event_type AS before_type FROM events f LEFT JOIN events p ON p.user_id = f.user_id AND p.event_type <> 'error' AND p.event_id < f.event_id WHERE f.event_type = 'error' QUALIFY row_number() OVER (PARTITION BY f.event_id ORDER BY p.event_id DESC NULLS LAST) = 1")
def failure_with_preceding_event(t):
    # one pass over each user's log instead of a non-equi self join
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    ok = F.when(F.col("event_type") != "error", F.struct("event_id", "event_type"))
    e = t.events.select("event_id", "user_id", "event_type", F.last(ok, ignorenulls=True).over(w).alias("p"))
    return e.where("event_type = 'error'").select("event_id", "user_id", F.col("p.event_id").alias("before_id"), F.col("p.event_type").alias("before_type"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY l_quantity = max(l_quantity) OVER (PARTITION BY l_orderkey)")
def keep_best_match(t):
    return keep_best(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], "l_quantity")


@query("SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running FROM lineitem")
def running_total(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.sum(F.col("l_quantity").cast("decimal(18,2)")).over(w).cast("double").alias("running"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def top_n_per_group(t):
    return pick(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier")
def except_distinct(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).subtract(t.supplier.select("s_nationkey"))


@query("WITH a AS (SELECT n_nationkey AS k FROM nation), b AS (SELECT DISTINCT c_nationkey AS k FROM customer) SELECT NOT EXISTS (SELECT k FROM a EXCEPT SELECT k FROM b) AND NOT EXISTS (SELECT k FROM b EXCEPT SELECT k FROM a) AS equal")
def set_equality(t):
    a = t.nation.select(F.col("n_nationkey").alias("k"), F.lit(1).alias("in_a"))
    b = t.customer.select(F.col("c_nationkey").alias("k")).distinct().withColumn("in_b", F.lit(1))
    return a.join(b, "k", "full").agg(F.coalesce(F.bool_and(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()), F.lit(True)).alias("equal"))


_BEFORE = "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0"
_AFTER = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0"


def snapshots(t):
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return o.where("o_orderkey % 7 <> 0"), o.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))


@query(f"WITH a AS ({_BEFORE}), b AS ({_AFTER}), d AS ((FROM a EXCEPT FROM b) UNION (FROM b EXCEPT FROM a)) SELECT o_orderkey, CASE WHEN o_orderkey NOT IN (SELECT o_orderkey FROM a) THEN 'added' WHEN o_orderkey NOT IN (SELECT o_orderkey FROM b) THEN 'removed' ELSE 'changed' END AS change FROM (SELECT DISTINCT o_orderkey FROM d)")
def snapshot_compare_keys(t):
    return changed_keys(*snapshots(t), ["o_orderkey"])


@query(f"WITH a AS ({_BEFORE}), b AS ({_AFTER}), d AS ((FROM a EXCEPT FROM b) UNION (FROM b EXCEPT FROM a)) SELECT CASE WHEN o_orderkey NOT IN (SELECT o_orderkey FROM a) THEN 'added' WHEN o_orderkey NOT IN (SELECT o_orderkey FROM b) THEN 'removed' ELSE 'changed' END AS change, count(*) AS keys FROM (SELECT DISTINCT o_orderkey FROM d) GROUP BY 1")
def change_summary(t):
    return changed_keys(*snapshots(t), ["o_orderkey"]).groupBy("change").agg(F.count("*").alias("keys"))


@query(f"WITH a AS (UNPIVOT ({_BEFORE}) ON o_orderstatus, o_orderpriority INTO NAME path VALUE v), b AS (UNPIVOT ({_AFTER}) ON o_orderstatus, o_orderpriority INTO NAME path VALUE v) SELECT a.o_orderkey, a.path, a.v AS old_value, b.v AS new_value FROM a JOIN b ON a.o_orderkey = b.o_orderkey AND a.path = b.path AND a.v IS DISTINCT FROM b.v")
def changed_field_paths(t):
    a, b = (s.unpivot("o_orderkey", ["o_orderstatus", "o_orderpriority"], "path", v) for s, v in zip(snapshots(t), ("old_value", "new_value"), strict=True))
    return a.join(b, ["o_orderkey", "path"]).where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def ancestors(t, roots):
    edges = t.part.select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("bigint").alias("dst")).where("src > 1")
    return graph.walk(t.spark, edges, roots.select(F.col("p_partkey").alias("node")), 60).select("root", "node", "depth")


@query("WITH RECURSIVE w(root, node, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT root, node // 2, depth + 1 FROM w WHERE node > 1) SELECT root, node, depth FROM w")
def ancestry_closure(t):
    return ancestors(t, t.part)


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation), w(root, node, depth, trail, cycle) AS (SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT), 0, [CAST(n_nationkey AS BIGINT)], false FROM nation UNION ALL SELECT w.root, CAST(e.dst AS BIGINT), w.depth + 1, list_append(w.trail, CAST(e.dst AS BIGINT)), list_contains(w.trail, e.dst) FROM w JOIN e ON e.src = w.node WHERE NOT w.cycle AND w.depth < 40) SELECT root, max(depth) AS steps, bool_or(cycle) AS cycle FROM w GROUP BY root")
def cycle_guard_walk(t):
    edges = t.nation.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst"))
    w = graph.walk(t.spark, edges, t.nation.select(F.col("n_nationkey").alias("node")), 40)
    return w.groupBy("root").agg(F.max("depth").alias("steps"), F.bool_or("cycle").alias("cycle"))


def aliases(t, sources, roots):
    edges = sources.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") * 3 % F.col("m")).alias("dst"))
    w = graph.walk(t.spark, edges, roots.select(F.col("p_partkey").alias("node")), 60)
    ends = w.groupBy("root").agg(F.max_by("node", "depth").alias("target"), F.max("depth").alias("depth"), F.bool_or("cycle").alias("cycle"))
    known = t.part.select(F.col("p_partkey").alias("target"), F.lit(True).alias("known"))
    outcome = F.when(F.col("cycle"), "cycle").when(F.col("known").isNull(), "missing_target").when(F.col("depth") >= 60, "depth_limit").otherwise("resolved")
    return ends.join(known, "target", "left").select("root", "target", "depth", outcome.alias("outcome"))


@query("WITH RECURSIVE n AS (SELECT max(p_partkey) - 2 AS m FROM part), e AS (SELECT p_partkey AS src, (p_partkey * 3) % m AS dst FROM part, n WHERE p_partkey % 4 <> 0), w(root, node, depth, trail, cycle) AS (SELECT p_partkey, p_partkey, 0, [p_partkey], false FROM part UNION ALL SELECT w.root, e.dst, w.depth + 1, list_append(w.trail, e.dst), list_contains(w.trail, e.dst) FROM w JOIN e ON e.src = w.node WHERE NOT w.cycle AND w.depth < 60), l AS (SELECT root, arg_max(node, depth) AS node, max(depth) AS depth, bool_or(cycle) AS cycle FROM w GROUP BY root) SELECT root, node AS target, CAST(depth AS INTEGER) AS depth, CASE WHEN cycle THEN 'cycle' WHEN node NOT IN (SELECT p_partkey FROM part) THEN 'missing_target' WHEN depth >= 60 THEN 'depth_limit' ELSE 'resolved' END AS outcome FROM l")
def alias_chain(t):
    most = t.part.agg((F.max("p_partkey") - 2).alias("m"))  # one row; targets reach over the table
    return aliases(t, t.part.crossJoin(F.broadcast(most)), t.part)


def frontier(t, sources, rounds=30):
    p = sources.select(F.col("p_partkey").alias("src"), "m")
    edges = p.select("src", F.explode(F.array(F.col("src") * 2 % F.col("m"), (F.col("src") * 5 + 1) % F.col("m"))).alias("dst"))
    return graph.closure(edges, t.spark.range(1, 2).select(F.col("id").alias("node")), rounds=rounds)


@query("WITH RECURSIVE n AS (SELECT max(p_partkey) + 1 AS m FROM part), e AS (SELECT p_partkey AS src, (p_partkey * 2) % m AS dst FROM part, n UNION ALL SELECT p_partkey, (p_partkey * 5 + 1) % m FROM part, n), w(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 64) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY node")
def frontier_closure(t):
    most = t.part.agg((F.max("p_partkey") + 1).alias("m"))  # one row
    return frontier(t, t.part.crossJoin(F.broadcast(most)), rounds=64)  # raises if there is more to reach


@query(
    """SELECT 'orders_customer_key' AS rule, count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'part_key_unique', count(*) FROM (SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'status_vocabulary', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
    UNION ALL SELECT 'quantity_range', count(*) FROM lineitem WHERE l_quantity < 1 OR l_quantity > 40
    UNION ALL SELECT 'names_not_empty', count(*) FROM part WHERE p_name = ''"""
)
def invariant_suite(t):
    return violations(
        {
            "orders_customer_key": t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
            "part_key_unique": t.part.groupBy("p_partkey").count().where("count > 1"),
            "status_vocabulary": t.orders.where(~F.col("o_orderstatus").isin("O", "F")),
            "quantity_range": t.lineitem.where("l_quantity < 1 OR l_quantity > 40"),
            "names_not_empty": t.part.where("p_name = ''"),
        }
    )


@query("SELECT count(*) AS rows, count(DISTINCT (p_partkey, p_name)) AS prints FROM part")
def fingerprints(t):
    p = t.part.select("p_partkey", "p_name")
    return p.select(row_fingerprint(p).alias("h")).agg(F.count("*").alias("rows"), F.count_distinct("h").alias("prints"))
