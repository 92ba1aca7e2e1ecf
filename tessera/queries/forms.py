"""Forms of projection, join, grouping and paging that evidence queries use beside the common ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.positions import clock, cursor, utf8_position_valid
from tessera.operators import graph
from tessera.queries.registry import query


@query("SELECT * EXCLUDE (s_acctbal) FROM supplier WHERE s_nationkey > 5 AND s_acctbal > 0")
def star_without(t):
    return t.spark.sql("SELECT * EXCEPT (s_acctbal) FROM {supplier} WHERE s_nationkey > :nation AND s_acctbal > :least", args={"nation": 5, "least": 0}, supplier=t.supplier)


@query("SELECT * REPLACE (lower(n_name) AS n_name) FROM nation")
def star_replaced(t):
    return t.nation.withColumn("n_name", F.lower("n_name"))


@query("SELECT d.doc_id, d.lang, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.source IS NOT NULL")
def nested_key_join(t):
    fragments = t.documents.where("source IS NOT NULL").select("lang", F.struct(F.struct(F.col("doc_id").alias("symbol_id")).alias("symbol")).alias("subject"))
    symbols = t.labels.select("toxic", F.struct(F.struct(F.col("doc_id").alias("symbol_id")).alias("symbol")).alias("target"))
    joined = fragments.join(symbols, F.col("subject.symbol.symbol_id") == F.col("target.symbol.symbol_id"))
    return joined.select(F.col("subject.symbol.symbol_id").alias("doc_id"), "lang", "toxic")


@query("WITH w AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Brand#' || (11 + s_suppkey % 5) END AS wanted FROM supplier) SELECT l_suppkey, p_brand, count(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey JOIN w ON l_suppkey = s_suppkey AND (wanted IS NULL OR wanted = p_brand) GROUP BY ALL")
def equality_if_given_join(t):
    wanted = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Brand#"), (11 + F.col("s_suppkey") % 5).cast("string"))).alias("wanted"))
    lines = t.lineitem.select("l_partkey", "l_suppkey").join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    counted = lines.groupBy("l_suppkey", "p_brand").agg(F.count("*").alias("lines"))  # before the join: a line meets one supplier
    return counted.join(wanted, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("wanted").isNull() | (F.col("wanted") == F.col("p_brand")))).select("l_suppkey", "p_brand", "lines")


@query("SELECT 'many' AS gate, count(*) AS lines FROM lineitem HAVING count(*) > 100 UNION ALL SELECT 'few', count(*) FROM lineitem HAVING count(*) <= 100")
def global_having(t):
    return t.spark.sql("SELECT 'many' AS gate, count(*) AS lines FROM {l} HAVING count(*) > 100 UNION ALL SELECT 'few', count(*) FROM {l} HAVING count(*) <= 100", l=t.lineitem)


_LISTS = "CASE o_orderkey % 3 WHEN 1 THEN [] WHEN 2 THEN [o_orderstatus, o_orderpriority] END"


@query(f"SELECT o_orderkey, unnest(CASE WHEN len({_LISTS}) > 0 THEN {_LISTS} ELSE [NULL] END) AS tag FROM orders")
def unnest_outer(t):
    k = F.col("o_orderkey") % 3
    tags = F.when(k == 1, F.array().cast("array<string>")).when(k == 2, F.array("o_orderstatus", "o_orderpriority"))
    return t.orders.select("o_orderkey", F.explode_outer(tags).alias("tag"))


@query("SELECT p_partkey, p_brand, p_type FROM part ORDER BY [p_brand, p_type] DESC, p_size, p_partkey LIMIT 100")
def sort_by_values(t):
    return t.part.orderBy(F.array("p_brand", "p_type").desc(), F.struct("p_size", "p_partkey")).limit(100).select("p_partkey", "p_brand", "p_type")


@query("SELECT user_id, event_type, event_id, value FROM events WHERE event_type IN ('purchase', 'error') QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_receipts(t):
    kinds = t.events.where(F.col("event_type").isin("purchase", "error"))
    return kinds.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("r")).select("user_id", "event_type", "r.*")


@query("SELECT split_part(split_part(url, '#', 1), '?', 1) AS uri, min(page_id) AS page_id, arg_min(CASE WHEN contains(url, '#') THEN split_part(url, '#', 2) END, (NOT contains(url, '#'), page_id)) FILTER (WHERE contains(url, '#')) AS anchor FROM pages GROUP BY 1")
def page_anchors(t):
    anchored = F.contains("url", F.lit("#"))
    p = t.pages.select("page_id", F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)).alias("uri"), F.when(anchored, F.split_part("url", F.lit("#"), F.lit(2))).alias("anchor"))
    return p.groupBy("uri").agg(F.min("page_id").alias("page_id"), F.min_by("anchor", F.when(F.col("anchor").isNotNull(), F.col("page_id"))).alias("anchor"))


@query("SELECT r_name, kind FROM region JOIN (VALUES (0, 'south'), (1, 'west'), (2, 'east')) v(k, kind) ON r_regionkey = k")
def inline_values(t):
    return t.spark.sql("SELECT r_name, kind FROM {region} JOIN VALUES (0, 'south'), (1, 'west'), (2, 'east') AS v(k, kind) ON r_regionkey = k", region=t.region)


@query("WITH d AS (SELECT doc_id, CAST(doc_id % 37 AS INTEGER) AS byte, string_split(text, chr(10))[doc_id % 3 + 1] AS line FROM documents) SELECT doc_id, coalesce(byte <= strlen(line) AND list_contains(list_transform(range(0, least(length(line), 40) + 1), lambda k: strlen(left(line, k))), byte), false) AS valid FROM d")
def utf8_positions(t):
    line, byte = (F.col("doc_id") % 3).cast("int"), (F.col("doc_id") % 37).cast("int")
    return t.documents.select("doc_id", utf8_position_valid(F.col("text"), line, byte).alias("valid"))


@query("SELECT event_id, ts AS event_time, ts + INTERVAL 90 MINUTE AS expiry_time, ts + INTERVAL 90 MINUTE < TIMESTAMP '1996-01-01' AS expired FROM events")
def event_clocks(t):
    until = F.col("ts") + F.expr("INTERVAL 90 MINUTE")
    return t.events.select("event_id", clock(F.col("ts"), "event", "event_time"), clock(until, "expiry", "expiry_time"), (until < F.lit("1996-01-01").cast("timestamp_ntz")).alias("expired"))


_BODY = """'{"scope":"customers","query":"q1","key":"' || c_custkey || '"}'"""


@query(f"SELECT c_custkey, base64(encode({_BODY})) || '.' || sha256({_BODY}) AS token FROM customer")
def page_cursors(t):
    return t.customer.select("c_custkey", cursor("customers", F.lit("q1"), F.col("c_custkey").cast("string")).alias("token"))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(f"SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS place FROM information_schema.columns WHERE table_name IN {_TABLES}")
def inventory(t):
    rows = [(name, f.name, i) for name in _TABLES for i, f in enumerate(getattr(t, name).schema, 1)]  # a row a column
    return t.spark.createDataFrame(rows, "table_name string, column_name string, place int")


@query("WITH RECURSIVE n AS (SELECT max(p_partkey) + 1 AS m FROM part), e AS (SELECT p_partkey AS src, p_partkey // 3 AS dst FROM part), w(node, depth) AS (SELECT CAST(2 AS BIGINT), 0 UNION SELECT e.src, w.depth + 1 FROM w JOIN e ON e.dst = w.node) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY node")
def dependents(t):
    """All that depends on part 2, directly or not: the closure over reversed edges."""
    edges = t.part.select(F.floor(F.col("p_partkey") / 3).cast("bigint").alias("src"), F.col("p_partkey").alias("dst"))
    return graph.closure(edges, t.spark.range(2, 3).select(F.col("id").alias("node")))
