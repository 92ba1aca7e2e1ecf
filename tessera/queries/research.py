"""Comparison, inspection, families, freshness and dependency queries over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.plans import comparison, policy
from tessera.queries.registry import query

_SIDES = """b AS (SELECT 'customer' AS axis, CAST(c_custkey AS VARCHAR) AS key, c_name AS label, [c_mktsegment, CAST(c_nationkey AS VARCHAR)] AS v FROM customer WHERE c_custkey % 17 <> 0
      UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_name, [CAST(p_size AS VARCHAR), p_type] FROM part WHERE p_partkey % 11 <> 0),
    a AS (SELECT 'customer' AS axis, CAST(c_custkey AS VARCHAR) AS key, c_name AS label, [CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END, CASE WHEN c_custkey % 7 = 0 THEN '99' ELSE CAST(c_nationkey AS VARCHAR) END] AS v FROM customer WHERE c_custkey % 19 <> 0
      UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 29 = 0 THEN 'a ' || p_name ELSE p_name END, [CAST(p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR), p_type] FROM part WHERE p_partkey % 13 <> 0)"""


@query(
    f"""WITH {_SIDES}, d AS (SELECT axis, key, least(coalesce(b.label, a.label), coalesce(a.label, b.label)) AS label, b.v AS old, a.v AS new, b.label IS DISTINCT FROM a.label AS named,
      CASE axis WHEN 'customer' THEN ['facts.segment', 'facts.where.nation'] ELSE ['size', 'type'] END AS names FROM b FULL JOIN a USING (axis, key))
    SELECT axis, key, label, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS change,
      CASE WHEN old IS NULL OR new IS NULL THEN '' ELSE concat_ws(',', CASE WHEN old[1] IS DISTINCT FROM new[1] THEN names[1] END, CASE WHEN old[2] IS DISTINCT FROM new[2] THEN names[2] END) END AS paths
    FROM d WHERE old IS NULL OR new IS NULL OR named OR old IS DISTINCT FROM new"""
)
def compare_axes(t):
    def customers(rows, segment, nation):
        return comparison.axis(rows.select("c_custkey", "c_name", F.struct(segment.alias("segment"), F.struct(nation.alias("nation")).alias("where")).alias("facts")), "customer", "c_custkey", "c_name")

    def parts(rows, name, size):
        return comparison.axis(rows.select("p_partkey", name.alias("p_name"), size.alias("size"), F.col("p_type").alias("type")), "part", "p_partkey", "p_name")

    k, p = F.col("c_custkey"), F.col("p_partkey")
    before = [customers(t.customer.where(k % 17 != 0), F.col("c_mktsegment"), F.col("c_nationkey")), parts(t.part.where(p % 11 != 0), F.col("p_name"), F.col("p_size"))]
    after = [
        customers(t.customer.where(k % 19 != 0), F.when(k % 5 != 0, F.col("c_mktsegment")), F.when(k % 7 == 0, 99).otherwise(F.col("c_nationkey"))),
        parts(t.part.where(p % 13 != 0), F.when(p % 29 == 0, F.concat(F.lit("a "), "p_name")).otherwise(F.col("p_name")), F.col("p_size") + F.when(p % 3 == 0, 1).otherwise(0)),
    ]
    return comparison.compare(before, after).withColumn("paths", F.array_join("paths", ","))


_OLD_SET = "CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN [] ELSE [p_brand, p_type] END"
_NEW_SET = "CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN [p_brand] ELSE [p_type, p_brand, p_type] END"


@query(
    f"""SELECT p_partkey, CASE WHEN o IS NULL AND n IS NULL THEN 'unknown' WHEN o IS NULL OR n IS NULL THEN 'one_unknown' WHEN list_sort(list_distinct(o)) = list_sort(list_distinct(n)) THEN 'same' ELSE 'differs' END AS state
    FROM (SELECT p_partkey, {_OLD_SET} AS o, {_NEW_SET} AS n FROM part)"""
)
def configuration_differences(t):
    k, none = F.col("p_partkey"), F.lit(None).cast("array<string>")
    old = F.when(k % 7 == 0, none).when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", "p_type"))
    new = F.when(k % 6 == 0, none).when(k % 4 == 0, F.array("p_brand")).otherwise(F.array("p_type", "p_brand", "p_type"))
    return t.part.select("p_partkey", comparison.setting_state(old, new).alias("state"))


@query("SELECT doc_id, left(text, 240) AS shown, length(text) <= 240 AS text_complete, CAST(length(text) AS BIGINT) AS characters FROM documents")
def inspect_fragments(t):
    """Fragments as a page shows them: their first 240 characters, and whether that is all."""
    return t.documents.select("doc_id", F.left("text", F.lit(240)).alias("shown"), (F.length("text") <= 240).alias("text_complete"), F.length("text").cast("long").alias("characters"))


@query("SELECT lang, doc_id, n_chars FROM documents WHERE source IS NOT NULL AND n_chars > 0 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 3")
def examples_per_language(t):
    w = Window.partitionBy("lang").orderBy("doc_id")
    return t.documents.where("source IS NOT NULL AND n_chars > 0").select("lang", "doc_id", "n_chars").withColumn("n", F.row_number().over(w)).where("n <= 3").drop("n")


_FAMILIES = "(VALUES ('api', 'signature', true), ('api', 'path', true), ('docs', 'section', false), ('examples', 'code', false), ('notes', 'section', false)) f(name, fragment, api)"


@query(
    f"""WITH r AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN ['api', 'docs'] WHEN 1 THEN ['docs', 'notes'] WHEN 2 THEN ['examples', 'source'] END AS kinds FROM nation),
    x AS (SELECT n_nationkey, unnest(coalesce(kinds, ['api', 'docs', 'examples', 'notes'])) AS name FROM r)
    SELECT n_nationkey, array_to_string(list(DISTINCT x.name ORDER BY x.name), ',') AS families, array_to_string(list(DISTINCT fragment ORDER BY fragment) FILTER (WHERE fragment IS NOT NULL), ',') AS fragments, coalesce(bool_or(api), false) AS include_api,
      count(*) FILTER (WHERE f.name IS NULL) AS unknown FROM x LEFT JOIN {_FAMILIES} ON x.name = f.name GROUP BY n_nationkey"""
)
def search_families(t):
    families = t.spark.createDataFrame([("api", "signature", True), ("api", "path", True), ("docs", "section", False), ("examples", "code", False), ("notes", "section", False)], "name string, fragment string, api boolean")
    k = F.col("n_nationkey") % 4
    given = lambda *names: F.array(*map(F.lit, names))
    kinds = F.when(k == 0, given("api", "docs")).when(k == 1, given("docs", "notes")).when(k == 2, given("examples", "source")).otherwise(given("api", "docs", "examples", "notes"))
    x = t.nation.select("n_nationkey", F.explode(kinds).alias("name")).join(F.broadcast(families), "name", "left")  # five rows
    texts = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return x.groupBy("n_nationkey").agg(texts("name").alias("families"), texts("fragment").alias("fragments"), F.coalesce(F.bool_or("api"), F.lit(False)).alias("include_api"), F.count(F.when(F.col("api").isNull(), 1)).alias("unknown"))


@query(
    """SELECT page_id, status IN (404, 410) AND age < 600 AND NOT forced AS reused,
      CASE WHEN status = 200 AND etag IS NOT NULL THEN 'if-none-match' WHEN status = 200 AND modified IS NOT NULL THEN 'if-modified-since' END AS header,
      CASE WHEN status = 200 AND etag IS NOT NULL THEN etag WHEN status = 200 THEN modified END AS value
    FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 404 WHEN 1 THEN 410 ELSE 200 END AS status, page_id * 7 % 1200 AS age, page_id % 9 = 0 AS forced, CASE WHEN page_id % 3 = 0 THEN md5(url) END AS etag, CASE WHEN page_id % 2 = 0 THEN url END AS modified FROM pages)"""
)
def http_freshness(t):
    k = F.col("page_id")
    status = F.when(k % 4 == 0, 404).when(k % 4 == 1, 410).otherwise(200)
    held = t.pages.select("page_id", status.alias("status"), (k * 7 % 1200).alias("age"), (k % 9 == 0).alias("forced"), F.when(k % 3 == 0, F.md5("url")).alias("etag"), F.when(k % 2 == 0, F.col("url")).alias("modified"))
    ask = policy.validator(F.col("status"), F.col("etag"), F.col("modified"))
    return held.select("page_id", policy.reuse(F.col("status"), F.col("age"), 600, F.col("forced")).alias("reused"), ask["name"].alias("header"), ask["value"].alias("value"))


_DEPENDS = "SELECT l_suppkey AS package, l_orderkey AS version, l_partkey AS needs, l_returnflag AS extra FROM lineitem"


@query(
    f"""WITH RECURSIVE last AS (SELECT package, max(version) AS version FROM ({_DEPENDS}) GROUP BY 1),
    e AS (SELECT DISTINCT d.package AS src, d.needs AS dst, d.extra FROM ({_DEPENDS}) d JOIN last USING (package, version)),
    w(node, depth) AS (SELECT CAST(s_suppkey AS BIGINT), 0 FROM supplier WHERE s_nationkey = 3 UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 64),
    m AS (SELECT node, min(depth) AS depth FROM w GROUP BY node)
    SELECT m.node AS package, CAST(depth AS INTEGER) AS depth, coalesce(array_to_string(list(DISTINCT extra ORDER BY extra), ','), '') AS extras FROM m LEFT JOIN (SELECT e.dst, e.extra FROM e JOIN m ON m.node = e.src) x ON x.dst = m.node GROUP BY ALL"""
)
def dependency_closure(t):
    """Packages that some roots need, directly or not, by each package's latest expansion, with the union of the extras asked of them."""
    d = t.lineitem.select(F.col("l_suppkey").alias("package"), F.col("l_orderkey").alias("version"), F.col("l_partkey").alias("needs"), F.col("l_returnflag").alias("extra"))
    last = d.groupBy("package").agg(F.max("version").alias("version"))
    edges = d.join(last, ["package", "version"]).select(F.col("package").alias("src"), F.col("needs").alias("dst"), "extra").distinct()
    reached = graph.closure(edges, t.supplier.where("s_nationkey = 3").select(F.col("s_suppkey").alias("node")))
    asked = edges.join(reached.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("extra")), ",").alias("extras"))
    return reached.join(asked, "node", "left").select(F.col("node").alias("package"), "depth", F.coalesce("extras", F.lit("")).alias("extras"))
