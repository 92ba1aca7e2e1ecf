"""Search, overview, inspection and paging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import path_prefix, path_suffix
from tessera.operators.relational import budget_prefix, once, ordered_list, page, page_boundary, pick, under
from tessera.plans import search
from tessera.queries.registry import query

_QUERY = "worthless src3 onti"
_TERMS = ["worthless", "src3", "onti"]
_HITS = "list_filter([" + ", ".join(f"contains(lower(text), '{t}')" for t in _TERMS) + "], lambda x: x)"
_FRAGMENTS = f"""
  SELECT doc_id, source, lang,
    (CASE WHEN lower(source) = '{_QUERY}' THEN 600 ELSE 0 END)
    + (CASE WHEN {" OR ".join(f"contains(lower(source), '{t}')" for t in _TERMS)} THEN 150 ELSE 0 END)
    + least(len({_HITS}), 3) * 50 AS score
  FROM documents"""


def fragments(t):
    return search.score_fragments(t.documents, _QUERY, "source", "text", ["doc_id", "source", "lang"])


@query(f"SELECT doc_id, source, lang, CAST(score AS INTEGER) AS score FROM ({_FRAGMENTS}) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50")
def search_documents(t):
    return search.next_page(fragments(t), None, [("score", False), ("doc_id", True)], 50)


@query(f"SELECT doc_id, source, lang, CAST(score AS INTEGER) AS score FROM ({_FRAGMENTS}) WHERE score > 0 AND (score < 150 OR (score = 150 AND doc_id > 40)) ORDER BY score DESC, doc_id LIMIT 20")
def search_page_after(t):
    return search.next_page(fragments(t), [("score", False, 150), ("doc_id", True, 40)], [("score", False), ("doc_id", True)], 20)


def symbols(t):
    """Parts as symbols: type, brand and name words are path components; parts of one name are aliases of a definition."""
    words = F.split("p_name", " ")
    comps = F.concat(F.array("p_type", "p_brand"), words)
    return t.part.select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("definition"), comps.alias("components"), F.array_join(comps, "::").alias("path"), F.element_at(words, -1).alias("name"), (F.col("p_partkey") % 3 == 0).alias("is_reexport"), "p_size")


_SYMBOLS = """
  SELECT p_partkey AS symbol_id, p_name AS definition, list_concat([p_type, p_brand], string_split(p_name, ' ')) AS components,
    p_type || '::' || p_brand || '::' || array_to_string(string_split(p_name, ' '), '::') AS path,
    string_split(p_name, ' ')[-1] AS name, p_partkey % 3 = 0 AS is_reexport, p_size FROM part"""


@query(
    f"""WITH s AS ({_SYMBOLS}), r AS (
      SELECT *, lower(path) LIKE '%::widget' AS suffix, lower(name) = 'widget' AS named, contains(lower(path), 'widget') AS tok, starts_with(lower(name), 'widget') AS pre FROM s),
    x AS (SELECT *, (CASE WHEN suffix THEN 800 ELSE 0 END) + (CASE WHEN named AND NOT suffix THEN 700 ELSE 0 END)
        + (CASE WHEN pre AND NOT (named AND NOT suffix) THEN 400 ELSE 0 END) + (CASE WHEN tok THEN 200 ELSE 0 END) AS base FROM r),
    y AS (SELECT *, base + CASE WHEN NOT is_reexport THEN 5 ELSE 0 END AS score FROM x WHERE base > 0),
    p AS (SELECT definition, list(DISTINCT path ORDER BY path) AS paths FROM y GROUP BY definition)
    SELECT definition, symbol_id, path, CAST(score AS INTEGER) AS score, array_to_string(list_filter(paths, lambda q: q <> path), ',') AS also_at
    FROM y JOIN p USING (definition)
    QUALIFY row_number() OVER (PARTITION BY definition ORDER BY score DESC, is_reexport, path, symbol_id) = 1"""
)
def search_symbols(t):
    none = F.lit(None).cast("string")
    r = search.rank_symbol("widget", F.col("path"), F.col("name"), none, none, none, F.col("is_reexport"))
    hits = once(symbols(t), r=r).where("r IS NOT NULL").withColumn("score", F.col("r.score"))
    best = search.fold(hits.drop("r"), "definition", [F.desc("score"), F.asc("is_reexport"), F.asc("path"), F.asc("symbol_id")], "path")
    return best.select("definition", "symbol_id", "path", "score", F.array_join("also_at", ",").alias("also_at"))


@query("SELECT CAST(greatest(least(n - 30, 50), 0) AS BIGINT) AS returned, n > 30 + greatest(least(n - 30, 50), 0) AS has_more, CASE WHEN n > 30 + greatest(least(n - 30, 50), 0) THEN CAST(30 + least(n - 30, 50) AS BIGINT) END AS next_offset, n AS total FROM (SELECT count(*) AS n FROM part)")
def page_boundary_state(t):
    b = page_boundary(F.col("total"), 30, 50)
    return t.part.agg(F.count("*").alias("total")).select(*(c.alias(k) for k, c in b.items()), "total")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 26")
def sentinel_page(t):
    return page(t.part.select("p_partkey", "p_name"), [F.col("p_name").asc_nulls_last(), F.col("p_partkey").asc()], 25)


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name DESC NULLS LAST, p_partkey LIMIT 10 OFFSET 15")
def offset_page(t):
    return t.part.select("p_partkey", "p_name").orderBy(F.col("p_name").desc_nulls_last(), "p_partkey").offset(15).limit(10)


@query(
    f"""WITH s AS ({_SYMBOLS}), k AS (SELECT components[1:2] AS space, p_size % 5 AS kind, count(*) AS n, count(DISTINCT definition) AS definitions FROM s GROUP BY ALL),
    m AS (SELECT components[1:2] AS space, definition, min(symbol_id) AS id FROM s GROUP BY ALL),
    top AS (SELECT space, list(definition ORDER BY definition, id) AS names FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY space ORDER BY definition, id) <= 3) GROUP BY space)
    SELECT array_to_string(space, '::') AS namespace, string_agg(kind || '=' || n, ',' ORDER BY kind) AS counts_by_kind, CAST(sum(n) AS BIGINT) AS members, any_value(array_to_string(names, ',')) AS samples
    FROM k JOIN top USING (space) GROUP BY space"""
)
def namespace_overview(t):
    s = symbols(t).withColumn("space", F.slice("components", 1, 2)).withColumn("kind", F.col("p_size") % 5)
    k = s.groupBy("space", "kind").agg(F.count("*").alias("n"))
    counts = k.groupBy("space").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("by"), F.sum("n").alias("members"))
    one = s.groupBy("space", "definition").agg(F.min("symbol_id").alias("id"))
    top = pick(one, ["space"], [F.asc("definition"), F.asc("id")], 3).groupBy("space").agg(ordered_list(F.col("definition"), F.col("definition"), F.col("id")).alias("names"))
    text = F.array_join(F.transform(F.map_entries("by"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return counts.join(top, "space").select(F.array_join("space", "::").alias("namespace"), text.alias("counts_by_kind"), "members", F.array_join("names", ",").alias("samples"))


@query(f"WITH s AS ({_SYMBOLS}) SELECT symbol_id, array_to_string(components[1:n], '::') AS ancestor, n AS depth FROM (SELECT *, unnest(range(1, len(components) + 1)) AS n FROM s)")
def lexical_ancestry(t):
    s = symbols(t).select("symbol_id", "components", F.explode(F.sequence(F.lit(1).cast("bigint"), F.size("components").cast("bigint"))).alias("depth"))
    return s.select("symbol_id", F.array_join(F.expr("slice(components, 1, int(depth))"), "::").alias("ancestor"), "depth")


@query(f"WITH s AS ({_SYMBOLS}), n AS (SELECT DISTINCT components[1:n] AS path, n AS depth FROM (SELECT components, unnest(range(1, len(components) + 1)) AS n FROM s)) SELECT array_to_string(p.path, '::') AS parent, count(*) AS children FROM n AS p JOIN n AS c ON c.depth = p.depth + 1 AND c.path[1:len(p.path)] = p.path GROUP BY p.path")
def namespace_children(t):
    s = symbols(t).select("components", F.explode(F.sequence(F.lit(1), F.size("components"))).alias("n"))
    paths = s.select(F.expr("slice(components, 1, n)").alias("path")).distinct()
    # a child names its parent, so this is a count by key and not a join
    return paths.where(F.size("path") > 1).select(F.expr("slice(path, 1, size(path) - 1)").alias("parent")).groupBy("parent").agg(F.count("*").alias("children")).select(F.array_join("parent", "::").alias("parent"), "children")


@query(f"WITH s AS ({_SYMBOLS}), n AS (SELECT DISTINCT components[1:i] AS path FROM (SELECT components, unnest(range(1, len(components) + 1)) AS i FROM s)) SELECT array_to_string(path, '::') AS path, len(path) AS depth, path IN (SELECT components FROM s) AS is_symbol FROM n")
def path_nodes(t):
    s = symbols(t)
    nodes = s.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("components")), lambda n: F.slice(F.col("components"), F.lit(1), n))).alias("path")).distinct()
    own = s.select(F.col("components").alias("path")).distinct().withColumn("is_symbol", F.lit(True))
    return nodes.join(own, "path", "left").select(F.array_join("path", "::").alias("path"), F.size("path").cast("bigint").alias("depth"), F.coalesce("is_symbol", F.lit(False)).alias("is_symbol"))


@query(f"WITH s AS ({_SYMBOLS}) SELECT symbol_id, path FROM s WHERE len(components) >= 2 AND components[-2:] = string_split((SELECT min(p_name) FROM part), ' ')")
def path_suffix_lookup(t):
    wanted = t.part.agg(F.min("p_name").alias("n")).first()["n"].split(" ")
    return symbols(t).where(path_suffix(F.col("components"), wanted)).select("symbol_id", "path")


@query(f"WITH s AS ({_SYMBOLS}) SELECT symbol_id, path FROM s WHERE components[1:1] = ['ECONOMY']")
def namespace_members(t):
    return symbols(t).where(path_prefix(F.col("components"), ["ECONOMY"])).select("symbol_id", "path")


@query(
    f"""WITH s AS ({_SYMBOLS}), m AS (SELECT *, path = 'cold widget' AS exact FROM s WHERE path = 'cold widget' OR name = 'widget'),
    e AS (SELECT * FROM m WHERE exact OR NOT EXISTS (SELECT 1 FROM m AS x WHERE x.exact))
    SELECT definition, count(*) AS paths, min(symbol_id) AS first_symbol FROM e GROUP BY definition"""
)
def binding_candidates(t):
    m = symbols(t).withColumn("exact", F.col("path") == "cold widget").where("exact OR name = 'widget'")
    any_exact = m.agg(F.coalesce(F.bool_or("exact"), F.lit(False)).alias("any_exact"))  # one row
    e = m.crossJoin(F.broadcast(any_exact)).where("exact OR NOT any_exact")
    return e.groupBy("definition").agg(F.count("*").alias("paths"), F.min("symbol_id").alias("first_symbol"))


@query(
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'labelled' WHEN b.item_id IS NOT NULL THEN 'benchmark' ELSE 'plain' END AS kind, l.quality, l.toxic,
      coalesce(CAST(l.quality AS VARCHAR), b.text[1:12], d.source) AS label, left(d.text, 40) AS excerpt, length(d.text) <= 40 AS text_complete
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN benchmark b ON d.doc_id = b.item_id"""
)
def fragment_surface(t):
    d, lab, b = t.documents.alias("d"), t.labels.alias("l"), t.benchmark.alias("b")
    j = d.join(lab, F.col("d.doc_id") == F.col("l.doc_id"), "left").join(b, F.col("d.doc_id") == F.col("b.item_id"), "left")
    kind = F.when(F.col("l.doc_id").isNotNull(), "labelled").when(F.col("b.item_id").isNotNull(), "benchmark").otherwise("plain")
    return j.select("d.doc_id", kind.alias("kind"), "l.quality", "l.toxic", F.coalesce(F.col("l.quality").cast("string"), F.substring("b.text", 1, 12), F.col("d.source")).alias("label"), F.left(F.col("d.text"), F.lit(40)).alias("excerpt"), (F.length("d.text") <= 40).alias("text_complete"))


@query("SELECT 'document' AS kind, doc_id AS id, source AS path FROM documents UNION ALL SELECT 'page', page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) FROM pages UNION ALL SELECT 'benchmark', item_id, NULL FROM benchmark")
def fragment_paths(t):
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1)
    parts = [t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("source").alias("path")), t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), host.alias("path")), t.benchmark.select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("id"), F.lit(None).cast("string").alias("path"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    """WITH n AS (SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://([^?#]+)', 1), '/') AS c FROM pages),
    roots AS (SELECT DISTINCT array_to_string(c[1:2], '/') AS root FROM n), p AS (SELECT page_id, array_to_string(c, '/') AS path FROM n)
    SELECT root, count(*) AS pages, min(page_id) AS first_page FROM p JOIN roots ON path = root OR starts_with(path, root || '/') GROUP BY root"""
)
def prefix_containment_join(t):
    p = t.pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://([^?#]+)", 1).alias("path"))
    roots = p.select(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("root")).distinct()
    return under(p, "path", roots, "root").groupBy("root").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


@query("WITH f AS (SELECT p_partkey, p_name, strlen(p_name) AS cost FROM part ORDER BY p_name, p_partkey LIMIT 200), r AS (SELECT *, sum(cost) OVER (ORDER BY p_name, p_partkey ROWS UNBOUNDED PRECEDING) AS run FROM f) SELECT p_partkey, p_name FROM r WHERE run <= 700")
def alternatives_budget_page(t):
    return budget_prefix(t.part.select("p_partkey", "p_name"), [F.asc("p_name"), F.asc("p_partkey")], F.octet_length("p_name"), 700, 200)


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS position FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 40")
def ordinal_after_limit(t):
    from pyspark.sql import Window

    few = t.part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(40)  # the one-task window sees forty rows
    return few.select("p_partkey", "p_name", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).cast("bigint").alias("position"))


@query(
    r"""WITH s AS (SELECT doc_id, generate_subscripts(lines, 1) AS line, unnest(lines) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)),
    h AS (SELECT *, sum(CASE WHEN regexp_matches(body, '^[A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM s)
    SELECT doc_id, CAST(section AS BIGINT) AS section, min(line) AS first_line, count(*) AS lines, CAST(sum(strlen(body)) AS BIGINT) AS bytes FROM h GROUP BY doc_id, section"""
)
def markdown_windows(t):
    # sections of a document are counted within its own array, so nothing is dealt by document for the running sum
    lines = F.split("text", "\n")
    flags = F.transform("lines", lambda b: F.when(b.rlike("^[A-Z]"), 1).otherwise(0))
    d = t.documents.select("doc_id", lines.alias("lines")).withColumn("flags", flags)
    d = d.select("doc_id", F.posexplode(F.arrays_zip("lines", "flags")).alias("line", "x"))
    from pyspark.sql import Window

    run = F.sum("x.flags").over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("section", run).groupBy("doc_id", "section").agg((F.min("line") + 1).cast("bigint").alias("first_line"), F.count("*").alias("lines"), F.sum(F.octet_length("x.lines")).cast("bigint").alias("bytes"))


@query("SELECT doc_id, left(text, 60) AS excerpt, sha256('document:' || doc_id) AS evidence_id FROM documents WHERE lang = 'en'")
def citation_excerpts(t):
    return t.documents.where("lang = 'en'").select("doc_id", F.left(F.col("text"), F.lit(60)).alias("excerpt"), F.sha2(F.concat(F.lit("document:"), F.col("doc_id").cast("string")), 256).alias("evidence_id"))
