"""Scalar function families."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import versions as v
from tessera.functions.text import is_prerelease, semver_key, terms, url_parts
from tessera.queries.registry import query


@query(
    """SELECT p_partkey, coalesce(nullif(p_type, 'ECONOMY'), 'plain') AS kind, least(p_size, 20) AS small, greatest(p_size, 20) AS large, TRY_CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS brand_no,
      lower(p_name) AS lowered, trim('  ' || p_name || ' ') AS trimmed, starts_with(p_name, 'cold') AS cold, p_name LIKE '%widget' AS widget, contains(p_name, 'd w') AS has_dw, strpos(p_name, ' ') AS space_at,
      split_part(p_name, ' ', -1) AS last_word, substr(p_name, 2, 3) AS middle, left(p_name, 4) AS beginning, repeat('ab', 2) AS twice, chr(65 + p_size % 26) AS letter, length(p_name) AS characters, strlen(p_name) AS bytes,
      concat(p_type, NULL, p_brand) AS joined FROM part"""
)
def scalar_string_suite(t):
    c = F.col
    return t.part.select(
        "p_partkey",
        F.coalesce(F.nullif(c("p_type"), F.lit("ECONOMY")), F.lit("plain")).alias("kind"),
        F.least(c("p_size"), F.lit(20)).alias("small"),
        F.greatest(c("p_size"), F.lit(20)).alias("large"),
        F.replace(c("p_brand"), F.lit("Brand#"), F.lit("")).try_cast("int").alias("brand_no"),
        F.lower("p_name").alias("lowered"),
        F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"),
        F.startswith("p_name", F.lit("cold")).alias("cold"),
        F.endswith("p_name", F.lit("widget")).alias("widget"),
        F.contains("p_name", F.lit("d w")).alias("has_dw"),
        F.instr("p_name", " ").cast("bigint").alias("space_at"),
        F.split_part(c("p_name"), F.lit(" "), F.lit(-1)).alias("last_word"),
        F.substring("p_name", 2, 3).alias("middle"),
        F.left(c("p_name"), F.lit(4)).alias("beginning"),
        F.repeat(F.lit("ab"), 2).alias("twice"),
        F.char(65 + c("p_size") % 26).alias("letter"),
        F.length("p_name").cast("bigint").alias("characters"),
        F.octet_length("p_name").cast("bigint").alias("bytes"),
        F.concat_ws("", "p_type", F.lit(None).cast("string"), "p_brand").alias("joined"),
    )


def matches(masked):
    return [F.col("text").rlike("[0-9]{4}").alias("has_number"), F.regexp_replace(masked, "[aeiou]+", "_").alias("masked"), F.regexp_extract("text", "([a-z]+)@", 1).alias("mail_name")]


@query(r"SELECT doc_id, regexp_matches(text, '[0-9]{4}') AS has_number, regexp_replace(text, '[aeiou]+', '_', 'g') AS masked, regexp_extract(text, '([a-z]+)@', 1) AS mail_name FROM documents")
def scalar_regex_suite(t):
    return t.documents.select("doc_id", *matches(F.col("text")))


@query(
    """WITH a AS (SELECT p_partkey, list_concat(string_split(p_name, ' '), [p_type, p_type]) AS w FROM part)
    SELECT p_partkey, len(w) AS size, list_contains(w, 'widget') AS has_widget, array_to_string(list_sort(w), ',') AS sorted, array_to_string(list_sort(list_distinct(w)), ',') AS distinct_sorted, w[2] AS second, array_to_string(w[1:2], '+') AS two,
      array_to_string(list_append(w, 'z'), ',') AS appended, len(list_intersect(w, ['cold', 'widget'])) AS common, list_has_any(w, ['hot', 'gear']) AS any_of, array_to_string(list_filter(w, lambda x: length(x) > 4), ',') AS long_words,
      array_to_string(list_transform(w, lambda x: upper(x)), ',') AS upper_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS letters, array_to_string(w[1:len(w) - 1], ',') AS without_last FROM a"""
)
def scalar_array_suite(t):
    a = t.part.select("p_partkey", F.concat(F.split("p_name", " "), F.array("p_type", "p_type")).alias("w"))
    j = lambda x, s=",": F.array_join(x, s)
    return a.select(
        "p_partkey",
        F.size("w").cast("bigint").alias("size"),
        F.array_contains("w", "widget").alias("has_widget"),
        j(F.array_sort("w")).alias("sorted"),
        j(F.array_sort(F.array_distinct("w"))).alias("distinct_sorted"),
        F.try_element_at("w", F.lit(2)).alias("second"),
        j(F.slice("w", 1, 2), "+").alias("two"),
        j(F.array_append("w", F.lit("z"))).alias("appended"),
        F.size(F.array_intersect("w", F.array(F.lit("cold"), F.lit("widget")))).cast("bigint").alias("common"),
        F.arrays_overlap("w", F.array(F.lit("hot"), F.lit("gear"))).alias("any_of"),
        j(F.filter("w", lambda x: F.length(x) > 4)).alias("long_words"),
        j(F.transform("w", lambda x: F.upper(x))).alias("upper_words"),
        F.aggregate("w", F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x)).alias("letters"),
        j(F.slice(F.col("w"), F.lit(1), F.size("w") - 1)).alias("without_last"),
    )


@query("SELECT p_partkey, unnest(['p_size', 'p_type']) AS name, unnest([CAST(p_size AS VARCHAR), p_type]) AS value FROM part")
def map_entries_unnest(t):
    m = F.create_map(F.lit("p_size"), F.col("p_size").cast("string"), F.lit("p_type"), F.col("p_type"))
    return t.part.select("p_partkey", F.explode(m).alias("name", "value"))


def tag_counts(lines):
    tags = lines.select("l_orderkey", F.explode(F.array("l_returnflag", "l_linestatus", F.lit(None))).alias("tag"))
    return tags.groupBy("l_orderkey", "tag").agg(F.count("*").alias("n"))


@query("SELECT i.l_orderkey, i.tag, count(*) AS n FROM (SELECT l_orderkey, unnest([l_returnflag, l_linestatus, NULL]) AS tag FROM lineitem) i GROUP BY ALL")
def unnest_keep_nulls(t):
    return tag_counts(t.lineitem)


@query("SELECT r_name || '-' || a || '-' || b AS tag FROM region, (SELECT unnest(['cp', 'py']) AS a), (SELECT unnest([1, 2, 3]) AS b)")
def tag_expansion(t):
    one = t.region.withColumn("a", F.explode(F.array(F.lit("cp"), F.lit("py"))))
    return one.withColumn("b", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(F.concat_ws("-", "r_name", "a", F.col("b").cast("string")).alias("tag"))


@query("SELECT event_id, date_trunc('hour', ts) AS hour, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds, year(ts) AS year, month(ts) AS month, day(ts) AS day FROM events")
def scalar_date_suite(t):
    utc = F.col("ts").cast("timestamp")
    return t.events.select("event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.unix_timestamp(utc).alias("seconds"), F.year("ts").cast("bigint").alias("year"), F.month("ts").cast("bigint").alias("month"), F.day("ts").cast("bigint").alias("day"))


@query("SELECT r_regionkey, sha256(r_name) AS digest, lower(hex(encode(r_name))) AS hexed, sha256('region:' || r_regionkey) AS identity FROM region")
def scalar_hash_suite(t):
    return t.region.select("r_regionkey", F.sha2("r_name", 256).alias("digest"), F.lower(F.hex(F.encode("r_name", "UTF-8"))).alias("hexed"), F.sha2(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")), 256).alias("identity"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), lambda x: strlen(x) >= 2))), ' ') AS terms FROM documents")
def tokenise(t):
    return t.documents.select("doc_id", F.array_join(F.array_sort(terms(F.col("text"))), " ").alias("terms"))


@query(r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, false AS has_credentials FROM pages")
def url_fields(t):
    u = url_parts(F.col("url"))
    return t.pages.select("page_id", u["scheme"].alias("scheme"), u["host"].alias("host"), u["has_credentials"].alias("has_credentials"))


@query("SELECT * FROM (VALUES ('1.0.0-alpha', 1, true), ('1.0.0-alpha.1', 2, true), ('1.0.0-beta.2', 3, true), ('1.0.0-beta.11', 4, true), ('1.0.0-rc.1', 5, true), ('1.0.0', 6, false), ('1.0.0+build', 6, false), ('2.10.0', 7, false), ('bad', NULL, NULL)) AS t(version, place, prerelease)")
def semver_order(t):
    from pyspark.sql import Window

    names = ["2.10.0", "1.0.0+build", "1.0.0", "1.0.0-rc.1", "1.0.0-beta.11", "1.0.0-beta.2", "1.0.0-alpha.1", "1.0.0-alpha", "bad"]
    rows = t.spark.createDataFrame([(n,) for n in names], "version string")
    key = semver_key(F.col("version"))
    place = F.when(key.isNotNull(), F.dense_rank().over(Window.orderBy(key.asc_nulls_last())))
    return rows.select("version", place.alias("place"), is_prerelease(F.col("version")).alias("prerelease"))


@query("SELECT * FROM (VALUES ('1.0.dev1', 1, true, true), ('1.0a1', 2, true, true), ('1.0b2', 3, true, true), ('1.0rc1', 4, true, true), ('1.0', 5, false, true), ('1.0.post1', 6, false, true), ('1!0.1', 7, false, false), ('nope', NULL, NULL, NULL)) AS t(version, place, prerelease, below_two)")
def pep440_order(t):
    from pyspark.sql import Window

    names = ["1!0.1", "1.0.post1", "1.0", "1.0rc1", "1.0b2", "1.0a1", "1.0.dev1", "nope"]
    rows = t.spark.createDataFrame([(n,) for n in names], "version string").withColumn("v", v.pep440_value("version"))
    place = F.when(F.col("v.sort_key").isNotNull(), F.dense_rank().over(Window.orderBy(F.col("v.sort_key").asc_nulls_last())))
    fits = F.when(F.col("v.sort_key").isNotNull(), v.pep440_matches(F.lit("<2"), F.when(F.col("v.sort_key").isNotNull(), F.col("version"))))
    return rows.select("version", place.alias("place"), F.col("v.prerelease").alias("prerelease"), fits.alias("below_two"))


@query("SELECT * FROM (VALUES ('package.name', 'str', 'demo'), ('dependencies.serde.version', 'str', '1'), ('dependencies.serde.features.0', 'str', 'derive'), ('features.default', 'list', NULL)) AS t(path, kind, text) WHERE kind <> 'list'")
def manifest_entries(t):
    text = '[package]\nname = "demo"\n[dependencies.serde]\nversion = "1"\nfeatures = ["derive"]\n'
    rows = t.spark.createDataFrame([(text,)], "text string").select(F.explode(v.toml_entries("text")).alias("e"))
    return rows.select(F.array_join("e.path", ".").alias("path"), "e.kind", "e.text")


@query("SELECT * FROM (VALUES ('Name', 'demo'), ('Requires-Dist', 'a'), ('Requires-Dist', 'b>=2')) AS t(name, value)")
def package_headers(t):
    rows = t.spark.createDataFrame([("Name: demo\nRequires-Dist: a\nRequires-Dist: b>=2\n\nbody",)], "text string")
    return rows.select(F.explode(v.metadata_headers("text")).alias("h")).select("h.name", "h.value")


@query("SELECT p_partkey, max(n) AS fits FROM (SELECT p_partkey, strlen(p_name[1:i]) AS n FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part)) WHERE n <= 9 GROUP BY p_partkey")
def prefix_within_budget(t):
    cuts = v.prefix_boundaries("p_name")
    fits = F.array_max(F.transform(F.filter(cuts, lambda b: b["bytes"] <= 9), lambda b: b["bytes"]))
    return t.part.select("p_partkey", fits.alias("fits"))


@query("SELECT p_partkey, strlen(p_name[1:4]) AS byte_at FROM part")
def utf16_positions(t):
    return t.part.select("p_partkey", v.utf16_to_utf8("p_name", F.lit(4).cast("long")).alias("byte_at"))
