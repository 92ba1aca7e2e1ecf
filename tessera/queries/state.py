"""Telemetry, coverage, version choice, change plans, job state and policy queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.text import semver_key, url_parts
from tessera.operators.relational import ordered_list, ordered_set, pick
from tessera.queries.registry import query

_K = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"


def k():
    return F.get_json_object("props", "$.k").try_cast("bigint")


@query(f"SELECT count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'purchase' AND value > 50) AS large, CAST(coalesce(sum({_K}), 0) AS BIGINT) AS k_total, count(*) AS events FROM events")
def telemetry_rollup(t):
    return t.events.agg(F.expr("count(*) FILTER (WHERE event_type = 'view')").alias("views"), F.expr("count(*) FILTER (WHERE event_type = 'error')").alias("errors"), F.expr("count(*) FILTER (WHERE event_type = 'purchase' AND value > 50)").alias("large"), F.coalesce(F.sum(k()), F.lit(0)).cast("bigint").alias("k_total"), F.count("*").alias("events"))


@query(f"SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS completed, count(*) FILTER (WHERE event_type = 'error') AS incomplete, CAST(coalesce(sum({_K}) FILTER (WHERE event_type = 'click'), 0) AS BIGINT) AS click_k, max(event_id) AS last_event FROM events GROUP BY user_id")
def telemetry_by_operation(t):
    click = F.when(F.col("event_type") == "click", k())
    return t.events.groupBy("user_id").agg(F.expr("count(*) FILTER (WHERE event_type <> 'error')").alias("completed"), F.expr("count(*) FILTER (WHERE event_type = 'error')").alias("incomplete"), F.coalesce(F.sum(click), F.lit(0)).cast("bigint").alias("click_k"), F.max("event_id").alias("last_event"))


@query("SELECT event_id, user_id, value FROM (SELECT * FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 8) ORDER BY event_id")
def telemetry_last_queries(t):
    return t.events.where("event_type = 'purchase'").orderBy(F.desc("event_id")).limit(8).select("event_id", "user_id", "value")


@query("SELECT lang, bool_and(l.doc_id IS NOT NULL) AS complete, count(*) AS assessed, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, array_to_string(list(DISTINCT d.source ORDER BY d.source) FILTER (WHERE l.doc_id IS NULL), ',') AS limited_sources FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def coverage_summary(t):
    j = t.documents.select("doc_id", "lang", "source").join(t.labels.select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    lacking = F.when(F.col("known").isNull(), F.col("source"))
    return j.groupBy("lang").agg(F.bool_and(F.col("known").isNotNull()).alias("complete"), F.count("*").alias("assessed"), F.count(lacking).alias("missing"), F.array_join(ordered_set(lacking), ",").alias("limited_sources"))


_RANK = "CASE WHEN quality = 1 THEN 3 WHEN toxic = 1 THEN 1 WHEN quality = 0 THEN 2 ELSE 0 END"


@query(f"WITH r AS (SELECT d.source, d.lang, d.doc_id, {_RANK} AS rank FROM documents d LEFT JOIN labels l USING (doc_id)), b AS (SELECT *, max(rank) OVER (PARTITION BY source, lang) AS best FROM r) SELECT source, lang, CASE best WHEN 3 THEN 'indexed' WHEN 2 THEN 'partial' WHEN 1 THEN 'missing' ELSE 'unknown' END AS state, min(doc_id) AS witness FROM b WHERE rank = best GROUP BY source, lang, best")
def coverage_rank(t):
    rank = F.when(F.col("quality") == 1, 3).when(F.col("toxic") == 1, 1).when(F.col("quality") == 0, 2).otherwise(0)
    r = t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id", "left").withColumn("rank", rank)
    best = r.groupBy("source", "lang").agg(F.max("rank").alias("best"), F.min_by("doc_id", F.struct(-F.col("rank"), "doc_id")).alias("witness"))
    state = F.when(F.col("best") == 3, "indexed").when(F.col("best") == 2, "partial").when(F.col("best") == 1, "missing").otherwise("unknown")
    return best.select("source", "lang", state.alias("state"), "witness")


@query(
    """WITH f AS (SELECT lang, count(*) AS rows, count(*) FILTER (WHERE l.toxic = 1) AS failed, bool_and(l.doc_id IS NOT NULL) AS complete FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang)
    SELECT lang, CASE WHEN failed > 20 THEN 'failed' WHEN rows = 0 AND complete THEN 'absent' WHEN NOT complete AND rows < 40 THEN 'unavailable' ELSE 'available' END AS outcome, NOT complete OR failed > 20 AS partial FROM f"""
)
def outcome_classification(t):
    j = t.documents.select("doc_id", "lang").join(t.labels.withColumn("known", F.lit(True)), "doc_id", "left")
    f = j.groupBy("lang").agg(F.count("*").alias("rows"), F.count(F.when(F.col("toxic") == 1, 1)).alias("failed"), F.bool_and(F.col("known").isNotNull()).alias("complete"))
    outcome = F.when(F.col("failed") > 20, "failed").when((F.col("rows") == 0) & F.col("complete"), "absent").when(~F.col("complete") & (F.col("rows") < 40), "unavailable").otherwise("available")
    return f.select("lang", outcome.alias("outcome"), (~F.col("complete") | (F.col("failed") > 20)).alias("partial"))


_VERSIONS = "SELECT p_partkey, p_name, p_size AS major, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS minor, p_partkey % 10 AS patch, p_partkey % 4 = 0 AS pre, p_partkey % 9 = 0 AS yanked, p_size || '.' || replace(p_brand, 'Brand#', '') || '.' || (p_partkey % 10) || CASE WHEN p_partkey % 4 = 0 THEN '-rc.' || (p_partkey % 7) ELSE '' END AS version FROM part"
_ORDER = "major DESC, minor DESC, patch DESC, pre, p_partkey % 7 DESC, p_partkey DESC"


def versions(t):
    pre = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("-rc."), (F.col("p_partkey") % 7).cast("string"))).otherwise("")
    version = F.concat_ws(".", F.col("p_size").cast("string"), F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")), F.concat((F.col("p_partkey") % 10).cast("string"), pre))
    v = t.part.select("p_partkey", "p_name", (F.col("p_partkey") % 4 == 0).alias("pre"), (F.col("p_partkey") % 9 == 0).alias("yanked"), version.alias("version"))
    return v.withColumn("precedence", semver_key(F.col("version")))


@query(f"WITH v AS ({_VERSIONS}) SELECT s.version AS newest_stable, a.version AS newest_any, s.version = a.version AS stable_is_newest, (SELECT count(*) FROM v) AS published_versions FROM (SELECT version FROM v WHERE NOT pre AND NOT yanked ORDER BY {_ORDER} LIMIT 1) s, (SELECT version FROM v WHERE NOT yanked ORDER BY {_ORDER} LIMIT 1) a")
def semver_select(t):
    v = versions(t)
    top = lambda cond: F.max_by(F.when(cond, F.col("version")), F.when(cond, F.struct("precedence", F.when(F.col("pre"), F.col("p_partkey") % 7).otherwise(F.col("p_partkey") % 7), "p_partkey")))
    out = v.agg(top(~F.col("pre") & ~F.col("yanked")).alias("newest_stable"), top(~F.col("yanked")).alias("newest_any"), F.count("*").alias("published_versions"))
    return out.withColumn("stable_is_newest", F.col("newest_stable") == F.col("newest_any"))


@query(f"WITH v AS ({_VERSIONS}) SELECT p_name, version, yanked FROM v WHERE NOT pre QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY {_ORDER}) = 1")
def semver_per_package(t):
    return pick(versions(t).where("NOT pre"), ["p_name"], [F.desc("precedence"), F.desc(F.col("p_partkey") % 7), F.desc("p_partkey")]).select("p_name", "version", "yanked")


@query(f"WITH v AS (SELECT * FROM ({_VERSIONS}) WHERE NOT pre), below AS (SELECT version, p_partkey FROM v WHERE (major, minor, patch) < (25, 30, 0) ORDER BY {_ORDER} LIMIT 3), above AS (SELECT version, p_partkey FROM v WHERE (major, minor, patch) >= (25, 30, 0) ORDER BY major, minor, patch, p_partkey % 7, p_partkey LIMIT 3) SELECT version, p_partkey FROM below UNION ALL SELECT version, p_partkey FROM above")
def semver_neighbours(t):
    v = versions(t).where("NOT pre")
    key = semver_key(F.lit("25.30.0"))
    tie = F.col("p_partkey") % 7
    below = v.where(F.col("precedence") < key).orderBy(F.desc("precedence"), F.desc(tie), F.desc("p_partkey")).limit(3)
    above = v.where(F.col("precedence") >= key).orderBy("precedence", tie, "p_partkey").limit(3)
    return below.unionByName(above).select("version", "p_partkey")


_OLD = "SELECT o_orderkey AS key, o_orderstatus AS v FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'"
_NEW = "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 6 = 0 THEN 'Z' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 5 <> 0"


def cohorts(t):
    old = t.orders.where("o_orderdate < TIMESTAMP_NTZ '1997-01-01'").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("v"))
    new = t.orders.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 6 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("v"))
    return old, new


@query(f"WITH a AS ({_OLD}), b AS ({_NEW}) SELECT key, CASE WHEN a.key IS NULL THEN 'insert' WHEN b.key IS NULL THEN 'delete' ELSE 'update' END AS change FROM a FULL JOIN b USING (key) WHERE a.v IS DISTINCT FROM b.v")
def cdf_change_plan(t):
    from tessera.sources.cohorts import change_plan

    return change_plan(*cohorts(t), ["key"]).select("key", "change")


@query(f"SELECT key, lower(v) AS projected FROM ({_NEW})")
def incremental_projection(t):
    """The projection of the new version, had by changing the old projection only where the change plan says so; a full rebuild gives the same."""
    from tessera.sources.cohorts import change_plan

    old, new = cohorts(t)
    project = lambda df: df.select("key", F.lower("v").alias("projected"))
    affected = change_plan(old, new, ["key"]).select("key")
    return project(old).join(affected, "key", "left_anti").unionByName(project(new.join(affected, "key", "left_semi")))


@query("WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type IN ('signup', 'click', 'purchase', 'error')), s AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS state FROM e WHERE rn = 1) SELECT state, count(*) AS jobs, state IN ('queued', 'running') AS active FROM s GROUP BY state")
def claim_state_machine(t):
    latest = t.events.where(F.col("event_type").isin("signup", "click", "purchase", "error")).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("e"))
    state = F.when(F.col("e") == "signup", "queued").when(F.col("e") == "click", "running").when(F.col("e") == "purchase", "succeeded").otherwise("failed")
    return latest.groupBy(state.alias("state")).agg(F.count("*").alias("jobs")).withColumn("active", F.col("state").isin("queued", "running"))


@query("WITH c AS (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt, event_type FROM events) SELECT user_id, event_id AS fence, nxt AS lease_end FROM c WHERE event_type = 'signup' AND (nxt IS NULL OR nxt - event_id > 40)")
def expired_claims(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    c = t.events.select("user_id", "event_id", "event_type", F.lead("event_id").over(w).alias("lease_end"))
    return c.where("event_type = 'signup' AND (lease_end IS NULL OR lease_end - event_id > 40)").select("user_id", F.col("event_id").alias("fence"), "lease_end")


def keepset(lines):
    p = lines.where("l_returnflag = 'R'")
    return p.groupBy(F.col("l_suppkey").alias("owner")).agg(F.array_join(ordered_set(F.col("l_partkey")), ",").alias("keep_versions"), F.min("l_partkey").alias("m"), (F.count("*") > 1).alias("vacuum_blocked")).select("owner", "keep_versions", F.when(F.col("owner") % 2 == 0, F.lit(0).cast("bigint")).otherwise(F.col("m")).alias("log_floor"), "vacuum_blocked")


@query("WITH p AS (SELECT l_suppkey AS owner, l_partkey AS version FROM lineitem WHERE l_returnflag = 'R') SELECT owner, array_to_string(list(DISTINCT version ORDER BY version), ',') AS keep_versions, CASE WHEN owner % 2 = 0 THEN 0 ELSE min(version) END AS log_floor, count(*) > 1 AS vacuum_blocked FROM p GROUP BY owner")
def retention_keepset(t):
    return keepset(t.lineitem)


_HOST = "lower(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1))"


@query(
    f"""WITH x AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'http://127.0.0.' || (page_id % 200) || '/x' WHEN page_id % 13 = 0 THEN 'not a url' WHEN page_id % 17 = 0 THEN 'https://10.1.2.3/' ELSE url END AS u, page_id % 7 AS hop FROM pages),
    p AS (SELECT *, regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1) AS scheme, {_HOST} AS host FROM x)
    SELECT page_id, CASE WHEN hop > 5 THEN 'redirect_limit' WHEN scheme = '' THEN 'invalid_url' WHEN scheme <> 'https' THEN 'scheme' WHEN host = '' THEN 'host_missing'
      WHEN host = 'localhost' OR starts_with(host, '127.') OR starts_with(host, '10.') THEN 'private_address' END AS refusal FROM p"""
)
def network_policy(t):
    from tessera.plans.policy import refusal

    u = F.when(F.col("page_id") % 11 == 0, F.concat(F.lit("http://127.0.0."), (F.col("page_id") % 200).cast("string"), F.lit("/x"))).when(F.col("page_id") % 13 == 0, "not a url").when(F.col("page_id") % 17 == 0, "https://10.1.2.3/").otherwise(F.col("url"))
    return t.pages.select("page_id", refusal(url_parts(u), F.col("page_id") % 7, 5, F.lit(False)).alias("refusal"))


@query("SELECT count(*) AS members, CAST(sum(len(k)) AS BIGINT) AS listed FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)")
def dependency_groups(t):
    g = t.orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(ordered_list(F.col("o_orderkey"), F.col("o_orderkey")).alias("k"))
    return g.agg(F.count("*").alias("members"), F.sum(F.size("k")).alias("listed"))


@query("SELECT c.conv_id, c.turn, c.role, p.turn AS before_turn FROM conversations c LEFT JOIN conversations p ON c.conv_id = p.conv_id AND p.turn = c.turn - 1")
def conversation_chain(t):
    c = t.conversations.select("conv_id", "turn", "role")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("before_turn"))
    return c.join(before, ["conv_id", "turn"], "left")
