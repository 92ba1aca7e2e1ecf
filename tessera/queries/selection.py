"""Selection of releases, distribution files and requirements; the registries are made of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans import selection
from tessera.queries.registry import query

_RELEASES = "SELECT p_name AS package, p_partkey AS source_line, p_partkey % 9 = 0 AS yanked, p_partkey % 4 = 0 AS pre, p_size || '.' || replace(p_brand, 'Brand#', '') || '.' || (p_partkey % 10) || CASE WHEN p_partkey % 4 = 0 THEN '-rc.' || (p_partkey % 7) ELSE '' END AS vers, [p_size, CAST(replace(p_brand, 'Brand#', '') AS INTEGER), p_partkey % 10, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 7 ELSE 0 END, p_partkey] AS o FROM part"


def releases(t):
    pre = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("-rc."), (F.col("p_partkey") % 7).cast("string"))).otherwise("")
    vers = F.concat_ws(".", F.col("p_size").cast("string"), F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")), F.concat((F.col("p_partkey") % 10).cast("string"), pre))
    return t.part.select(F.col("p_name").alias("package"), vers.alias("vers"), (F.col("p_partkey") % 9 == 0).alias("yanked"), F.col("p_partkey").alias("source_line"))


@query(
    f"""WITH v AS ({_RELEASES}),
    r AS (SELECT source_line AS id, CASE WHEN source_line % 23 = 0 THEN 'absent' ELSE package END AS package, source_line % 3 = 0 AS pre, source_line % 7 = 0 AS yank,
      CASE source_line % 5 WHEN 1 THEN vers WHEN 2 THEN '60.' || (source_line % 30) || '.0' WHEN 3 THEN 'x' || vers WHEN 4 THEN '25.' || (source_line % 60) || '.11' END AS requested,
      CASE source_line % 5 WHEN 1 THEN list_slice(o, 1, 5) WHEN 2 THEN [60, source_line % 30, 0, 1, 0] WHEN 4 THEN [25, source_line % 60, 11, 1, 0] END AS key FROM v),
    c AS (SELECT package, count(*) AS published FROM v GROUP BY 1),
    s AS (SELECT package, arg_max(vers, o) AS stable FROM v WHERE NOT pre AND NOT yanked GROUP BY 1),
    a AS (SELECT package, arg_max(vers, o) AS newest FROM v WHERE NOT yanked GROUP BY 1),
    p AS (SELECT r.id, arg_max(struct_pack(vers := v.vers, source_line := v.source_line, yanked := v.yanked), v.o) AS p FROM r JOIN v USING (package)
      WHERE (requested IS NOT NULL AND v.vers = requested) OR (requested IS NULL AND (r.pre OR NOT v.pre) AND (r.yank OR NOT v.yanked)) GROUP BY r.id),
    d AS (SELECT r.*, coalesce(published, 0) AS published, stable, newest, p.p,
      CASE WHEN published IS NULL THEN 'no_versions' WHEN requested IS NOT NULL AND key IS NULL THEN 'invalid' WHEN p.p IS NULL AND requested IS NOT NULL THEN 'not_found'
        WHEN p.p IS NULL THEN 'no_eligible' WHEN p.p.yanked AND NOT yank THEN 'yanked' ELSE 'selected' END AS status
      FROM r LEFT JOIN c USING (package) LEFT JOIN s USING (package) LEFT JOIN a USING (package) LEFT JOIN p ON p.id = r.id),
    n AS (SELECT d.id, v.vers, v.o, list_slice(v.o, 1, 5) < d.key AS under FROM d JOIN v USING (package) WHERE status = 'not_found'),
    k AS (FROM n QUALIFY (under AND row_number() OVER (PARTITION BY id, under ORDER BY o DESC) <= 3) OR (NOT under AND row_number() OVER (PARTITION BY id, under ORDER BY o) <= 3)),
    l AS (SELECT id, list_slice(list(vers ORDER BY o), 1, 5) AS near FROM k GROUP BY id)
    SELECT d.id AS request_id, status, CASE WHEN status = 'selected' THEN p.vers END AS version, CASE WHEN status = 'selected' THEN p.source_line END AS source_line, stable AS newest_stable, newest AS newest_any,
      coalesce(status = 'selected' AND p.vers = stable, false) AS resolved_is_newest_stable, published AS published_versions, array_to_string(near, ' ') AS neighbours FROM d LEFT JOIN l ON l.id = d.id"""
)
def release_selection(t):
    r = releases(t)
    k = F.col("source_line")
    requested = F.when(k % 5 == 1, F.col("vers")).when(k % 5 == 2, F.concat(F.lit("60."), (k % 30).cast("string"), F.lit(".0"))).when(k % 5 == 3, F.concat(F.lit("x"), "vers")).when(k % 5 == 4, F.concat(F.lit("25."), (k % 60).cast("string"), F.lit(".11")))
    asked = r.select(k.alias("request_id"), F.when(k % 23 == 0, "absent").otherwise(F.col("package")).alias("package"), requested.alias("requested"), (k % 3 == 0).alias("allow_prerelease"), (k % 7 == 0).alias("allow_yanked"))
    return selection.select_releases(asked, r).withColumn("neighbours", F.array_join("neighbours", " "))


_FILES = """SELECT s_suppkey, l_partkey AS n, 'p' || s_suppkey AS project, l_partkey % 40 AS major, l_linenumber AS minor, l_partkey % 5 = 0 AS pre, (l_partkey % 40) || '.' || l_linenumber || CASE WHEN l_partkey % 5 = 0 THEN 'rc1' ELSE '' END AS version,
      l_orderkey % 4 AS kind, l_partkey % 11 = 0 AS yanked, l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""


@query(
    f"""WITH f AS ({_FILES}),
    g AS (SELECT *, CASE kind WHEN 0 THEN project || '-' || version || '.tar.gz' WHEN 1 THEN project || '-' || version || '-py3-none-any.whl' WHEN 2 THEN project || '-' || version || '-cp39.cp311-abi3-linux_x86_64.whl' ELSE project || '-' || version || '-cp312-cp312-win_amd64.whl' END AS filename,
      CASE n % 3 WHEN 0 THEN '>=3.8' WHEN 1 THEN '>=3.12' END AS needs, CASE WHEN n % 13 = 0 THEN 'none' ELSE repeat('a', 64) END AS sha FROM f),
    r AS (SELECT s_suppkey AS id, 'p' || s_suppkey AS project, s_suppkey % 2 = 0 AS allow_pre, s_suppkey % 3 = 0 AS allow_yanked, s_suppkey % 5 = 0 AS wheels, CASE s_suppkey % 4 WHEN 0 THEN '39.1' END AS requested, CASE WHEN s_suppkey % 7 = 0 THEN '<20' END AS cons FROM supplier),
    e AS (SELECT r.id, g.version, filename, major, minor, g.pre, CASE WHEN kind IN (1, 2) THEN 0 WHEN kind = 0 AND NOT wheels THEN 1 END AS rank FROM r JOIN g USING (project)
      WHERE (CASE WHEN requested IS NOT NULL THEN major = 39 AND minor = 1 AND NOT g.pre ELSE allow_pre OR NOT g.pre END) AND (allow_yanked OR NOT yanked) AND coalesce(needs = '>=3.8', true) AND (cons IS NULL OR major < 20) AND sha <> 'none')
    SELECT id AS request_id, version, filename FROM e WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY major DESC, minor DESC, NOT pre DESC, rank, filename, version) = 1"""
)
def distribution_selection(t):
    n, kind = F.col("l_partkey"), F.col("l_orderkey") % 4
    project = F.concat(F.lit("p"), F.col("l_suppkey").cast("string"))
    version = F.concat((n % 40).cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.when(n % 5 == 0, "rc1").otherwise(""))
    stem = F.concat(project, F.lit("-"), version)
    name = F.concat(stem, F.when(kind == 0, ".tar.gz").when(kind == 1, "-py3-none-any.whl").when(kind == 2, "-cp39.cp311-abi3-linux_x86_64.whl").otherwise("-cp312-cp312-win_amd64.whl"))
    files = t.lineitem.select(
        project.alias("project"), version.alias("version"), name.alias("filename"), F.when(kind == 0, "sdist").otherwise("bdist_wheel").alias("packagetype"), (n % 11 == 0).alias("yanked"),
        F.when(n % 3 == 0, ">=3.8").when(n % 3 == 1, ">=3.12").alias("requires_python"), F.when(n % 13 == 0, "none").otherwise(F.repeat(F.lit("a"), 64)).alias("sha256"),
    )
    s = F.col("s_suppkey")
    requests = t.supplier.select(
        s.alias("request_id"), F.concat(F.lit("p"), s.cast("string")).alias("project"), F.when(s % 4 == 0, "39.1").alias("requested"), F.lit("3.11").alias("python_version"), F.lit("linux_x86_64").alias("target"),
        F.when(s % 7 == 0, "<20").alias("constraint"), (s % 3 == 0).alias("allow_yanked"), (s % 2 == 0).alias("allow_prerelease"), (s % 5 == 0).alias("wheels_only"),
    )
    return selection.select_distributions(requests, files.distinct())


@query(
    """WITH q AS (SELECT p_partkey AS requirement_id, p_size % 25 AS owner, p_partkey % 6 AS m FROM part),
    e AS (SELECT n_nationkey AS environment_id, n_nationkey % 3 = 0 AS win, n_nationkey % 2 = 0 AS old, CASE n_nationkey % 4 WHEN 0 THEN ['dev', 'docs'] WHEN 1 THEN ['dev'] ELSE [''] END AS extras FROM nation),
    x AS (SELECT environment_id, win, old, unnest(extras) AS extra FROM e)
    SELECT DISTINCT environment_id, requirement_id FROM q JOIN x ON owner = environment_id
    WHERE CASE m WHEN 0 THEN true WHEN 1 THEN win WHEN 2 THEN old WHEN 3 THEN extra = 'dev' WHEN 4 THEN extra = 'docs' AND NOT win ELSE NOT old OR win END"""
)
def active_requirements(t):
    marker = F.element_at(F.array(*(F.lit(m) for m in ("", "sys_platform == 'win32'", "python_version < '3.10'", "extra == 'dev'", "extra == 'docs' and sys_platform != 'win32'", "python_version >= '3.10' or sys_platform == 'win32'"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    requirements = t.part.select((F.col("p_size") % 25).alias("owner"), F.col("p_partkey").alias("requirement_id"), F.nullif(marker, F.lit("")).alias("marker"))
    k = F.col("n_nationkey")
    environment = F.struct(F.when(k % 3 == 0, "win32").otherwise("linux").alias("sys_platform"), F.when(k % 2 == 0, "3.9").otherwise("3.11").alias("python_version"))
    extras = F.when(k % 4 == 0, F.array(F.lit("dev"), F.lit("docs"))).when(k % 4 == 1, F.array(F.lit("dev"))).otherwise(F.array().cast("array<string>"))
    return selection.active_requirements(requirements, t.nation.select(k.alias("owner"), k.alias("environment_id"), environment.alias("environment"), extras.alias("extras")))
