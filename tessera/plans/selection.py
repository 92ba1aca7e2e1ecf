"""Which release, file and requirements a request gets: many requests against a registry at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import is_prerelease, semver_key
from tessera.functions.versions import pep440_matches, pep440_value
from tessera.sources.workers import materialise


def select_releases(requests: DataFrame, releases: DataFrame) -> DataFrame:
    """Per request the release it gets, or why it gets none.

    ``requests`` are (request_id, package, requested, allow_prerelease, allow_yanked), ``releases`` (package, vers,
    yanked, source_line).  A requested version is exact and never upgraded; without one the newest that the
    flags allow is taken.  ``status`` is no_versions, invalid, not_found (with up to five
    ``neighbours``), no_eligible, yanked or selected.  Of releases of one precedence the later line wins.

    A package's newest releases are aggregates, so requests for newest ones read a row a package.
    """
    facts = releases.withColumns({"precedence": semver_key(F.col("vers")), "pre": is_prerelease(F.col("vers"))})
    facts = materialise(facts, "releases")  # versions are read once, not for each use
    order = F.struct("precedence", "source_line")
    row = F.struct("vers", "source_line", "yanked")

    def newest(allowed: Column) -> Column:
        return F.max_by(F.when(allowed, row), F.when(allowed & F.col("precedence").isNotNull(), order))

    stable, mature = ~F.col("pre"), ~F.col("yanked")
    per = facts.groupBy("package").agg(
        F.count("*").alias("published_versions"),
        newest(F.lit(True)).alias("any"),
        newest(mature).alias("unyanked"),
        newest(stable).alias("released"),
        newest(stable & mature).alias("usual"),
    )
    # a row a version, so that no request meets each release of its version
    exact = facts.where("precedence IS NOT NULL").groupBy("package", F.col("vers").alias("requested")).agg(F.max_by(row, order).alias("exact"))
    r = requests.join(per, "package", "left").join(exact, ["package", "requested"], "left")
    chosen = F.when(F.col("allow_prerelease"), F.when(F.col("allow_yanked"), F.col("any")).otherwise(F.col("unyanked"))).otherwise(F.when(F.col("allow_yanked"), F.col("released")).otherwise(F.col("usual")))
    r = r.withColumn("picked", F.when(F.col("requested").isNotNull(), F.col("exact")).otherwise(chosen))
    published = F.coalesce("published_versions", F.lit(0))
    status = (
        F.when(published == 0, "no_versions")
        .when(F.col("requested").isNotNull() & semver_key(F.col("requested")).isNull(), "invalid")
        .when(F.col("picked").isNull() & F.col("requested").isNotNull(), "not_found")
        .when(F.col("picked").isNull(), "no_eligible")
        .when(F.col("picked.yanked") & ~F.col("allow_yanked"), "yanked")
        .otherwise("selected")
    )
    r = r.withColumn("status", status)
    near = neighbours(r.where("status = 'not_found'").select("package", "requested"), facts)
    got = F.col("status") == "selected"
    return r.join(near, ["package", "requested"], "left").select(
        "request_id",
        "status",
        F.when(got, F.col("picked.vers")).alias("version"),
        F.when(got, F.col("picked.source_line")).alias("source_line"),
        F.col("usual.vers").alias("newest_stable"),
        F.col("unyanked.vers").alias("newest_any"),
        F.coalesce(got & (F.col("picked.vers") == F.col("usual.vers")), F.lit(False)).alias("resolved_is_newest_stable"),
        published.alias("published_versions"),
        "neighbours",
    )


def neighbours(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """Per package and requested version the first five, in order, of the three releases below and the three at or above it.

    Releases and requested versions are put in one order and every release is numbered, so a version
    meets the six releases around its place and no others.  The order is dealt by ranges: a large package is many tasks.
    """
    wanted = asked.distinct().select("package", semver_key(F.col("requested")).alias("precedence"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("source_line"), F.col("requested").alias("vers"))
    wanted = materialise(wanted, "wanted")
    known = facts.where("precedence IS NOT NULL").select("package", "precedence", F.lit(1).alias("kind"), F.col("source_line").cast("long").alias("source_line"), "vers")
    order = ["package", "precedence", "kind", "source_line"]
    dealt = known.join(wanted.select("package").distinct(), "package", "left_semi").unionByName(wanted).repartitionByRange(*order)
    dealt = materialise(dealt.withColumn("part", F.spark_partition_id()), "release-order")  # written, as ranges may differ when they are drawn again
    within = F.sum("kind").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("part").agg(F.sum("kind").alias("held")).select("part", before.alias("before"))  # a row a task
    placed = dealt.withColumn("within", within).join(starts, "part").withColumn("place", F.col("before") + F.col("within"))
    around = placed.where("kind = 0").select("package", F.col("vers").alias("requested"), F.explode(F.sequence(F.col("place") - 2, F.col("place") + 3)).alias("place"))
    six = around.join(placed.where("kind = 1").select("package", "place", "vers"), ["package", "place"])
    six = six.groupBy("package", "requested").agg(F.array_sort(F.collect_list(F.struct("place", "vers"))).alias("x"))
    return six.select("package", "requested", F.slice(F.transform("x", lambda v: v["vers"]), 1, 5).alias("neighbours"))


def wheel_fits(filename: Column, major: Column, minor: Column, target: Column) -> Column:
    """Whether a wheel's tags fit an interpreter (major, minor; null if unknown) and a platform (null if unknown)."""
    stem = F.regexp_replace(filename, r"\.whl$", "")
    part = lambda i: F.split(F.element_at(F.split(stem, "-"), i), r"\.")
    py, cp = F.concat(F.lit("py"), major.cast("string")), F.concat(F.lit("cp"), major.cast("string"), minor.cast("string"))
    both = F.concat(py, minor.cast("string"))

    def pure(i: Column) -> Column:
        return F.when(minor.isNull(), i == "py3").otherwise((i == py) | (i == both))

    def built(i: Column, abi: Column) -> Column:
        own = (i == cp) & ((abi == i) | (abi == "none") | (abi == "abi3"))
        older = (abi == "abi3") & (major == 3) & i.startswith("cp3") & (F.substring(i, 4, 9).try_cast("long") <= minor)
        return F.coalesce(own | older, F.lit(False))

    shape = filename.rlike(r"^[^-]+-[^-]+(-[^-]+)?-[^-]+-[^-]+-[^-]+\.whl$")
    anywhere = F.exists(part(-3), lambda i: F.coalesce(pure(i), F.lit(False))) & F.array_contains(part(-2), "none") & F.array_contains(part(-1), "any")
    here = minor.isNotNull() & F.coalesce(F.array_contains(part(-1), target), F.lit(False)) & F.exists(part(-3), lambda i: F.exists(part(-2), lambda abi: built(i, abi)))
    return shape & (anywhere | here)


def select_distributions(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Per request the file it gets: request_id, version, filename; requests without one have no row.

    ``requests`` are (request_id, project, requested, python_version, target, constraint, allow_yanked, allow_prerelease,
    wheels_only), ``files`` (project, version, filename, packagetype, yanked, requires_python, sha256).  The highest
    version wins, then a fitting wheel before a source archive, then the filename.
    """
    parsed = files.where(F.col("sha256").rlike("^[0-9a-fA-F]{64}$")).withColumn("v", pep440_value(F.col("version"))).where("v.sort_key IS NOT NULL")
    asked = requests.withColumns({"want": pep440_value(F.col("requested")), "python": pep440_value(F.col("python_version"))})
    both = asked.join(parsed, "project").where(
        F.when(F.col("requested").isNotNull(), F.col("v.sort_key") == F.col("want.sort_key")).otherwise(F.col("allow_prerelease") | ~F.col("v.prerelease"))
    ).where("allow_yanked OR NOT yanked")
    both = both.withColumns({"python_fits": pep440_matches(F.col("requires_python"), F.col("python_version")), "constraint_fits": pep440_matches(F.col("constraint"), F.col("version"))})
    both = both.where("coalesce(python_fits, true) AND coalesce(constraint_fits, true)")
    wheel = (F.col("packagetype") == "bdist_wheel") & wheel_fits(F.col("filename"), F.get("python.release", F.lit(0)), F.get("python.release", F.lit(1)), F.col("target"))
    source = ~F.col("wheels_only") & (F.col("packagetype") == "sdist") & F.col("filename").rlike(r"\.(tar\.gz|zip)$")
    fits = both.withColumn("rank", F.when(wheel, 0).when(source, 1)).where("rank IS NOT NULL")
    best = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("v.sort_key"), "rank", "filename", "version"))
    return fits.withColumn("n", best).where("n = 1").select("request_id", "version", "filename")


@F.pandas_udf(T.BooleanType())
def marker_holds(marker: pd.Series, environment: pd.DataFrame, extra: pd.Series) -> pd.Series:
    """Whether a requirement's marker holds in an environment with one extra (an empty text for none); no marker always does."""
    from packaging.markers import Marker

    known: dict[str, Marker] = {}
    names = list(environment.columns)
    out = []
    for text, values, one in zip(marker, environment.itertuples(index=False, name=None), extra, strict=True):
        if text is None:
            out.append(True)
            continue
        parsed = known.get(text)
        if parsed is None:
            parsed = known[text] = Marker(text)
        out.append(parsed.evaluate({**{n: v or "" for n, v in zip(names, values, strict=True)}, "extra": one or ""}))
    return pd.Series(out, dtype=bool)


def active_requirements(requirements: DataFrame, environments: DataFrame) -> DataFrame:
    """Environments with the requirements that are active in them: (environment_id, requirement_id), each once.

    ``requirements`` are (owner, requirement_id, marker), ``environments`` (owner, environment_id, environment, extras); with no extras
    the empty one stands in.
    """
    extras = F.when(F.size("extras") > 0, F.col("extras")).otherwise(F.array(F.lit("")))
    each = environments.select("owner", "environment_id", "environment", F.explode(extras).alias("extra"))
    return requirements.join(each, "owner").where(marker_holds("marker", "environment", "extra")).select("environment_id", "requirement_id").distinct()
