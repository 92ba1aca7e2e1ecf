"""Compositions of DataFrame operations that plans share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.identity import row_fingerprint


class InvariantError(ValueError):
    """A relation that must be empty was not."""


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key.  Spark limits groups before the shuffle, so a hot key moves ``n`` rows a task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def keep_best(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """All rows at their key's highest score: a combining aggregate and a join, not a window over whole groups."""
    best = df.groupBy(*keys).agg(F.max(score).alias("__best"))
    return df.join(best, list(keys)).where(F.col(score) == F.col("__best")).drop("__best")


def ordered_list(value: Column, *order: Column) -> Column:
    """``array_agg(value ORDER BY order)``; nulls of ``order`` come last."""
    keys = [x for i, c in enumerate(order) for x in (c.isNull().alias(f"n{i}"), c.alias(f"k{i}"))]
    return F.transform(F.array_sort(F.collect_list(F.struct(*keys, value.alias("v")))), lambda s: s["v"])


def ordered_set(value: Column) -> Column:
    """``array_agg(DISTINCT value ORDER BY value)``."""
    return F.array_sort(F.collect_set(value))


def consensus(value: Column) -> Column:
    """The value if all rows agree on it, else null."""
    return F.when(F.min(value) == F.max(value), F.min(value))


def after(keys: Sequence[tuple[str, bool, object]]) -> Column:
    """Keyset predicate: rows strictly after ``(column, ascending, value)`` in lexicographic order."""
    out, equal = F.lit(False), F.lit(True)
    for name, up, value in keys:
        c = F.col(name)
        out = out | (equal & ((c > F.lit(value)) if up else (c < F.lit(value))))
        equal = equal & (c == F.lit(value))
    return out


def page(df: DataFrame, order: Sequence[Column], size: int) -> DataFrame:
    """One page and a row more; the extra row says that another page follows."""
    return df.orderBy(*order).limit(size + 1)


def page_boundary(total: Column, offset: int, size: int) -> dict[str, Column]:
    """Returned rows, whether more follow, and the next offset, computed in decimals so that nothing overflows."""
    wide = total.cast("decimal(20,0)")
    shown = F.greatest(F.least(wide - F.lit(offset).cast("decimal(20,0)"), F.lit(size).cast("decimal(20,0)")), F.lit(0).cast("decimal(20,0)")).cast("long")
    more = wide > F.lit(offset).cast("decimal(20,0)") + shown
    return {"returned": shown, "has_more": more, "next_offset": F.when(more, F.lit(offset).cast("long") + shown)}


def budget_prefix(df: DataFrame, order: Sequence[Column], cost: Column, budget: int, most: int) -> DataFrame:
    """The longest beginning of an ordered relation whose costs fit ``budget``, of at most ``most`` rows.  Limited before the one-task window."""
    few = df.withColumn("__cost", cost).orderBy(*order).limit(most)
    run = F.sum("__cost").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return few.withColumn("__run", run).where(F.col("__run") <= budget).drop("__cost", "__run")


def distinct_rows(df: DataFrame) -> DataFrame:
    """Distinct rows of any types, maps included, by fingerprint."""
    marked = df.withColumn("__print", row_fingerprint(df))
    return marked.dropDuplicates(["__print"]).drop("__print")


def changed_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose rows differ between two versions, with ``change``: added, removed or changed."""
    def prints(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, row_fingerprint(df).alias(name)).groupBy(*keys).agg(F.array_sort(F.collect_set(name)).alias(name))

    both = prints(old, "__old").join(prints(new, "__new"), list(keys), "full")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("__old").eqNullSafe(F.col("__new"))).select(*keys, change.alias("change"))


def once(rows: DataFrame, **columns) -> DataFrame:
    """``rows`` with these columns, each evaluated once a row however often it is used: neither filters nor projections move through a generator."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def touching(edges: DataFrame, ends: Sequence[str], chosen: DataFrame, key: str) -> DataFrame:
    """Edges with any end among ``chosen``, each as often as it stands: every end is marked by an equi-join, so no pair of tables is compared row by row."""
    marked = edges
    for i, end in enumerate(ends):
        ids = chosen.select(F.col(key).alias(f"__key{i}")).distinct().withColumn(f"__hit{i}", F.lit(True))
        marked = marked.join(ids, F.col(end) == F.col(f"__key{i}"), "left")
    return marked.where(F.coalesce(*(f"__hit{i}" for i in range(len(ends))))).select(edges.columns)


def under(rows: DataFrame, path: str, roots: DataFrame, root: str, sep: str = "/") -> DataFrame:
    """Rows joined with every root that is their path or a whole-component beginning of it: an equi-join on all beginnings."""
    parts = F.split(F.col(path), sep)
    begins = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))
    return rows.withColumn("__begin", F.explode(begins)).join(roots, F.col("__begin") == F.col(root)).drop("__begin")


def holds_all(required: DataFrame, durable: DataFrame) -> DataFrame:
    """Multiset containment: one row, whether each required row stands in ``durable`` as often or more."""
    want = required.select(row_fingerprint(required).alias("p")).groupBy("p").agg(F.count("*").alias("w"))
    have = durable.select(row_fingerprint(durable).alias("p")).groupBy("p").agg(F.count("*").alias("h"))
    return want.join(have, "p", "left").agg(F.coalesce(F.bool_and(F.coalesce("h", F.lit(0)) >= F.col("w")), F.lit(True)).alias("contained"))


def records(rows: DataFrame, bound: int) -> list:
    """The rows on the driver, at most ``bound`` of them: one more is an error, and no more than that one is fetched."""
    found = rows.limit(bound + 1).collect()
    if len(found) > bound:
        raise InvariantError(f"more than {bound} rows")
    return found


def require_empty(violations: DataFrame, rule: str, stage: str) -> None:
    """Raise with at most eight witnesses if the relation has a row."""
    seen = violations.limit(8).collect()
    if seen:
        raise InvariantError(f"{stage}: {rule}: {[r.asDict() for r in seen]}")


def violations(rules: dict[str, DataFrame]) -> DataFrame:
    """``rule`` and ``violations`` (a count) of each rule's relation, broken or not."""
    out = None
    for name, frame in rules.items():
        one = frame.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out
