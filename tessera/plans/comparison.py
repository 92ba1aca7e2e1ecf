"""Two snapshots compared along several axes, down to the paths of the fields that differ."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def leaves(schema: T.StructType, under: str = "") -> list[str]:
    """Paths of all fields that are no structs, in order."""
    out: list[str] = []
    for f in schema.fields:
        path = f"{under}.{f.name}" if under else f.name
        out += leaves(f.dataType, path) if isinstance(f.dataType, T.StructType) else [path]
    return out


def axis(rows: DataFrame, name: str, key: str, label: str) -> DataFrame:
    """``rows`` as (axis, key, label, fields): a map from a field's path to its value as text; null stays null.  Maps and lists are compared as JSON."""
    paths = [p for p in leaves(rows.schema) if p not in (key, label)]
    kind = {p: functools.reduce(lambda t, part: t[part].dataType, p.split("."), rows.schema) for p in paths}
    text = [F.to_json(p) if isinstance(kind[p], (T.ArrayType, T.MapType)) else F.col(p).cast("string") for p in paths]
    entries = F.map_from_arrays(F.array(*map(F.lit, paths)), F.array(*text))
    return rows.select(F.lit(name).alias("axis"), F.col(key).cast("string").alias("key"), F.col(label).cast("string").alias("label"), entries.alias("fields"))


def compare(before: list[DataFrame], after: list[DataFrame]) -> DataFrame:
    """Keys that differ on an axis: axis, key, label (the lesser of both sides'), change (added, removed, changed) and the changed paths in order.

    A key stands once a side on an axis.  One full join serves all axes.
    """
    union = functools.partial(functools.reduce, DataFrame.unionByName)
    a = union(before).withColumnsRenamed({"label": "old_label", "fields": "old"})
    b = union(after).withColumnsRenamed({"label": "new_label", "fields": "new"})
    both = a.join(b, ["axis", "key"], "full")
    paths = F.array_sort(F.filter(F.map_keys("old"), lambda p: ~F.col("old")[p].eqNullSafe(F.col("new")[p])))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    out = both.select("axis", "key", F.least("old_label", "new_label").alias("label"), change.alias("change"), F.when(change == "changed", paths).otherwise(F.array().cast("array<string>")).alias("paths"), (F.coalesce("old_label", F.lit("")) != F.coalesce("new_label", F.lit(""))).alias("relabelled"))
    return out.where("change <> 'changed' OR relabelled OR size(paths) > 0").drop("relabelled")


def setting_state(old: Column, new: Column) -> Column:
    """How a set-like setting differs: order is no difference, and unknown (null) is not empty."""
    return (
        F.when(old.isNull() & new.isNull(), "unknown")
        .when(old.isNull() | new.isNull(), "one_unknown")
        .when(F.array_sort(F.array_distinct(old)) == F.array_sort(F.array_distinct(new)), "same")
        .otherwise("differs")
    )
