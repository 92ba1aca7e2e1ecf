"""Content identity: hashes of rows and relations that tell null from empty and don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(value: Column, kind: T.DataType) -> Column:
    """A text for a value of any declared type: a null tag, or a type tag with length-framed content."""
    if isinstance(kind, T.StructType):
        body = F.concat(F.lit("("), *(canonical(value.getField(f.name), f.dataType) for f in kind.fields), F.lit(")"))
    elif isinstance(kind, T.ArrayType):
        body = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType)), ""), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.concat(canonical(e["key"], kind.keyType), canonical(e["value"], kind.valueType))))
        body = F.concat(F.lit("{"), F.array_join(entries, ""), F.lit("}"))
    else:
        text = F.base64(value) if isinstance(kind, T.BinaryType) else value.cast("string")
        body = F.concat(F.lit(kind.simpleString()[:1]), F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.when(value.isNull(), F.lit("~")).otherwise(body)


def row_fingerprint(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of a row's canonical text."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    return F.sha2(F.concat(*(canonical(F.col(f"`{f.name}`"), f.dataType) for f in fields)), 256)


def relation_digest(df: DataFrame) -> DataFrame:
    """One row: a digest of the set of rows, whatever their order, partitioning and repetition.

    Row hashes are added up in several independent parts, which combine before the
    shuffle; no list of all hashes is built.
    """
    rows = df.select(row_fingerprint(df).alias("h")).distinct()
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return rows.agg(F.sha2(F.concat_ws("/", F.count("*").cast("string"), *(F.coalesce(p, F.lit("")) for p in parts)), 256).alias("digest"), F.count("*").alias("rows"))
