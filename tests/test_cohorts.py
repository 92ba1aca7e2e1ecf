import tempfile

import pytest
from pyspark.sql import types as T

from tessera.sources.cohorts import CohortTable, ConflictError, MissingVersionError, change_plan
from tessera.streaming.projection import apply_changes, project_stream

SCHEMA = T.StructType([T.StructField("key", T.LongType()), T.StructField("v", T.StringType())])


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


@pytest.fixture
def table(spark):
    return CohortTable(spark, f"file://{tempfile.mkdtemp()}/t", SCHEMA)


def test_versions_are_exact(spark, table):
    assert table.version() == 0 and table.read().count() == 0
    table.append(rows(spark, (1, "a")))
    table.append(rows(spark, (2, None)))
    assert table.read(1).count() == 1 and table.read().count() == 2
    with pytest.raises(MissingVersionError):
        table.read(9)


def test_second_writer_conflicts(spark, table):
    table.append(rows(spark, (1, "a")))
    table.append(rows(spark, (2, "b")), base=1)
    with pytest.raises(ConflictError):
        table.append(rows(spark, (3, "c")), base=1)


def test_schema_is_checked(spark, table):
    with pytest.raises(ValueError):
        table.append(spark.range(1))


def test_compact_and_vacuum_keep_what_is_named(spark, table):
    for i in range(3):
        table.append(rows(spark, (i, "x")))
    table.compact()
    assert table.read().count() == 3
    table.vacuum([2])
    assert table.read(2).count() == 2 and table.read().count() == 3


def test_changes(spark, table):
    table.append(rows(spark, (1, "a"), (2, "b"), (3, None)))
    first = table.manifest(1)
    table.append(rows(spark, (1, "a"), (2, "c"), (3, ""), (4, "d")), replace=first)
    assert {tuple(r) for r in table.changes(1, 2, ["key"]).collect()} == {(2, "update"), (3, "update"), (4, "insert")}
    assert change_plan(table.read(2), table.read(2), ["key"]).count() == 0


def test_stream_equals_batch(spark, table):
    folder = tempfile.mkdtemp()
    schema = "key long, v string, seq long, deleted boolean"
    batches = [[(1, "a", 1, False), (2, "b", 2, False), (1, "A", 3, False)], [(2, None, 4, True), (3, "c", 5, False)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        project_stream(stream, table, ["key"], "seq", lambda d: d, f"{folder}/ck").awaitTermination()
    assert {tuple(r) for r in table.read().collect()} == {(1, "A"), (3, "c")}
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    assert {tuple(r) for r in apply_changes(rows(spark).limit(0), whole, ["key"], "seq").collect()} == {(1, "A"), (3, "c")}


def test_a_vacuumed_version_is_missing(spark, table):
    table.append(rows(spark, (1, "a")))
    table.append(rows(spark, (2, "b")), replace=table.manifest(1))
    table.vacuum([])
    assert table.read().count() == 1
    with pytest.raises(MissingVersionError):
        table.read(1)


def test_repeated_keys_have_one_line_in_a_change_plan(spark):
    old = rows(spark, (1, "a"), (1, "a"), (2, "b"), (2, "c"), (None, "x"))
    new = rows(spark, (1, "a"), (2, "c"), (2, "b"), (3, None), (3, None))
    assert sorted(map(tuple, change_plan(old, new, ["key"]).collect()), key=str) == [(1, "update"), (3, "insert"), (None, "delete")]


def test_other_versions_between_batches_lose_none(spark, table):
    folder = tempfile.mkdtemp()
    schema = "key long, v string, seq long, deleted boolean"
    for i in range(1, 4):
        spark.createDataFrame([(i, "x", i, False)], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        project_stream(stream, table, ["key"], "seq", lambda d: d, f"{folder}/ck").awaitTermination()
        if i == 1:
            table.compact()
            table.compact()
    assert {r["key"] for r in table.read().collect()} == {1, 2, 3} and table.batch(table.version()) == 2
