"""Arrow IPC files as a table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema

from tessera.sources.workers import reach_workers


def _open(content: bytes):
    """A reader of an IPC file or stream."""
    buffer = pa.py_buffer(content)
    try:
        return pa.ipc.open_file(buffer)
    except pa.ArrowInvalid:
        return pa.ipc.open_stream(buffer)


def _batches(reader):
    if isinstance(reader, pa.ipc.RecordBatchFileReader):
        return (reader.get_batch(i) for i in range(reader.num_record_batches))
    return iter(reader)


def read_ipc(spark: SparkSession, path: str, schema: pa.Schema | None = None) -> DataFrame:
    """All rows of the IPC files or streams under ``path`` (a folder or a pattern, in any store that Spark reads).

    Executors read the files, one whole file at a time.  Without ``schema`` it is that of the first file by name; a file of
    another schema is an error, no file is an empty table only where ``schema`` is given.
    """
    reach_workers(spark)
    files = spark.read.format("binaryFile").load(path)
    if schema is None:
        first = files.orderBy("path").select("content").first()
        if first is None:
            raise FileNotFoundError(path)
        schema = _open(first["content"]).schema

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                reader = _open(content.as_buffer().to_pybytes())
                if not reader.schema.equals(schema):
                    raise ValueError(f"a file has {reader.schema}, not {schema}")
                yield from _batches(reader)

    return files.select("content").mapInArrow(run, from_arrow_schema(schema))
