"""Shared storage of a job: the folder that every executor and the driver can reach."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.workers import checkpoint_dir, fresh_path, materialise, reach_workers


__all__ = ["discard", "filesystem", "fresh_path", "local_path", "materialise", "reach_workers", "read_file", "shared_dir", "write_file"]


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; unset, it is a new folder on one machine and an error on a cluster."""
    return checkpoint_dir(spark)


def discard(*written: DataFrame) -> None:
    """Remove tables of ``materialise`` that no later step reads, and let finished steps' shuffle files go.

    Spark drops shuffle files once the driver's garbage collector has found their handles.
    """
    import gc

    gc.collect()
    for df in written:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.sparkContext._jvm.System.gc()


def local_path(uri: str) -> str | None:
    """The path of a ``file:`` URI or plain path; None for another store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri and os.path.isabs(uri) else None


def filesystem(uri: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks) -> int:
    """Write byte chunks to a temporary name beside ``uri``, then rename, so that a lost task leaves no half file."""
    files, path = filesystem(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temp, size = f"{path}.{uuid.uuid4().hex}.part", 0
    with files.open_output_stream(temp) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    files.move(temp, path)
    return size


def read_file(uri: str) -> bytes:
    files, path = filesystem(uri)
    with files.open_input_stream(path, compression=None) as f:
        return f.read()
