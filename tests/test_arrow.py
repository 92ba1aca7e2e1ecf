"""Arrow IPC files, and bounded records."""

import pyarrow as pa
import pytest

from tessera.operators.relational import InvariantError, records
from tessera.sources.arrow import read_ipc


def test_ipc_files_and_streams(spark, tmp_path):
    schema = pa.schema([("k", pa.int64()), ("v", pa.string()), ("l", pa.list_(pa.int32()))])
    parts = [pa.table({"k": [1, None], "v": ["a", None], "l": [[1, 2], None]}, schema), pa.table({"k": [3], "v": ["c"], "l": [[]]}, schema)]
    with pa.ipc.new_file(str(tmp_path / "a.arrow"), schema) as out:
        for p in parts:
            out.write_table(p)
    with pa.ipc.new_stream(str(tmp_path / "b.arrows"), schema) as out:
        out.write_table(parts[1])
    rows = sorted(map(tuple, read_ipc(spark, str(tmp_path)).collect()), key=str)
    assert rows == sorted([(1, "a", [1, 2]), (None, None, None), (3, "c", []), (3, "c", [])], key=str)
    with pa.ipc.new_file(str(tmp_path / "c.arrow"), pa.schema([("k", pa.string())])) as out:
        out.write_table(pa.table({"k": ["x"]}))
    with pytest.raises(Exception, match="a file has"):
        read_ipc(spark, str(tmp_path), schema).collect()


def test_records_are_bounded(spark):
    assert len(records(spark.range(3), 3)) == 3
    with pytest.raises(InvariantError):
        records(spark.range(4), 3)
