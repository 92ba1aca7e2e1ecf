"""Places, cursors, wheel tags and edges with several ends."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import positions
from tessera.operators.relational import touching
from tessera.plans.selection import wheel_fits


def test_utf8_positions(spark):
    text = "aé\nß€x\n"
    rows = [(text, line, byte) for line in range(-1, 4) for byte in range(-1, 8)] + [(None, 0, 0)]
    got = spark.createDataFrame(rows, "t string, l int, b int").select("*", positions.utf8_position_valid(F.col("t"), F.col("l"), F.col("b")).alias("v")).collect()
    for r in got:
        lines = (r["t"] or "").split("\n") if r["t"] is not None else []
        ends = [len(lines[r["l"]][:k].encode()) for k in range(len(lines[r["l"]]) + 1)] if 0 <= r["l"] < len(lines) else []
        assert r["v"] == (r["b"] in ends), r


def test_cursors_are_checked(spark):
    token = spark.range(1).select(positions.cursor("docs", F.lit("d1"), F.lit("17"))).first()[0]
    assert positions.read_cursor(token, "docs", "d1") == "17"
    for bad, scope, digest in ((token, "docs", "d2"), (token, "other", "d1"), ("x" + token, "docs", "d1"), ("nothing", "docs", "d1")):
        with pytest.raises(ValueError):
            positions.read_cursor(bad, scope, digest)


def test_edges_stay_as_often_as_they_stand(spark):
    edges = spark.createDataFrame([(1, 5, 6), (1, 5, 6), (2, 6, 5), (3, 7, 7), (4, None, 5), (5, 8, None)], "id long, a long, b long")
    chosen = spark.createDataFrame([(5,), (5,), (7,)], "k long")
    assert sorted(r["id"] for r in touching(edges, ["a", "b"], chosen, "k").collect()) == [1, 1, 2, 3, 4]


@pytest.mark.parametrize(
    "name, python, target, fits",
    [
        ("a-1-py3-none-any.whl", (3, 11), None, True),
        ("a-1-py2.py3-none-any.whl", (3, 11), "linux_x86_64", True),
        ("a-1-py2-none-any.whl", (3, 11), None, False),
        ("a-1-py3-none-any.whl", (None, None), None, True),
        ("a-1-py311-none-any.whl", (3, 11), None, True),
        ("a-1-cp311-cp311-linux_x86_64.whl", (3, 11), "linux_x86_64", True),
        ("a-1-cp311-cp311-linux_x86_64.whl", (3, 11), "win_amd64", False),
        ("a-1-cp39-abi3-linux_x86_64.whl", (3, 11), "linux_x86_64", True),
        ("a-1-cp312-abi3-linux_x86_64.whl", (3, 11), "linux_x86_64", False),
        ("a-1-1-cp311-none-linux_x86_64.whl", (3, 11), "linux_x86_64", True),
        ("a-1-cp311-cp311-linux_x86_64.whl", (3, 11), None, False),
        ("a-1.tar.gz", (3, 11), None, False),
    ],
)
def test_wheel_tags(spark, name, python, target, fits):
    row = spark.createDataFrame([(name, *python, target)], "n string, a int, b int, t string")
    assert bool(row.select(wheel_fits(F.col("n"), F.col("a"), F.col("b"), F.col("t"))).first()[0]) == fits
