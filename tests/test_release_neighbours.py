"""Requests for versions that a large package lacks meet only the releases around them."""

import re

from tessera.plans.selection import select_releases


def most_rows(spark, since: int) -> int:
    """The largest count that any operator of the executions from ``since`` on reported."""
    store = spark._jsparkSession.sharedState().statusStore()
    most = 0
    for i in range(since, store.executionsCount()):
        values = store.executionMetrics(store.executionsList().apply(i).executionId()).values().iterator()
        while values.hasNext():
            text = values.next()
            if re.fullmatch(r"[\d,]+", text):
                most = max(most, int(text.replace(",", "")))
    return most


def test_large_package(spark):
    releases = [("p", f"{i}.0.0", False, i) for i in range(0, 800, 2)] + [("p", "6.0.0", True, 9000), ("q", "1.0.0", False, 9001), ("r", "bad", False, 9002)]
    asked = [(i, "p", f"{i % 801}.0.0", False, False) for i in range(1, 1600, 2)] + [(5000, "q", "0.1.0", False, False), (5001, "q", "2.0.0", False, False), (5002, "r", "1.0.0", False, False), (5003, "p", "6.0.0", False, False), (5004, "p", None, False, False)]
    rows = spark.createDataFrame(releases, "package string, vers string, yanked boolean, source_line int")
    requests = spark.createDataFrame(asked, "request_id int, package string, requested string, allow_prerelease boolean, allow_yanked boolean")
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = {r["request_id"]: (r["status"], r["version"], r["neighbours"]) for r in select_releases(requests, rows).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert len(got) == len(asked)
    order = sorted((int(v.split(".")[0]), line, v) for p, v, _, line in releases if p == "p")
    for i, _, requested, *_ in asked[:800]:
        key = int(requested.split(".")[0])
        if key % 2 == 0 and key < 800:
            assert got[i] == ("yanked", None, None) if key == 6 else ("selected", requested, None)
        else:
            near = [x for x in order if x[0] < key][-3:] + [x for x in order if x[0] >= key][:3]
            assert got[i] == ("not_found", None, [x[2] for x in near][:5]), requested
    assert got[5000] == ("not_found", None, ["1.0.0"]) and got[5001] == ("not_found", None, ["1.0.0"])
    assert got[5002] == ("not_found", None, None) and got[5003] == ("yanked", None, None) and got[5004][:2] == ("selected", "798.0.0")
    assert 800 <= most_rows(spark, since) < 20_000  # not each request with each release
