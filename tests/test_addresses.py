"""IPv6 hosts and resolved addresses against the standard library."""

import ipaddress

from pyspark.sql import functions as F

from tessera.functions.text import ipv6_groups, url_parts
from tessera.plans.policy import refusal


def test_ipv6_groups(spark):
    good = ["::", "::1", "1::", "2001:db8::8a2e:370:7334", "1:2:3:4:5:6:7:8", "FE80::1", "::ffff:10.0.0.1", "1:2:3:4:5:6:7.8.9.10", "1:2::5:6:7.8.9.10"]
    bad = ["", "1", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", "g::", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8::", "::1.2.3.256", "1.2.3.4"]
    got = {r["a"]: r["g"] for r in spark.createDataFrame([(x,) for x in good + bad], "a string").select("a", F.array_join(ipv6_groups(F.col("a")), ":").alias("g")).collect()}
    for x in good:
        assert got[x].replace(":", "") == ipaddress.IPv6Address(x).packed.hex(), x
    assert all(got[x] is None for x in bad), got


def test_refusals_of_addresses(spark):
    rows = [
        ("https://[::1]/", None, "private_address"),
        ("https://[fd00::7]:8443/x", None, "private_address"),
        ("https://[2606:4700::1111]/", None, None),
        ("https://[::ffff:127.0.0.1]/", None, "private_address"),
        ("https://[::ffff:8.8.8.8]/", None, None),
        ("https://[1:2]/", None, "invalid_url"),
        ("https://example.com/", "https://10.0.0.9/", "private_address"),
        ("https://example.com/", "https://[fe80::1]/", "private_address"),
        ("https://example.com/", "https://93.184.216.34/", None),
    ]
    df = spark.createDataFrame(rows, "u string, r string, want string")
    got = df.select("u", "r", "want", refusal(url_parts(F.col("u")), F.lit(0), 5, F.lit(False), url_parts(F.col("r"))).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
