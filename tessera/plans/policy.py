"""Decision tables over URLs and stored responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import let

#: IPv4 ranges (as numbers, both ends included) that are not public.
PRIVATE_IPV4 = (
    (0, 16777215),
    (167772160, 184549375),
    (1681915904, 1686110207),
    (2130706432, 2147483647),
    (2851995648, 2852061183),
    (2886729728, 2887778303),
    (3221225984, 3221226239),
    (3232235520, 3232301055),
    (3323068416, 3323199487),
    (3325256704, 3325256959),
    (3405803776, 3405804031),
    (3758096384, 4294967295),
)


#: Fixed value: IPv6 addresses (32 digits) that are not public.
PRIVATE_IPV6 = "^(0000000000000000000000000000000[01]$|ff|f[cd]|fe[89ab])"


def refusal(parts: Column, hop: Column, most_hops: int, trusted: Column, resolved: Column | None = None) -> Column:
    """Why a request is refused, the first reason that holds; null if it is allowed.

    ``parts`` is ``url_parts`` of the URL, ``resolved`` that of the address it was resolved to, if there is one.
    """

    def decide(x: Column) -> Column:
        own, address = x["own"], x["address"]
        host, ip = own["host"], address["ipv4"]
        private = (host == "localhost") | F.endswith(host, F.lit(".localhost"))
        for low, high in PRIVATE_IPV4:
            private = private | F.coalesce(ip.between(low, high), F.lit(False))
        private = private | F.coalesce(address["ipv6"].rlike(PRIVATE_IPV6), F.lit(False))
        return (
            F.when(hop > most_hops, "redirect_limit")
            .when(own.isNull(), "invalid_url")
            .when((own["scheme"] != "https") & ~((own["scheme"] == "http") & trusted), "scheme")
            .when(host.isNull(), "host_missing")
            .when(~trusted & private, "private_address")
        )

    return let(F.struct(parts.alias("own"), (parts if resolved is None else F.coalesce(resolved, parts)).alias("address")), decide)


def reuse(status: Column, age_seconds: Column, negative_ttl: int, forced: Column) -> Column:
    """Whether a stored response answers without asking again: only a fresh negative one, unless forced."""
    return status.isin(404, 410) & (age_seconds < negative_ttl) & ~forced


def validator(status: Column, etag: Column, last_modified: Column) -> Column:
    """The conditional header to send with a stored response, as ``name`` and ``value``."""
    return F.when((status == 200) & etag.isNotNull(), F.struct(F.lit("if-none-match").alias("name"), etag.alias("value"))).when((status == 200) & last_modified.isNotNull(), F.struct(F.lit("if-modified-since").alias("name"), last_modified.alias("value")))
