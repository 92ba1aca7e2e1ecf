"""Text expressions: search terms, versions, URLs, lexical paths.  Columns in, columns out; nothing leaves the JVM."""

from __future__ import annotations

import regex as re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TERMS = 64


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query in order: lower case, split at what is no letter, digit or underscore, two bytes at least."""
    words = re.sub(r"[^\p{Alphabetic}\p{N}_]+", " ", query.strip().lower()).split(" ")
    terms = list(dict.fromkeys(w for w in words if len(w.encode()) >= 2))
    if len(terms) > MAX_TERMS:
        raise ValueError(f"{len(terms)} search terms; {MAX_TERMS} are allowed")
    return terms


def terms(text: Column) -> Column:
    """The same of a column: array of distinct terms."""
    words = F.split(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{IsAlphabetic}\p{N}_]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: F.octet_length(w) >= 2))


def contains_any(text: Column, wanted: list[str]) -> Column:
    """Never null: whether a lower-case text holds any of the terms."""
    found = F.lit(False)
    for term in wanted:
        found = found | F.contains(text, F.lit(term))
    return F.coalesce(found, F.lit(False))


def count_terms(text: Column, wanted: list[str]) -> Column:
    total = F.lit(0)
    for term in wanted:
        total = total + F.coalesce(F.contains(text, F.lit(term)), F.lit(False)).cast("int")
    return total


def path_prefix(components: Column, prefix: list[str]) -> Column:
    """Whether a path begins with these components (not: these characters)."""
    return F.slice(components, 1, len(prefix)) == F.array(*map(F.lit, prefix))


def path_suffix(components: Column, suffix: list[str]) -> Column:
    n = len(suffix)
    return (F.size(components) >= n) & (F.slice(components, F.greatest(F.size(components) - n + 1, F.lit(1)), n) == F.array(*map(F.lit, suffix)))


_SEMVER = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-((?:0|[1-9]\d*|\d*[a-zA-Z-][0-9a-zA-Z-]*)(?:\.(?:0|[1-9]\d*|\d*[a-zA-Z-][0-9a-zA-Z-]*))*))?(?:\+[0-9a-zA-Z-]+(?:\.[0-9a-zA-Z-]+)*)?$"


def semver_key(version: Column) -> Column:
    """A text that sorts as SemVer precedence does; null for what is no version.

    Numbers are led by their length, so they sort by size.  A release sorts after its
    pre-releases; numeric identifiers before names; a longer list after its beginning.
    """

    def number(x: Column) -> Column:
        return F.concat(F.lpad(F.length(x).cast("string"), 3, "0"), x)

    parts = [F.regexp_extract(version, _SEMVER, i) for i in (1, 2, 3, 4)]
    names = F.transform(F.split(parts[3], r"\."), lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("0"), number(x))).otherwise(F.concat(F.lit("1"), x)))
    tail = F.when(parts[3] == "", F.lit("~")).otherwise(F.concat(F.lit("!"), F.array_join(names, "\u0001"), F.lit("\u0000")))
    return F.when(version.rlike(_SEMVER), F.concat(*(number(p) for p in parts[:3]), tail))


def is_prerelease(version: Column) -> Column:
    return F.when(version.rlike(_SEMVER), F.regexp_extract(version, _SEMVER, 4) != "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated, and stands in the plan, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ipv6_groups(address: Column) -> Column:
    """The eight groups of an IPv6 address in lower case, four hexadecimal digits each; null for what is none.  The last two may be written as an IPv4 address."""
    byte = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    quad = rf"^(.*:){byte}\.{byte}\.{byte}\.{byte}$"
    none = F.array().cast("array<string>")

    def spelled(text: Column) -> Column:
        part = lambda i: F.regexp_extract(text, quad, i)
        two = lambda i: F.lower(F.lpad(F.hex(part(i).cast("int") * 256 + part(i + 1).cast("int")), 4, "0"))
        return F.when(text.rlike(quad), F.concat(part(1), two(2), F.lit(":"), two(4))).otherwise(F.lower(text))

    def side(text: Column) -> Column:
        return F.when(text == "", none).otherwise(F.split(text, ":", -1))

    def filled(x: Column) -> Column:
        lacking = 8 - F.size(x["left"]) - F.size(x["right"])
        return F.when(x["n"] == 1, x["left"]).when((x["n"] == 2) & (lacking >= 1), F.concat(x["left"], F.array_repeat(F.lit("0"), F.greatest(lacking, F.lit(0))), x["right"]))

    def checked(groups: Column) -> Column:
        return F.when((F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.transform(groups, lambda g: F.lpad(g, 4, "0")))

    sides = let(spelled(address), lambda t: F.split(t, "::", -1))
    halves = let(sides, lambda s: F.struct(F.size(s).alias("n"), side(F.get(s, F.lit(0))).alias("left"), side(F.get(s, F.lit(1))).alias("right")))
    return let(let(halves, filled), checked)


def url_parts(url: Column) -> Column:
    """scheme, host, authority, ipv4 (as a number), ipv6 (32 hexadecimal digits) and has_credentials; null fields where the URL lacks them.

    An IPv6 host stands in brackets; one that stands for an IPv4 address has that as its ipv4 instead.
    """
    pattern = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[0-9a-fA-F:.]*\]|[^/?#:@\[\]]*)(?::(\d+))?(?:[/?#].*)?$"
    byte = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    part = lambda i: F.nullif(F.regexp_extract(url, pattern, i), F.lit(""))

    def read(x: Column) -> Column:
        host, digits = x["host"], x["digits"]
        mapped = F.coalesce(F.startswith(digits, F.lit("0" * 20 + "ffff")), F.lit(False))
        octets = F.aggregate(F.split(host, r"\."), F.lit(0).cast("long"), lambda a, o: a * 256 + o.cast("long"))
        ipv4 = F.when(host.rlike(rf"^{byte}(?:\.{byte}){{3}}$"), octets).when(mapped, F.conv(F.substring(digits, 25, 8), 16, 10).cast("long"))
        fields = (x["scheme"].alias("scheme"), host.alias("host"), F.concat_ws(":", host, x["port"]).alias("authority"), ipv4.alias("ipv4"), F.when(~mapped, digits).alias("ipv6"), x["user"].isNotNull().alias("has_credentials"))
        return F.when(x["fits"] & (~F.coalesce(F.startswith(host, F.lit("[")), F.lit(False)) | digits.isNotNull()), F.struct(*fields))

    host = F.lower(part(3))
    digits = F.when(F.startswith(host, F.lit("[")), F.array_join(ipv6_groups(F.substring(host, F.lit(2), F.length(host) - 2)), ""))
    return let(F.struct(url.rlike(pattern).alias("fits"), F.lower(part(1)).alias("scheme"), part(2).alias("user"), host.alias("host"), part(4).alias("port"), digits.alias("digits")), read)
