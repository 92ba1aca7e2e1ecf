"""Python version and manifest functions.  These grammars need a parser, so they are Arrow-batched functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types are objects, not DDL texts, which only a running session could parse at import.
_TEXTS = T.ArrayType(T.StringType())


def _record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])



@F.pandas_udf(_record(release=T.ArrayType(T.LongType()), prerelease=T.BooleanType(), sort_key=T.StringType()))
def pep440_value(version: pd.Series) -> pd.DataFrame:
    """Release numbers, whether it is a pre-release, and a text that sorts by precedence; nulls for what is no version."""
    from packaging.version import InvalidVersion, Version

    def phase(part, missing: str) -> str:
        return missing if part is None else f"{part[0]}{part[1]:020d}"

    rows = []
    for text in version:
        try:
            v = Version(text) if text is not None else None
        except InvalidVersion:
            v = None
        if v is None:
            rows.append((None, None, None))
            continue
        release = list(v.release)
        while len(release) > 1 and release[-1] == 0:
            release.pop()
        pre = "!" if v.pre is None and v.post is None and v.dev is not None else phase(v.pre, "~")
        post = "!" if v.post is None else f"p{v.post:020d}"
        dev = "~" if v.dev is None else f"d{v.dev:020d}"
        local = "" if v.local is None else ".".join(f"1{int(x):020d}" if x.isdigit() else f"0{x}" for x in v.local.split("."))
        rows.append((list(v.release), v.is_prerelease, "|".join([f"{v.epoch:010d}", ".".join(f"{n:020d}" for n in release) + "!", pre, post, dev, local])))
    return pd.DataFrame(rows, columns=["release", "prerelease", "sort_key"])


@F.pandas_udf(T.BooleanType())
def pep440_matches(specifier: pd.Series, version: pd.Series) -> pd.Series:
    """Whether a version, pre-releases included, meets a specifier; an invalid specifier or version is an error."""
    from packaging.specifiers import SpecifierSet

    return pd.Series([None if s is None or v is None else SpecifierSet(s).contains(v, prereleases=True) for s, v in zip(specifier, version, strict=True)])


@F.pandas_udf(T.ArrayType(_record(path=_TEXTS, kind=T.StringType(), text=T.StringType())))
def toml_entries(text: pd.Series) -> pd.Series:
    """Every leaf of a TOML text with its path; null for a text that doesn't parse."""
    import tomllib

    def walk(value, path):
        if isinstance(value, dict):
            for k, v in value.items():
                yield from walk(v, [*path, k])
        elif isinstance(value, list):
            for i, v in enumerate(value):
                yield from walk(v, [*path, str(i)])
        else:
            yield {"path": path, "kind": type(value).__name__, "text": str(value)}

    def entries(t):
        try:
            return None if t is None else list(walk(tomllib.loads(t), []))
        except tomllib.TOMLDecodeError:
            return None

    return text.map(entries)


@F.pandas_udf(T.ArrayType(_record(name=T.StringType(), value=T.StringType())))
def metadata_headers(text: pd.Series) -> pd.Series:
    """Header fields of a package metadata text, in order."""
    from email.parser import HeaderParser

    return text.map(lambda t: None if t is None else [{"name": k, "value": v} for k, v in HeaderParser().parsestr(t).items()])


@F.pandas_udf(T.ArrayType(_record(bytes=T.LongType(), json_bytes=T.LongType())))
def prefix_boundaries(text: pd.Series) -> pd.Series:
    """Byte length of every whole-character prefix, alone and as a JSON string."""
    import json

    def cuts(t):
        if t is None:
            return None
        out, plain, coded = [], 0, 2
        for c in t:
            plain += len(c.encode())
            coded += len(json.dumps(c, ensure_ascii=False).encode()) - 2
            out.append({"bytes": plain, "json_bytes": coded})
        return out

    return text.map(cuts)


@F.pandas_udf(T.LongType())
def utf16_to_utf8(line: pd.Series, column: pd.Series) -> pd.Series:
    """Byte offset of a UTF-16 column in a line; null if it lies within a character or beyond the end."""

    def convert(t, at):
        if t is None or at is None or pd.isna(at):
            return None
        units = plain = 0
        for c in t:
            if units >= at:
                break
            units += 1 + (ord(c) > 0xFFFF)
            plain += len(c.encode())
        return plain if units == at else None

    return pd.Series([convert(t, a) for t, a in zip(line, column, strict=True)], dtype="Int64")
