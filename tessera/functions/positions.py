"""Places in texts, meanings of times, and page cursors, as column expressions."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an instant means; kept in a column's metadata.
CLOCKS = ("event", "acquisition", "observation", "submission", "update", "expiry")


def utf8_position_valid(text: Column, line: Column, byte: Column) -> Column:
    """Whether a text has that line (from 0) and that byte is at a character's start in it, or at its end."""
    raw = F.encode(F.get(F.split(text, "\n", -1), line), "utf-8")
    here = F.conv(F.hex(F.substring(raw, byte + 1, F.lit(1))), 16, 10).cast("int")
    inside = (byte >= 0) & (byte <= F.octet_length(raw)) & ((byte == F.octet_length(raw)) | (here < 128) | (here >= 192))
    return F.coalesce(inside, F.lit(False))


def clock(instant: Column, meaning: str, name: str) -> Column:
    """A time under ``name`` that says which clock it is of."""
    if meaning not in CLOCKS:
        raise ValueError(f"no clock is called {meaning}")
    return instant.cast("timestamp_ntz").alias(name, metadata={"clock": meaning})


def cursor(scope: str, digest: Column, key: Column) -> Column:
    """A token for the page after ``key`` (a text without quotes) of one query: its content in base 64, and a check sum."""
    body = F.concat(F.lit(f'{{"scope":"{scope}","query":"'), digest, F.lit('","key":"'), key, F.lit('"}'))
    return F.concat(F.base64(F.encode(body, "utf-8")), F.lit("."), F.sha2(F.encode(body, "utf-8"), 256))


def read_cursor(token: str, scope: str, digest: str) -> str:
    """The key in a token of ``cursor``; a token that was changed, or is of another scope or query, is an error."""
    try:
        packed, check = token.split(".")
        raw = base64.b64decode(packed, validate=True)
        body = json.loads(raw)
    except ValueError as error:
        raise ValueError("not a cursor") from error
    if hashlib.sha256(raw).hexdigest() != check or (body["scope"], body["query"]) != (scope, digest):
        raise ValueError("a cursor of another query")
    return body["key"]
