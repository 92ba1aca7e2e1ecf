"""WARC archives: writing with payload deduplication, and a reader that salvages damaged files.

Every record is a gzip member of its own (or plain text, by choice).  The reader
checks each record as it goes: member CRC, version line, header syntax, declared
length, closing blank lines and payload digest.  After a failed check it searches
for the next member magic or version line that opens a valid record, goes on from
there, and logs the bytes between as a quarantined gap.

Defined results: a null html is an empty payload; a row
with a null page_id is written as a response without a number; an empty archive has no record
and no gap; repeated page_ids are separate records with the same id (rows tie-break
on url); a record whose header is broken is a gap, a record whose digest is wrong is
a gap too; whatever follows is still recovered.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from tessera.llm import memory

VERSION = b"WARC/1.1\r\n"
_OPEN = re.compile(rb"WARC/1\.[01]\r\n")
_MAGIC = b"\x1f\x8b\x08"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Record:
    kind: str
    page_id: int | None
    url: str
    payload: bytes
    digest: str
    length: int
    refers_to: int | None = None
    fields: dict[str, str] = field(default_factory=dict)


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, compress: bool = True, level: int = 3) -> bytes:
    """The bytes of one record; a revisit carries its payload's length and digest but not the payload."""
    body = b"" if refers_to is not None else payload
    lines = [
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_REVISIT}"]
    raw = VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    if not compress:
        return raw
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _parse(data: bytes, at: int) -> tuple[Record, int] | None:
    """The plain record at ``at`` and its end, or None if any check fails."""
    opened = _OPEN.match(data, at)
    if not opened:
        return None
    head = data.find(b"\r\n\r\n", opened.end() - 2)
    if head < 0:
        return None
    fields: dict[str, str] = {}
    for line in data[opened.end() : head].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    try:
        size = int(fields["content-length"])
        length = int(fields.get("x-payload-length", size))
        named = re.fullmatch(r"<urn:page:(-?\d+|none)>", fields["warc-record-id"])[1]
        page = None if named == "none" else int(named)
        refers = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("warc-refers-to", ""))
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        kind = fields["warc-type"]
    except (KeyError, ValueError, TypeError):
        return None
    begin, end = head + 4, head + 4 + size
    if size < 0 or data[end : end + 4] != b"\r\n\r\n":
        return None
    payload = bytes(data[begin:end])
    if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
        return None
    if kind == "revisit" and refers is None:
        return None
    return Record(kind, page, fields.get("warc-target-uri", ""), payload, digest, length, int(refers[1]) if refers else None, fields), end + 4


def read_archive(data: bytes) -> Iterator[Record | tuple[int, int]]:
    """Records in file order, and a ``(start, end)`` pair of file offsets for each quarantined gap."""
    at, gap = 0, None
    marks = {_MAGIC: -1, b"WARC/1.": -1}  # where each kind of opening comes next; found once, so salvage stays linear
    while at < len(data):
        found = None
        if data.startswith(_MAGIC, at):
            member = _member(data, at)
            if member:
                raw, end = member
                parsed = _parse(raw, 0)
                if parsed and parsed[1] == len(raw):
                    found = parsed[0], end
        elif data.startswith(b"WARC/", at):
            found = _parse(data, at)
        if found:
            if gap is not None:
                yield gap, at
                gap = None
            yield found[0]
            at = found[1]
            continue
        if gap is None:
            gap = at
        for mark, place in marks.items():
            if place <= at:
                found_at = data.find(mark, at + 1)
                marks[mark] = found_at if found_at > 0 else len(data)
        at = min(marks.values())
    if gap is not None:
        yield gap, len(data)


def _member(data: bytes, at: int, piece: int = 1 << 16) -> tuple[bytes, int] | None:
    """The gzip member at ``at``, inflated piece by piece, and its end; zlib checks its CRC and length."""
    z, out, pos, view = zlib.decompressobj(31), [], at, memoryview(data)
    try:
        while not z.eof and pos < len(data):
            out.append(z.decompress(view[pos : pos + piece]))
            pos += piece
    except zlib.error:
        return None
    return (b"".join(out), min(pos, len(data)) - len(z.unused_data)) if z.eof else None


# ---- distributed use -------------------------------------------------------

#: Payloads an archive file holds before the next one is begun.
FILE_BYTES = 32 << 20
RECORD_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def with_digests(pages):
    """``page_id``, ``url``, ``html`` with the payload's byte length and digest."""
    from pyspark.sql import functions as F

    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", "html", F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("sha1_hex"))


def mark_revisits(pages, least_bytes: int = 0):
    """Adds ``refers_to``: for each payload of at least ``least_bytes`` that an earlier page_id holds, that page_id.

    Digests are first reduced to their smallest page_id by a combining aggregate, so
    a payload that a third of all pages share costs one row a task; pages then join
    that table on the digest, skew being split by adaptive execution.
    """
    from pyspark.sql import functions as F

    rows = with_digests(pages)
    firsts = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1_hex", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").select("sha1_hex", "payload_bytes", "first_id")
    # only repeats come back, keyed by page, so that no text is dealt by a hot digest
    repeats = rows.select("page_id", "sha1_hex", "payload_bytes").join(firsts, ["sha1_hex", "payload_bytes"]).where("page_id > first_id").groupBy("page_id", "sha1_hex", "payload_bytes").agg(F.min("first_id").alias("refers_to"))
    return rows.join(repeats, ["page_id", "sha1_hex", "payload_bytes"], "left")


def write_archives(pages, folder: str, compress: bool = True, file_bytes: int = FILE_BYTES):
    """Write one archive after another in each partition; returns ``(path, records, bytes)`` of the files.

    File names come from the partition and file number; a repeated task replaces its own
    files by the same bytes through a rename.
    """
    from tessera.llm.store import write_file

    @memory.task("warc")
    def run(batches):
        from pyspark import TaskContext

        part, number, held, size, done = TaskContext.get().partitionId(), 0, [], 0, []

        def close():
            nonlocal number, held, size
            path = f"{folder}/part-{part:06d}-{number:05d}.warc{'.gz' * compress}"
            done.append((path, len(held), write_file(path, held)))
            number, held, size = number + 1, [], 0

        for batch in batches:
            ids, urls, htmls, refers = (batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "refers_to"))
            for i in range(batch.num_rows):
                payload = (htmls[i].as_py() or "").encode()
                held.append(encode_record(ids[i].as_py(), urls[i].as_py(), payload, payload_digest(payload), refers[i].as_py(), compress))
                size += len(held[-1])
                if size >= file_bytes:
                    close()
        if held:
            close()
        import pyarrow as pa

        if done:
            yield pa.RecordBatch.from_pydict({"path": [x[0] for x in done], "records": [x[1] for x in done], "bytes": [x[2] for x in done]})

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long, bytes long")


def read_archives(files, keep_payload: bool = True, gaps: bool = False):
    """Read every archive of ``files`` (a column ``path``): its records, or with ``gaps`` its quarantined byte ranges."""
    from tessera.llm.store import read_file

    @memory.task("warc")
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
                out: list = []
                for x in read_archive(read_file(path)):
                    if isinstance(x, tuple) and gaps:
                        out.append((path, *x))
                    elif isinstance(x, Record) and not gaps:
                        out.append((x.page_id, x.url, x.kind, x.length, x.digest, x.refers_to, x.payload if keep_payload else None))
                names = ["path", "gap_start", "gap_end"] if gaps else ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
                kinds = [pa.string(), pa.int64(), pa.int64()] if gaps else [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return files.select("path").mapInArrow(run, "path string, gap_start long, gap_end long" if gaps else RECORD_SCHEMA)
