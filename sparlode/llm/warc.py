"""Operator 7, WARC archives with revisit resolution.

``read_index`` gives one narrow row of headers for each record of the archives, without its payload. ``resolve`` shuffles those
headers by payload digest: the first response of a digest is the original, and later responses as well as revisit records are
joined to it. ``deduplicate`` then writes new archives with fresh headers: originals with their payload, all others as revisit
records that refer to the record of the original. Each record is a gzip member of its own, so that it can be read at its
offset. Payloads are never shuffled: the writer of an archive reads them from the old one, record by record. The first record
of a digest is found by partial minima, so a payload that millions share makes no large task.

Payloads are compared by their own SHA-256, however a record spells its digest; a revisit's stated digest is looked up among
the SHA-256, the SHA-1 and the stated digests of all payloads. Records keep the id that they state, so that requests and
metadata still refer to something; those without one get an id made from the archive's path below the source and the offset.

Files are written under a name of the attempt and then renamed, and what they hold depends on written tables only; a task that
is run again writes the same bytes. Paths may be local or any URI that pyarrow.fs opens.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, drop_path, need, new_path, save, slices

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELDS = [
    ("record_id", "string"), ("kind", "string"), ("uri", "string"), ("date", "string"), ("payload_digest", "string"), ("payload_length", "long"),
    ("refers_to", "string"), ("refers_to_uri", "string"), ("refers_to_date", "string"), ("archive", "string"), ("offset", "long"), ("length", "long"),
]
#: What the index of old archives has besides: the payload's SHA-256 (of a revisit: the stated digest, in one spelling), and its other digests.
_KEYS = [("content", "string"), ("sha1", "string"), ("stated", "string")]
INDEX = ", ".join(f"{n} {t}" for n, t in _FIELDS)
DAMAGED = "damaged"
#: Headers that a new record states itself; all others are carried over.
_OWN = {"content-length", "content-type", *(f"warc-{x}" for x in ("type", "record-id", "date", "target-uri", "payload-digest", "block-digest", "profile", "refers-to", "refers-to-target-uri", "refers-to-date"))}
_CHUNK = 1 << 20


def digest(payload: bytes, like: str | None = None) -> str:
    """The labelled digest, in the algorithm and spelling of ``like`` if that is a known one, else SHA-256 in hexadecimal digits."""
    label, _, value = (like or "").partition(":")
    if label.lower() in ("sha1", "sha-1", "sha256", "sha-256", "md5"):
        h = hashlib.new(label.lower().replace("-", ""), payload)
        return f"{label}:" + (h.hexdigest() if len(value) == 2 * h.digest_size else base64.b32encode(h.digest()).decode())
    return "sha256:" + hashlib.sha256(payload).hexdigest()


def spelled(stated: str | None) -> str | None:
    """A stated digest in one spelling: algorithm and value in lower case, hexadecimal; one of an unknown kind as it is."""
    label, _, value = (stated or "").partition(":")
    name = label.strip().lower().replace("-", "")
    value = value.strip()
    size = {"md5": 16, "sha1": 20, "sha256": 32}.get(name)
    if size is None:
        return stated or None
    if len(value) != 2 * size:
        try:
            value = base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
        except ValueError:
            return stated
    return f"{name}:{value.lower()}"


def record_id(*parts) -> str:
    return "<urn:uuid:" + str(uuid.UUID(bytes=hashlib.sha1(repr(parts).encode("utf-8", "surrogatepass")).digest()[:16], version=5)) + ">"


def build(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member; headers that are None are left out, and line breaks in values become spaces."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in headers if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n", 6, mtime=0)


def response(rid: str, uri, date, payload_digest: str, block: bytes, kind: str = "response", content_type: str = "application/http;msgtype=response", more=()) -> bytes:
    """more: further headers, as (name, value)."""
    return build(
        [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", payload_digest),
         ("WARC-Block-Digest", digest(block)), *more, ("Content-Type", content_type)], block)


def revisit(rid: str, uri, date, payload_digest, refers: tuple, block: bytes, more=()) -> bytes:
    """refers: record id, URI and date of the record that has the payload."""
    return build(
        [("WARC-Type", "revisit"), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", payload_digest),
         ("WARC-Block-Digest", digest(block)), ("WARC-Profile", PROFILE), ("WARC-Refers-To", refers[0]), ("WARC-Refers-To-Target-URI", refers[1]),
         ("WARC-Refers-To-Date", refers[2]), *more, ("Content-Type", "application/http;msgtype=response")], block)


_start = re.compile(rb"\x1f\x8b\x08|(?<=\n)WARC/\d")


class _Stream:
    """The bytes of an archive from the record at ``at`` on, as far as they have been read."""

    def __init__(self, stream):
        self.stream, self.held, self.at, self.ended = stream, bytearray(), 0, False

    def more(self) -> bool:
        b = b"" if self.ended else self.stream.read(_CHUNK)
        self.ended = not b
        self.held += b
        return bool(b)

    def member(self) -> tuple[int, bytes] | None:
        """(length, content) of the gzip member or plain record that is next; None if it is cut off or damaged."""
        if self.held[:1] == b"\x1f":
            d, parts, size = zlib.decompressobj(31), [], 0
            while not d.eof:
                if size == len(self.held) and not self.more():
                    return None
                piece = bytes(self.held[size : size + _CHUNK])
                try:
                    parts.append(d.decompress(piece))
                except zlib.error:
                    return None
                size += len(piece) - len(d.unused_data)
            content = b"".join(parts)
            return (size, content) if content[:5] == b"WARC/" else None
        while len(self.held) < 5 and self.more():
            pass
        if self.held[:5] != b"WARC/":
            return None
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not self.more():
                return None
        told = [x.split(b":", 1)[1].strip() for x in bytes(self.held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:")]
        if not told or not told[0].isdigit():
            return None
        size = end + 8 + int(told[0])
        while len(self.held) < size and self.more():
            pass
        content = bytes(self.held[:size])
        return (size, content) if content[size - 4 :] == b"\r\n\r\n" else None

    def lost(self) -> int:
        """Bytes to the next place where a record may begin, or to the end."""
        look = 1
        while True:
            m = _start.search(self.held, look)
            if m:
                return m.start()
            look = max(look, len(self.held) - 6)
            if not self.more():
                return len(self.held)

    def skip(self, size: int) -> None:
        del self.held[:size]
        self.at += size


def members(stream):
    """(offset, length, content) for each record of an open archive, compressed or not. What is cut off or damaged, up to the next
    record that can be read, is one of content None."""
    s, bad = _Stream(stream), None
    while s.held or s.more():
        found = s.member()
        if found:
            if bad is not None:
                yield bad, s.at - bad, None
                bad = None
            yield s.at, *found
        else:
            bad = s.at if bad is None else bad
        s.skip(found[0] if found else s.lost())
    if bad is not None:
        yield bad, s.at - bad, None


def header_list(content: bytes) -> list[tuple[str, str]]:
    """(name, value) of each header line of one record, in their order."""
    out = []
    for line in content.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]:
        k, _, v = line.decode("utf-8", "replace").partition(":")
        out.append((k.strip(), v.strip()))
    return out


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record."""
    rest = content.partition(b"\r\n\r\n")[2]
    headers = {k.lower(): v for k, v in header_list(content)}
    size = headers.get("content-length", "")
    return headers, rest[: int(size)] if size.isdigit() else rest


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if "application/http" in headers.get("content-type", "") else block


def _rows(rows: list[tuple], fields=_FIELDS) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=pa.int64() if t == "long" else pa.string()) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _open(path: str):
    return fs.FileSystem.from_uri(path)


class _Archive:
    """An archive in the making, seen under its name only once it is whole."""

    def __init__(self, path: str):
        self.files, self.path = _open(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out, self.at = self.files.open_output_stream(self.part, compression=None), 0

    def add(self, record: bytes) -> tuple[int, int]:
        at = self.at
        self.out.write(record)
        self.at += len(record)
        return at, len(record)

    def close(self) -> None:
        self.out.close()
        try:
            self.files.move(self.part, self.path)
        except OSError:
            if self.files.get_file_info(self.path).type == fs.FileType.NotFound:
                raise
            self.files.delete_file(self.part)  # another attempt was first, with the same bytes


def archives(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of each *.warc and *.warc.gz under the path."""
    files, base = _open(path)
    found = files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz")))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives under the path. kind: response, resource, revisit; others by their name, without a digest.

    The payload's digest is computed, also where the record states one; that of a revisit is the stated one. Headers that a record
    lacks are null. What can't be read is a row of the kind "damaged" with its offset and length, and reading goes on at the next
    record. Payloads of any length are read whole, one at a time; repeated records are rows of their own. No archives: no rows.
    """
    found = archives(path)
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    listed = spark.createDataFrame([(prefix + p,) for p, _ in found], "path string").repartition(max(1, min(len(found), 20_000)))
    fields = [*_FIELDS, *_KEYS]

    def index(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                files, at = _open(p)
                rows = []
                with files.open_input_stream(at, compression=None) as stream:
                    for offset, length, content in members(stream):
                        if content is None:
                            rows.append((None, DAMAGED, *[None] * 7, p, offset, length, None, None, None))
                            continue
                        h, block = parse(content)
                        kind, told = h.get("warc-type", "unknown"), h.get("warc-payload-digest")
                        made = size = key = sha1 = stated = None
                        if kind in ("response", "resource"):
                            payload = payload_of(h, block)
                            made, size = digest(payload, told), len(payload)
                            key, sha1, stated = "sha256:" + hashlib.sha256(payload).hexdigest(), "sha1:" + hashlib.sha1(payload).hexdigest(), spelled(told)
                        elif kind == "revisit":
                            made, key = told, spelled(told)
                        rows.append((h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-date"), made, size, h.get("warc-refers-to"), h.get("warc-refers-to-target-uri"), h.get("warc-refers-to-date"), p, offset, length, key, sha1, stated))
                        if len(rows) >= 10_000:
                            yield _rows(rows, fields)
                            rows = []
                yield _rows(rows, fields)

    return listed.mapInArrow(index, ", ".join(f"{n} {t}" for n, t in fields))


def resolve(index: DataFrame) -> DataFrame:
    """The index with a column ``original``: struct (date, record_id, archive, offset, uri) of the first response or resource with the
    row's payload, by these; null where there is none.

    A row without date comes after those with one. Rows without a digest don't take part in any join. Equal rows have one
    original. Empty index: no rows.
    """
    order = F.struct(F.coalesce("date", F.lit("￿")).alias("date"), "record_id", "archive", "offset", "uri")
    payload = F.col("kind").isin("response", "resource")
    held = index.filter(payload & F.col("content").isNotNull())
    again = index.filter((F.col("kind") == "revisit") & F.col("content").isNotNull())
    least = held.groupBy("content").agg(F.min(order).alias("original"))
    # The stated digest of a revisit may be any of those of a payload.
    names = held.select("content", F.explode(F.array_compact(F.array_distinct(F.array("content", "sha1", "stated")))).alias("name"))
    names = names.groupBy("name").agg(F.min("content").alias("content"))
    known = names.join(least, "content").select(F.col("name").alias("content"), "original")
    rest = index.filter(F.col("content").isNull() | ~F.coalesce(payload | (F.col("kind") == "revisit"), F.lit(False))).withColumn("original", F.lit(None).cast(least.schema["original"].dataType))
    joined = held.join(least, "content", "left").unionByName(again.join(known, "content", "left"))
    return joined.unionByName(rest)


def deduplicate(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Write the archives under ``source`` anew under ``target``, each payload once; return the index of the new archives.

    Each old archive makes one new one, named by its path below the source. A response whose payload an earlier one has becomes a
    revisit of that; a revisit refers to the record of its original, or, if no archive has that, to what it referred to. Headers
    that aren't rewritten are carried over, and records of other kinds are copied as they are. What was damaged isn't copied; the
    index reports it as a row of the kind "damaged" without an offset. Ties (equal dates): the lesser record id, archive and offset.
    Missing headers stay missing. Payloads of any length are copied whole. Repeated records: the later ones are revisits. No
    archives: no rows.
    """
    index, index_path = save(spark, read_index(spark, source), "warc-index")
    decided = resolve(index).select(
        "archive",
        F.struct("offset", "length", "kind", "payload_digest", "record_id", "uri", "date", "payload_length", "refers_to", "refers_to_uri", "refers_to_date", F.col("original.date").alias("o_date"), F.col("original.record_id").alias("o_record"), F.col("original.archive").alias("o_archive"), F.col("original.offset").alias("o_offset"), F.col("original.uri").alias("o_uri")).alias("d"),
    )
    plans, plan_path = save(spark, decided.groupBy("archive").agg(F.sort_array(F.collect_list("d")).alias("d")), "warc-plan")
    files, base = _open(target)
    files.create_dir(base, recursive=True)
    prefix = source.split("://")[0] + "://" if "://" in source else ""
    root = prefix + _open(source)[1].rstrip("/") + "/"

    def write(batches):
        for b in batches:
            for archive, plan in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                old, at = _open(archive)
                name = f"{target.rstrip('/')}/dedup-{hashlib.sha1(archive.removeprefix(root).encode('utf-8', 'surrogatepass')).hexdigest()[:24]}.warc.gz"
                new, rows = _Archive(name), []
                with old.open_input_file(at) as stream:
                    for d in plan:
                        if d["kind"] == DAMAGED:
                            rows.append((None, DAMAGED, *[None] * 7, name, None, d["length"]))
                            continue
                        stream.seek(d["offset"])
                        raw = stream.read(d["length"])
                        content = gzip.decompress(raw) if raw[:1] == b"\x1f" else raw
                        h, block = parse(content)
                        more = [(k, v) for k, v in header_list(content) if k.lower() not in _OWN]
                        rid = d["record_id"] or record_id(archive.removeprefix(root), d["offset"])
                        own = d["o_archive"] == archive and d["o_offset"] == d["offset"]
                        refers = (None, None, None)
                        kind, size = d["kind"], d["payload_length"]
                        if kind not in ("response", "resource", "revisit"):
                            record, rid = gzip.compress(raw, 6, mtime=0) if raw[:1] != b"\x1f" else raw, d["record_id"]
                        elif own:
                            record = response(rid, d["uri"], d["date"], d["payload_digest"], block, kind, h.get("content-type", "application/octet-stream"), more)
                        else:
                            http = block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n" if "application/http" in h.get("content-type", "") else b""
                            if d["o_archive"] is None:
                                refers = (d["refers_to"], d["refers_to_uri"], d["refers_to_date"])
                            else:
                                refers = (d["o_record"] or record_id(d["o_archive"].removeprefix(root), d["o_offset"]), d["o_uri"], None if d["o_date"] == "￿" else d["o_date"])
                            kind, size = "revisit", None
                            if rid == refers[0]:  # a repeated record can't keep the id that the first one has
                                rid = record_id(archive.removeprefix(root), d["offset"])
                            record = revisit(rid, d["uri"], d["date"], d["payload_digest"], refers, http, more)
                        rows.append((rid, kind, d["uri"], d["date"], d["payload_digest"], size, *refers, name, *new.add(record)))
                        if len(rows) >= 10_000:
                            yield _rows(rows)
                            rows = []
                new.close()
                yield _rows(rows)

    out, _ = save(spark, plans.repartition(max(1, min(plans.count(), 20_000))).mapInArrow(write, INDEX), "warc-new-index")
    for p in (index_path, plan_path):
        drop_path(spark, p)
    return out


def write_pages(spark: SparkSession, pages: DataFrame, path: str, *, id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = 64 << 20) -> None:
    """Each page as a response record, in archives of about ``archive_bytes``. The date is page_id seconds after 2024-01-01.

    Null html: an empty payload. Null url or id: a record without URI or date. Very long pages are kept whole; repeated rows are
    records of their own. Empty table: an empty folder. Extra columns don't matter.
    """
    need(pages, id, url, html)
    files, base = _open(path)
    files.create_dir(base, recursive=True)
    date = F.date_format(F.timestamp_seconds(F.lit(1704067200) + col(id).cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    narrow = pages.select(date.alias("date"), col(url).cast("string").alias("url"), F.coalesce(col(html).cast("string"), F.lit("")).cast("binary").alias("html"), F.spark_partition_id().alias("part"))

    def write(batches):
        archive, number, n, part = None, 0, 0, 0
        for b in slices(batches, "html"):
            for when, uri, payload, part in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if archive is None:
                    archive = _Archive(f"{path.rstrip('/')}/pages-{part:06d}-{number:06d}.warc.gz")
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                archive.add(response(record_id(part, n), uri, when, digest(payload), block))
                n += 1
                if archive.at >= archive_bytes:
                    archive.close()
                    archive, number = None, number + 1
        if archive is not None:
            archive.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], type=pa.int64())], names=["records"])

    narrow.mapInArrow(write, "records long").agg(F.sum("records")).collect()


def deduplicate_pages(spark: SparkSession, pages: DataFrame, target: str | None = None, **columns) -> DataFrame:
    """Pages to archives, deduplicated: the index of the new archives under ``target`` (default: the shared folder).

    Nulls, very long pages, repeated rows, empty tables and extra columns: as in ``write_pages``; of equal pages all but the first are
    revisits. Ties: the least page_id is the first.
    """
    raw, target = new_path(spark, "warc-raw"), target or new_path(spark, "warc")
    write_pages(spark, pages, raw, **columns)
    out = deduplicate(spark, raw, target)
    drop_path(spark, raw)
    return out
