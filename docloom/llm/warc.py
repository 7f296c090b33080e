"""Operator 12: WARC archives of pages, and a reader that salvages what is left of damaged ones.

Writing: pages with equal payloads are found by their digest; the one with the smallest id is written as
a response, the others as revisits that refer to it. A record is one gzip member. Spark's text writer puts
the members into files; its line separator is an empty member, which adds nothing to what they hold.

Reading: a file is a row of Spark's binary source. The reader goes from member to member, or, where
nothing is compressed, from version line to version line. Each record must have a version line, named
headers that the format asks for, a block of the length told, its end, and the digests told. Where one of
these fails, the reader searches on from there for the next member or version line at which all of them
hold, goes on with it, and reports the bytes between as a gap with the reason. Every byte of a file
belongs to a record, an empty member or a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import discard, shared_dir, stash_counted, table

#: Payloads with fewer bytes are never written as revisits.
LEAST_BYTES = 100
#: A group of equal payloads with more rows than one in HOT of all, so that there are at most HOT of them, is joined by broadcast.
HOT = 1000
#: Longest header, longest decompressed member, and bytes of payloads in a batch of rows.
LONGEST_HEADER, LONGEST_MEMBER, BATCH = 1 << 20, 1 << 30, 1 << 24
SCHEME = "urn:docloom:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORDS = (
    "path string, kind string, at long, inside long, length long, reason string, type string, record_id string, target_uri string, date string, "
    "refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
)


def member(data: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


EMPTY = member(b"")


def record(kind: str, record_id: str, uri: str, block: bytes, content_type: str, more: dict[str, str], date: str = DATE) -> bytes:
    """One record. Control characters and blanks of the address are percent-encoded, so it cannot break its line."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, "WARC-Target-URI": uri} | more
    head |= {"WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type": content_type, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | str | None, url: str | None, payload: bytes, first: int | str | None) -> bytes:
    """A page as a response, or with `first` as a revisit of that page."""
    own = f"{SCHEME}{'null' if page_id is None else page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    more = {"WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}"}
    if first is not None:
        more |= {"WARC-Refers-To": f"<{SCHEME}{first}>", "WARC-Profile": PROFILE}
    return record("response" if first is None else "revisit", own, url or own, http if first is not None else http + payload, "application/http;msgtype=response", more)


class Damaged(Exception):
    """A check of a member or a record failed."""


def _digest_fails(told: str, data: bytes) -> bool:
    """Whether a digest of a known algorithm differs, in base 16 or base 32."""
    name, _, value = told.strip().partition(":")
    name = name.lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return False
    own = hashlib.new(name, data).digest()
    return value.lower() != own.hex() and value.upper().rstrip("=") != base64.b32encode(own).decode().rstrip("=")


_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
_START = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|WARC/\d+\.\d+\r\n")
_NAMED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def _record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at a place, and its end."""
    m = _VERSION.match(data, at)
    if not m:
        raise Damaged("no member or version line")
    end = data.find(b"\r\n\r\n", m.end() - 2, at + LONGEST_HEADER)
    if end < 0:
        raise Damaged("no end of the header")
    headers: dict[str, str] = {}
    last = None
    for line in data[m.end() : end].decode("utf-8", "replace").split("\r\n") if end >= m.end() else []:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and last:
            headers[last] += " " + line.strip()
        elif not colon or not name.strip():
            raise Damaged("a line of the header has no name")
        else:
            last = name.strip().lower()
            headers[last] = value.strip()
    if missing := [n for n in _NAMED if n not in headers]:
        raise Damaged(f"no {missing[0]}")
    if not re.fullmatch("[0-9]{1,18}", headers["content-length"]):
        raise Damaged("content-length is no number")
    start, stop = end + 4, end + 4 + int(headers["content-length"])
    if stop > len(data):
        raise Damaged("the block is cut off")
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("no end of the record")
    block = data[start:stop]
    if "warc-block-digest" in headers and _digest_fails(headers["warc-block-digest"], block):
        raise Damaged("block digest")
    kind, payload, http = headers["warc-type"].lower(), block, b""
    if headers.get("content-type", "").lower().startswith("application/http") and (cut := block.find(b"\r\n\r\n")) >= 0:
        http, payload = block[: cut + 2], block[cut + 4 :]
    told = headers.get("warc-payload-digest", "")
    n = len(payload)
    if kind == "revisit":  # the payload is elsewhere; the HTTP header tells its length
        length = re.search(rb"\r\n[Cc]ontent-[Ll]ength:[ \t]*([0-9]{1,18})[ \t]*\r\n", http)
        n, payload = (int(length[1]) if length else None), None
    elif told and "warc-truncated" not in headers and b"chunked" not in http.lower() and _digest_fails(told, payload):
        raise Damaged("payload digest")
    bare = lambda name: headers[name].strip("<>") if name in headers else None
    digest = told.partition(":")[2] or (hashlib.sha256(payload).hexdigest() if payload is not None else None)
    row = {"kind": "record", "type": kind, "record_id": bare("warc-record-id"), "target_uri": bare("warc-target-uri"), "date": headers["warc-date"], "refers_to": bare("warc-refers-to"), "payload_digest": digest, "payload_bytes": n, "headers": headers, "payload": payload}
    return row, stop + 4


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """What the member that starts at a place holds, and its end."""
    d, out, total, fed, step = zlib.decompressobj(31), [], 0, at, 1 << 12
    try:
        while not d.eof:
            if fed >= len(data):
                raise Damaged("the member is cut off")
            some = data[fed : fed + step]
            fed, step = fed + len(some), min(step * 2, 1 << 16)
            while some and not d.eof:
                out.append(d.decompress(some, 1 << 20))
                some = d.unconsumed_tail
                total += len(out[-1])
                if total > LONGEST_MEMBER:
                    raise Damaged("the member is too long")
    except zlib.error as e:
        raise Damaged(f"the member fails: {str(e).rpartition(': ')[2]}") from None
    return b"".join(out), fed - len(d.unused_data)


def salvage(data: bytes, packed: bool = True) -> Iterator[dict]:
    """All records and gaps of an archive's bytes in order.

    at and length are the place in the file of the record, or of the member that holds it; inside is the
    place within the member. A gap within a sound member has the member's place, and its own inside and length.
    A record that is quoted whole within the block of a damaged one is taken for a record: nothing tells them apart.
    """
    at, gap, why = 0, None, ""
    while at < len(data):
        try:
            if packed and data.startswith(b"\x1f\x8b\x08", at):
                held, end = _member(data, at)
                rows = list(salvage(held, packed=False))
                if rows and all(r["kind"] == "gap" for r in rows) and gap is not None:
                    raise Damaged(rows[0]["reason"])
                for r in rows:
                    if r["kind"] == "record":
                        r["length"] = end - at
                    r |= {"inside": r["at"], "at": at}
            else:
                row, end = _record(data, at)
                rows = [row | {"at": at, "inside": 0, "length": end - at}]
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            m = (_START if packed else _VERSION).search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if gap is not None:
            yield {"kind": "gap", "at": gap, "inside": 0, "length": at - gap, "reason": why}
            gap = None
        yield from rows
        at = end
    if gap is not None:
        yield {"kind": "gap", "at": gap, "inside": 0, "length": len(data) - gap, "reason": why}


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records and gaps of the archives in a folder, compressed or not; see `salvage` for the columns.

    kind is record or gap. payload_bytes and payload_digest (without its algorithm) are those of the payload, for
    revisits those of the payload that they refer to; ids stand without brackets; header names are in lower case.
    Files are read whole (the binary source takes up to 2 GB); an empty file or folder gives no rows.
    """
    columns = [c.split()[0] for c in RECORDS.split(", ")]

    def run(batches):
        for df in batches:
            for file, content in zip(df["path"], df["content"], strict=True):
                rows, size = [], 0
                for r in salvage(content or b""):
                    size += 500 + len(r.get("payload") or b"")
                    if not payloads:
                        r["payload"] = None
                    rows.append(r | {"path": file})
                    if size > BATCH:
                        yield pd.DataFrame(rows).reindex(columns=columns).astype(object).where(lambda x: x.notna(), None)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows).reindex(columns=columns).astype(object).where(lambda x: x.notna(), None)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, RECORDS)


def gaps(found: DataFrame) -> DataFrame:
    """The log of quarantined bytes."""
    return found.where("kind = 'gap'").select("path", "at", "inside", "length", "reason")


def resolved(found: DataFrame) -> DataFrame:
    """Records with the payloads of revisits taken from the responses that they refer to; null where that one was lost."""
    own = found.where("kind = 'record'")
    held = own.where("type = 'response'").select(F.col("record_id").alias("__id"), F.col("payload").alias("__payload")).dropDuplicates(["__id"])
    joined = own.join(held, own["refers_to"] == held["__id"], "left")
    return joined.withColumn("payload", F.when(F.col("type") == "revisit", F.col("__payload")).otherwise(F.col("payload"))).drop("__id", "__payload")


def write(pages: DataFrame, path: str) -> None:
    """(page_id, url, html) -> archives in a folder, a record for each row.

    Of pages with equal payloads of at least LEAST_BYTES bytes the one with the smallest page_id is the response
    (rows that share that id all are), others revisit it. A null html is an empty payload, a null url is replaced by
    the record's id; a null page_id comes after all others and is written as null, so it is never referred to.
    Extra columns are ignored, and an empty table gives no record.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    digest: Column = F.unhex(F.sha2("html", 256))
    long = pages.where(F.octet_length("html") >= LEAST_BYTES).groupBy(digest.alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
    groups, n = stash_counted(long.where("rows > 1 AND first IS NOT NULL"), "equal-payloads")
    rows = pages.withColumn("first", F.lit(None).cast("long"))
    if n:
        most = groups.agg(F.sum("rows")).first()[0] // HOT
        hot = F.broadcast(groups.where(F.col("rows") > most).select(F.col("digest").alias("hot"), F.col("first").alias("hot_first")))
        rest = groups.where(F.col("rows") <= most).select(F.col("digest").alias("other"), F.col("first").alias("other_first"))
        # short payloads have no key, so they join nothing
        rows = pages.withColumn("digest", F.when(F.octet_length("html") >= LEAST_BYTES, digest))
        rows = rows.join(hot, F.col("digest") == F.col("hot"), "left").join(rest, F.col("digest") == F.col("other"), "left")
        rows = rows.withColumn("first", F.coalesce("hot_first", "other_first"))
        rows = rows.withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).select("page_id", "url", "html", "first")

    def run(batches):
        for df in batches:
            yield pd.DataFrame({"value": [member(page_record(i, u, h, f)) for i, u, h, f in zip(df["page_id"], df["url"], df["html"], df["first"], strict=True)]})

    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "first")})  # pandas makes numbers with nulls inexact
    made = rows.mapInPandas(run, "value binary").hint("rebalance")  # files of the advisory size, whatever the pages' sizes
    made.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).text(path)
    discard(groups)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of pages, written and read back."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    found = read(spark, path, payloads=False).where("kind = 'record'")
    page = F.expr(f"try_cast(substring(record_id, {len(SCHEME) + 1}) AS long)")
    refers = F.expr(f"try_cast(substring(refers_to, {len(SCHEME) + 1}) AS long)")
    return found.select(page.alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), refers.alias("refers_to"))


OP12_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
