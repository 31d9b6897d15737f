"""WARC: archives of captures, written and read back, and the assembly of transactions.

A capture is a response (or, for a payload that another capture holds, a revisit), with a
request and a metadata record that name it in WARC-Concurrent-To. Records are separate gzip
members. Archives are parsed into a table of records, and the records of a capture are joined
by these identifiers into one nested row.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.files import open_file, write_file
from quadrat.llm.memory import released
from quadrat.runtime import fresh_path, materialize, ship

#: Payloads smaller than this are never revisits.
LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
#: Payload bytes of an archive, about.
FILE_BYTES = 64_000_000

RECORD = (
    "record_id string, record_type string, target_uri string, concurrent_to string, refers_to string, payload_digest string, "
    "fields map<string,string>, payload binary, payload_bytes long, payload_sha1 string"
)


def _id(kind: str, page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page}')}>"


def _record(kind: str, record_id: str, uri: str, content_type: str, block: bytes, **more: str) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE, "WARC-Target-URI": uri} | {k.replace("_", "-"): v for k, v in more.items()}
    head |= {"Content-Type": content_type, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v)
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def _clean(uri: str | None) -> str:
    """A header value on one line; percent-encodes what a header can't hold."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri or "")


def capture_records(page: str, uri: str | None, payload: bytes, digest: str, held_by: str | None, nth: int = 1) -> bytes:
    """The three records of a capture; held_by: the page whose response holds the payload.

    nth tells captures of the same page and payload apart.
    """
    where, page_key = _clean(uri), f"{page}:{digest}" + (f":{nth}" if nth > 1 else "")
    capture = _id("capture", page_key)
    path = re.sub(r"^[A-Za-z][\w+.-]*://[^/]*", "", where) or "/"
    host = (re.match(r"[A-Za-z][\w+.-]*://([^/]*)", where) or ["", ""])[1]
    out = _record("request", _id("request", page_key), where, "application/http; msgtype=request", f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(), WARC_Concurrent_To=capture)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    more = {"WARC_Payload_Digest": f"sha1:{digest}"}
    if held_by is None:
        out += _record("response", capture, where, "application/http; msgtype=response", head + payload, **more)
    else:
        more |= {"WARC_Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC_Refers_To": _id("capture", f"{held_by}:{digest}")}
        out += _record("revisit", capture, where, "application/http; msgtype=response", head, **more)
    fields = f"page-id: {page}\r\npayload-bytes: {len(payload)}\r\n".encode()
    return out + _record("metadata", _id("metadata", page_key), where, "application/warc-fields", fields, WARC_Concurrent_To=capture)


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write pages (page_id, url, html) as WARC archives under folder; their list (path, records).

    Of pages with equal payloads of at least `least` bytes the one with the largest page_id is
    the response. A null html is an empty payload, a null url an empty address. Every row is a
    capture of its own: rows equal in page_id and payload are numbered, and are all responses or
    all revisits. Rows with a null page_id are written as responses.
    """
    ship(pages.sparkSession)
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    table = pages.select(F.col("page_id").cast("long"), "url", body.alias("body")).withColumn("digest", F.sha1("body")).withColumn("big", F.length("body") >= least)
    seen = materialize(table.filter("page_id is not null").groupBy("digest", "page_id", "big").agg(F.count("*").alias("n")), "warc-seen")
    again = seen.filter("n > 1").select("digest", "page_id")
    if again.isEmpty():
        rows = table.withColumns({"first": F.lit(1), "copies": F.lit(1).cast("long")})
    else:
        # Rows equal in all columns are one with a count; of a page and payload only distinct addresses are numbered.
        same = table.join(again, ["digest", "page_id"], "left_semi").groupBy("page_id", "url", "digest", "big").agg(F.first("body").alias("body"), F.count("*").alias("copies"))
        before = Window.partitionBy("page_id", "digest").orderBy("url").rowsBetween(Window.unboundedPreceding, -1)
        same = same.withColumn("first", (F.coalesce(F.sum("copies").over(before), F.lit(0)) + 1).cast("int"))
        other = table.join(again, ["digest", "page_id"], "left_anti").withColumns({"first": F.lit(1), "copies": F.lit(1).cast("long")})
        rows = other.unionByName(same)
    shared = seen.filter("big").groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("pages")).filter("pages > 1")
    small = rows.filter("not big").withColumn("holder", F.lit(None).cast("long"))
    large = rows.filter("big").join(materialize(shared.select("digest", "holder"), "warc-shared"), "digest", "left")
    names = ["page_id", "url", "body", "digest", "holder", "first", "copies"]
    held = large.select(names).unionByName(small.select(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        done, first = 0, next(rows, None)
        while first is not None:
            name = f"{folder}/{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}.warc.gz"

            def write(out: pa.NativeFile) -> None:
                nonlocal first, done
                out.write(_record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", "", "application/warc-fields", b"software: quadrat\r\nformat: WARC file version 1.1\r\n"))
                size, done = 0, 0
                while first is not None and size < FILE_BYTES:
                    page, url, payload, digest, holder, nth, copies = first
                    key = str(page) if page is not None else f"null-{uuid.uuid4()}"
                    by = str(holder) if holder is not None and page is not None and holder != page else None
                    for k in range(copies):
                        out.write(capture_records(key, url, payload, digest, by, nth + k))
                    size, done, first = size + len(payload) * copies, done + 3 * copies, next(rows, None)

            write_file(name, write)
            yield pa.record_batch({"path": [name], "records": pa.array([done + 1], pa.int64())})

    return materialize(held.mapInArrow(released(run), "path string, records long"), "warc-files")


def _members(source: pa.NativeFile) -> Iterator[bytes]:
    """The records of an archive, one gzip member at a time."""
    left, packer, out = b"", None, []
    while True:
        chunk = left or source.read(1 << 20)
        if not chunk:
            if packer is not None:
                raise ValueError("an archive ends within a record")
            return
        if packer is None:
            packer, out = zlib.decompressobj(31), []
        out.append(packer.decompress(chunk))
        left = packer.unused_data
        if packer.eof:
            yield b"".join(out)
            packer = None


def parse_record(raw: bytes) -> dict:
    """One record's headers and what its type holds: a payload behind HTTP headers, or fields."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    names = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    length = int(names.get("Content-Length", 0))
    if len(rest) < length:
        raise ValueError(f"record {names.get('WARC-Record-ID')} is cut short")
    block = rest[:length]
    kind = names.get("WARC-Type")
    out = {"record_id": names.get("WARC-Record-ID"), "record_type": kind, "target_uri": names.get("WARC-Target-URI"), "concurrent_to": names.get("WARC-Concurrent-To"), "refers_to": names.get("WARC-Refers-To")}
    out["payload_digest"] = names.get("WARC-Payload-Digest")
    out |= {"fields": None, "payload": None, "payload_bytes": None, "payload_sha1": None}
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        out |= {"payload": payload, "payload_bytes": len(payload), "payload_sha1": hashlib.sha1(payload).hexdigest()}
    elif names.get("Content-Type") == "application/warc-fields":
        out["fields"] = [tuple(line.split(": ", 1)) for line in block.decode().split("\r\n") if ": " in line]
    else:
        out["fields"] = [("request", block.partition(b"\r\n")[0].decode())]
    return out


def read_records(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the listed archives (column path), one row each.

    payloads=False leaves the payload column null; length and digest are always taken from
    the payload itself.
    """
    spark = files.sparkSession
    ship(spark)
    listed = [(r.path,) for r in files.select("path").collect()]  # a row for each file
    if not listed:
        return spark.createDataFrame([], RECORD)
    kinds = {"payload": pa.binary(), "payload_bytes": pa.int64(), "fields": pa.map_(pa.string(), pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.record_batch({k: pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in rows[0]})

        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                with open_file(path) as source:
                    for raw in _members(source):
                        rows.append(parse_record(raw))
                        if not payloads:
                            rows[-1]["payload"] = None
                        size += len(raw)
                        if size > 8_000_000 or len(rows) >= 3000:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return spark.createDataFrame(listed, "path string").repartition(len(listed)).mapInArrow(released(run), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: request, response (or revisit) and metadata.

    Request and metadata records go to the capture they name in WARC-Concurrent-To; a capture
    without them has nulls there, and records that name no capture are left out. They meet by
    grouping: each record has one capture's identifier as its key.
    """
    key = F.when(F.col("record_type").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    part = lambda kinds, *names: F.first(F.when(F.col("record_type").isin(*kinds), F.struct(*names)), ignorenulls=True)
    rows = records.withColumn("capture_id", key).filter("capture_id is not null").groupBy("capture_id").agg(
        part(["request"], "record_id", "target_uri", "fields").alias("request"),
        part(["response", "revisit"], "record_type", "target_uri", "refers_to", "payload_digest", "payload", "payload_bytes", "payload_sha1").alias("response"),
        part(["metadata"], "record_id", "fields").alias("metadata"),
    )
    return rows.filter("response is not null")


def page_captures(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from written archives.

    All of pages is written to the shared folder, read back and assembled; a response's figures
    come from its payload, a revisit's from the records that stand for it. refers_to is the
    page_id of the response that holds a revisit's payload. See write_archives for nulls and
    repeated rows; an empty table gives an empty result.
    """
    files = write_archives(pages, fresh_path(pages.sparkSession, "warc"), least)
    captures = assemble(read_records(files, payloads=False))
    flat = materialize(captures.select(
        "capture_id",
        F.col("metadata.fields")["page-id"].try_cast("long").alias("page_id"),
        F.coalesce("response.payload_bytes", F.col("metadata.fields")["payload-bytes"].cast("long")).alias("payload_bytes"),
        F.coalesce("response.payload_sha1", F.regexp_replace("response.payload_digest", "^sha1:", "")).alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("response.refers_to").alias("refers"),
    ), "warc-captures")
    revisits = flat.filter("record_type = 'revisit'")
    held = revisits.select("refers").distinct().join(flat.select(F.col("capture_id").alias("refers"), F.col("page_id").alias("refers_to")), "refers")
    return flat.join(held, "refers", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH t AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM t),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST} AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST} AND holder <> page_id THEN holder END AS refers_to
FROM m
"""
