"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing: one record a page. Of pages with equal payloads the one with the largest id is a response, the others
revisit it. Reading: tasks look for the magic line and emit, for each place where a block of the archive may be
entered, the chain of record-to-successor offsets through the block and the offset where it leaves. Pointer
jumping over (place, exit) from each file's start keeps the chains that are reached, so magic lines inside
payloads are rejected. Revisits take length and digest from the response that they name.

Null payloads are empty; a null page id reads back as null and is a response unless an equal payload has an
id. Rows that repeat the largest id of a payload are responses too. No rows give no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.runtime import new_path, sized, table

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
#: Records a file by payload: up to so many bytes, so many records, so that files stay near 64 MB or hold one record.
RECORDS_PER_FILE = ((1 << 16, 1000), (1 << 22, 16), (None, 1))
BLOCK = 1 << 16
DATE = "2024-01-01T00:00:00Z"


def base32(hex_: Column) -> Column:
    """Upper-case base32 of a 40-digit hex string: four characters for every five digits."""
    part = lambda i: F.lpad(F.conv(F.substring(hex_, 5 * i + 1, 5), 16, 32), 4, "0")
    digits = F.upper(F.concat(*[part(i) for i in range(8)]))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> str:
    """Write the pages (page_id, url, html) to gzipped archives in a folder a size of page; the folder's path."""
    path = path or new_path(pages.sparkSession, "warc")
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("_b"))
    rows = rows.withColumn("_sha", F.sha1(F.col("_b").cast("binary"))).withColumn("_n", F.octet_length("_b"))
    twins = table(rows.where(F.col("_n") >= min_bytes).groupBy("_sha").agg(F.max("page_id").alias("_head"), F.count("*").alias("_c")).where("_c > 1").select("_sha", "_head"), "warc-twins")
    rows = rows.join(sized(twins), "_sha", "left")
    revisit = F.col("_head").isNotNull() & ~F.col("_head").eqNullSafe(F.col("page_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("_n")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "_b"))
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("_sha")))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("_head"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", F.octet_length("_block")), F.lit("\r\n"),
    )
    largest = rows.agg(F.max("_n")).first()[0] or 0
    low = 0
    for high, records in RECORDS_PER_FILE:
        if low and low > largest:
            break
        own = rows.where((F.col("_n") >= low if low else F.lit(True)) & (F.col("_n") < high if high else F.lit(True)))
        record = own.withColumn("_block", block).select(F.concat(head, "_block").alias("value"))
        record.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records).text(f"{path}/under-{high or 'all'}")
        low = high
    return path


def _field(head: bytes, name: bytes) -> bytes | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)\r?$", head)
    return m[1] if m else None


def _records(data: bytes) -> dict[int, tuple[int, int, int]]:
    """Place of each magic line with a readable head: head's end, block's length, successor."""
    out, at = {}, data.find(MAGIC)
    while at >= 0:
        end = data.find(b"\r\n\r\n", at)
        length = _field(data[at : end + 2], b"Content-Length") if end >= 0 else None
        if length is not None and length.isdigit():
            out[at] = (end + 4, int(length), end + 4 + int(length) + 4)
        at = data.find(MAGIC, at + 1)
    return out


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = content.as_buffer()
            data = gzip.decompress(raw) if path.endswith(".gz") else raw.to_pybytes()
            found = _records(data)
            block = lambda x: x // BLOCK
            doors = {0} | {n for a, (_, _, n) in found.items() if block(n) != block(a)}
            rows = {"file": [], "enter": [], "leave": [], "records": []}
            for door in sorted(doors & found.keys()):
                at, members = door, []
                while at in found and block(at) == block(door):
                    members.append(_described(data, at, *found[at]))
                    at = found[at][2]
                rows["file"].append(path)
                rows["enter"].append(door)
                rows["leave"].append(at)
                rows["records"].append(members)
            yield pa.record_batch([pa.array(rows["file"], pa.string()), pa.array(rows["enter"], pa.int64()), pa.array(rows["leave"], pa.int64()), pa.array(rows["records"], RECORDS)], names=list(rows))


RECORDS = pa.list_(pa.struct([("page_id", pa.int64()), ("type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string())]))
CHAIN = "file string, enter long, leave long, records array<struct<page_id:long,type:string,refers_to:long,payload_bytes:long,digest:string>>"


def _described(data: bytes, at: int, start: int, length: int, _next: int) -> dict:
    head = data[at:start]
    http_end = data.find(b"\r\n\r\n", start, start + length)
    payload = data[http_end + 4 : start + length] if http_end >= 0 else data[start : start + length]
    kind = (_field(head, b"WARC-Type") or b"").decode()
    digest = (_field(head, b"WARC-Payload-Digest") or b"").decode().removeprefix("sha1:")
    if kind == "response":
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        digest = own if own == digest else "mismatch"
    number = lambda f: int(m[1]) if (m := re.fullmatch(rb"<urn:page:(-?\d+)>", _field(head, f) or b"")) else None
    return {"page_id": number(b"WARC-Record-ID"), "type": kind, "refers_to": number(b"WARC-Refers-To"), "payload_bytes": len(payload), "digest": digest}


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, type, refers_to, payload_bytes, digest) of the records on each file's chain."""
    files = spark.read.format("binaryFile").load(f"{path}/*").select("path", "content")
    chains = table(files.mapInArrow(_chains, CHAIN), "warc-chains")
    links = chains.select("file", "enter", "leave")
    most = links.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    reached = links.where("enter = 0").select("file", F.col("enter").alias("at"))
    jump = links
    # After round i every chain within 2^i jumps of the file's start is reached.
    for _ in range(int(most).bit_length()):
        on = jump.withColumnRenamed("enter", "at")
        reached = table(reached.unionByName(reached.join(on, ["file", "at"]).select("file", F.col("leave").alias("at"))).distinct(), "warc-reached")
        then = jump.select("file", F.col("enter").alias("leave"), F.col("leave").alias("leave2"))
        jump = table(jump.join(then, ["file", "leave"]).select("file", "enter", F.col("leave2").alias("leave")), "warc-jumps")
    kept = chains.join(reached.withColumnRenamed("at", "enter"), ["file", "enter"], "left_semi")
    return kept.select(F.inline("records"))


def resolve(records: DataFrame) -> DataFrame:
    """Records with revisits given length and digest of the response that they refer to, if the digests agree."""
    heads = records.where("type = 'response' AND page_id IS NOT NULL").groupBy(F.col("page_id").alias("refers_to"), F.col("digest")).agg(F.max("payload_bytes").alias("_bytes"))
    joined = records.join(heads, ["refers_to", "digest"], "left")
    return joined.select("page_id", F.when(F.col("type") == "revisit", F.col("_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
