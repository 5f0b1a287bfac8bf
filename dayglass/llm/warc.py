"""WARC archives: writing pages, and reading records back by boundary-chain verification.

Writing is a text sink whose line separator is the record terminator, so Spark's commit
protocol and any Hadoop file system serve. Reading cuts every file into byte ranges;
each task reports every place in its range that parses as a record head, with the offset
of its successor (head, block and terminator later). A payload can hold such places too.
Pointer jumping from offset 0 of each file doubles the verified chain in every round, so
a file of n candidates takes log2(n) rounds, and only candidates on the chain are records.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayglass.llm.common import shared_path, stored

#: Bytes of a file that one task scans, and of a record head that are read at a time.
RANGE, HEAD = 4 << 20, 1 << 16

MAGIC = b"WARC/1."

#: The digits of the two base-32 notations, in order.
PLAIN_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
RFC_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Base-32 SHA-1 without prefix: four groups of 40 bits, eight digits each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), PLAIN_DIGITS, RFC_DIGITS)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write page_id, url, html as response and revisit records under `path`.

    Of pages with equal payloads of at least `least_bytes`, the largest page_id is the
    response. A null html is the empty payload, a null url an empty target. A page
    without id is always a response; rows that share the largest id all are.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", " ").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).alias("bytes"),
        base32_sha1(payload).alias("digest"),
    )
    repeated = (
        rows.where(F.col("bytes") >= least_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "kept")
    )
    revisit = F.coalesce(F.col("page_id") < F.col("kept"), F.lit(False))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.when(F.col("revisit"), F.col("http")).otherwise(F.concat("http", "payload"))
    size = F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "),
        F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(
            F.col("revisit"),
            F.concat(
                F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
                F.lit("\r\nWARC-Refers-To: <urn:page:"),
                F.col("kept").cast("string"),
                F.lit(">"),
            ),
        ).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        size.cast("string"),
        F.lit("\r\n\r\n"),
    )
    (
        rows.join(repeated, "digest", "left")
        .withColumn("revisit", revisit)
        .withColumn("http", http)
        .select(F.concat(head, block).alias("value"))
        .write.option("lineSep", "\r\n\r\n")
        .text(path)
    )


_CANDIDATE = pa.schema(
    [
        ("path", pa.string()),
        ("start", pa.int64()),
        ("next", pa.int64()),
        ("record_type", pa.string()),
        ("page_id", pa.int64()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
    ]
)

_version = regex.compile(rb"WARC/1\.\d*\r\n").match
_stop = regex.compile(rb"\r\n\r\n|\r\nWARC/1\.").search
_length = regex.compile(rb"(?i)\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r\n").search
_field = regex.compile(r"(?i)\r\n(warc-[a-z-]+):[ \t]*([^\r\n]*)").findall
_page = regex.compile(r"<urn:page:(-?\d+)>").fullmatch


def _open(path: str):
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, inner = pafs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _head(file, size: int, start: int, head: bytes) -> tuple[bytes, int]:
    """The record head at `start` and its end, read on in blocks however long it is; -1
    where the file ends first, or a line that opens another head comes first."""
    if not _version(head):
        return head, -1
    head, at = bytearray(head), 0
    while True:
        stop = _stop(head, at)
        if stop:
            return bytes(head), stop.start() if stop[0] == b"\r\n\r\n" else -1
        at = max(0, len(head) - len(b"\r\n" + MAGIC))
        more = file.read_at(min(HEAD, size - start - len(head)), start + len(head)) if size > start + len(head) else b""
        if not more:
            return bytes(head), -1
        head += more


def _record(file, size: int, start: int, head: bytes) -> dict | None:
    """What a candidate at `start` says, or None if no head parses there."""
    head, end = _head(file, size, start, head)
    found = _length(head[: end + 2]) if end >= 0 else None
    if not found:
        return None
    block, length = start + end + 4, int(found[1])
    after = block + length + 4
    if after > size:
        return None
    fields = {k.lower(): v for k, v in _field(head[:end].decode("utf-8", "replace"))}
    page, refers = (_page(fields.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
    out = {
        "start": start,
        "next": after,
        "record_type": fields.get("warc-type"),
        "page_id": page and int(page[1]),
        "refers_to": refers and int(refers[1]),
        "payload_bytes": None,
        "payload_digest": None,
    }
    if file.read_at(4 + len(MAGIC), after - 4) not in (b"\r\n\r\n", b"\r\n\r\n" + MAGIC):
        return out
    body = file.read_at(length, block)
    split = body.find(b"\r\n\r\n") + 4
    if out["record_type"] == "revisit":
        http = _length(body[: split - 2])
        out["payload_bytes"] = http and int(http[1])
        out["payload_digest"] = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    elif split >= 4:
        out["payload_bytes"] = length - split
        out["payload_digest"] = base64.b32encode(hashlib.sha1(memoryview(body)[split:]).digest()).decode()
    return out


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")


def candidates(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """Every place in the files under `path` that parses as a record head.

    A head that claims more than its file holds is none. Payload columns stay null where
    the block isn't followed by a terminator and a further head or the file's end.
    """
    ranges = _files(spark, path).select(
        "path", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(range_bytes))).alias("from")
    ).repartition("path", "from")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as file:
                    most = min(range_bytes, row["length"] - row["from"])
                    data = file.read_at(most + HEAD, row["from"])
                    found, at = [], data.find(MAGIC)
                    while 0 <= at < most:
                        record = _record(file, row["length"], row["from"] + at, data[at : at + HEAD])
                        if record:
                            found.append({"path": row["path"], **record})
                        at = data.find(MAGIC, at + 1)
                if found:
                    yield pa.RecordBatch.from_pylist(found, _CANDIDATE)

    schema = (
        "path string, start bigint, next bigint, record_type string, page_id bigint, refers_to bigint,"
        " payload_bytes bigint, payload_digest string"
    )
    return ranges.mapInArrow(scan, schema)


def reachable(found: DataFrame) -> DataFrame:
    """Candidates (path, start, next, ...) on the chain from offset 0 of their file.

    Each round a link is replaced by the link of its target, and what verified candidates
    link to is verified.
    """
    found = stored(found, "candidates").withColumn("file", F.xxhash64("path"))
    most = found.groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    nodes = found.select("file", "start", F.col("next").alias("link"), (F.col("start") == 0).alias("verified"))
    for _ in range(math.ceil(math.log2(most)) if most > 1 else 0):
        targets = nodes.select("file", F.col("start").alias("link"), F.col("link").alias("further"))
        hits = nodes.where("verified").select("file", F.col("link").alias("start"), F.lit(True).alias("hit"))
        nodes = stored(
            nodes.join(targets, ["file", "link"], "left")
            .join(hits, ["file", "start"], "left")
            .select("file", "start", F.col("further").alias("link"), (F.col("verified") | F.col("hit").isNotNull()).alias("verified")),
            "chain",
        )
    return found.join(nodes.where("verified").select("file", "start"), ["file", "start"]).drop("file")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under `path`, with the digest of the bytes read.

    Raises ValueError if the records of a file do not end where the file does.
    """
    records = stored(reachable(candidates(spark, path)), "records")
    ends = records.groupBy("path").agg(F.max("next").alias("end"))
    broken = _files(spark, path).join(ends, "path", "left").where(~F.col("length").eqNullSafe(F.col("end"))).first()
    if broken:
        raise ValueError(f"{broken['path']}: the records end at byte {broken['end'] or 0} of {broken['length']}")
    return records


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages to the shared folder and read them back, one row a page."""
    path = shared_path(pages.sparkSession, "archives")
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
