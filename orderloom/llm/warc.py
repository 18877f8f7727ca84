"""Web archives: writing pages as WARC records and reading them back by boundary-chain verification.

Writing is a projection: each row becomes one record's text, and records are parted by the blank
lines that end a WARC record. Equal payloads are found by their digests; only digests that occur more
than once are joined back, so payloads themselves are not shuffled when those are few.

Reading takes no magic bytes on trust. A task lists every place of an archive where a record could
begin, with the place where its successor would begin by its own length field. Pointer jumping from
the start of the file then keeps the places the chain really reaches: a payload that holds a whole
record, magic and all, lies inside another record's length and is never reached.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm.common import shared_folder, stored

BROADCAST_ROWS = 500_000
END = "\r\n\r\n"
_BASE32HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """SHA-1 as bare upper-case base32."""
    digits = F.sha1(payload)
    quads = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*quads), _BASE32HEX, _BASE32)


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for null; line ends in the value are escaped."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.url_encode(F.coalesce(page.cast("string"), F.lit(""))), F.lit(">"))


def write_archives(
    pages: DataFrame,
    folder: str,
    id_column: str = "page_id",
    url: str = "url",
    markup: str = "html",
    min_bytes: int = 0,
    per_archive: int = 1000,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write one record a row into archives of at most ``per_archive`` records below ``folder``.

    Of rows with equal payloads of at least ``min_bytes`` bytes, those with the smallest id are
    responses and the others revisits of that id; smaller payloads are all responses. A null payload
    counts as empty; a null id sorts after all others, and a record without a url has no target. An
    empty table gives archives without records. Other columns are ignored.
    """
    rows = pages.select(
        F.col(id_column).alias("id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(markup).cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", payload_digest(F.col("payload")))
    repeated = stored(
        rows.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first is not null")
        .select("digest", "first"),
        "repeated",
    )
    # While few digests are repeated, they go to the payloads rather than the payloads to them.
    few = repeated.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(repeated) if few else repeated, "digest", "left")
    size = F.octet_length("payload")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END)
    )
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _urn(F.col("id"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _field("WARC-Refers-To", F.when(revisit, _urn(F.col("first")))),
        _field("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _field("Content-Length", F.octet_length("block")),
        F.lit("\r\n"),
        F.col("block"),
    )
    (
        rows.withColumn("block", block)
        .select(record.alias("value"))
        .write.option("lineSep", END)
        .option("maxRecordsPerFile", per_archive)
        .text(folder)
    )


_MAGIC = re.compile(rb"WARC/1\.\d\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)[ \t]*(?=\r\n|\Z)", re.I)


class Candidates(NamedTuple):
    offsets: np.ndarray  # where a record could begin, ascending
    bodies: np.ndarray  # where its block would begin
    successors: np.ndarray  # where the next record would begin; -1 without a valid header


def candidates(data: bytes) -> Candidates:
    """Every place where a record could begin: at the start or after a blank line, with magic."""
    offsets, bodies, successors = [], [], []
    for magic in _MAGIC.finditer(data):
        at = magic.start()
        if at and data[at - 4 : at] != b"\r\n\r\n":
            continue
        body = data.find(b"\r\n\r\n", at) + 4
        length = _LENGTH.search(data, at, body - 4) if body > 3 else None
        after = body + int(length[1]) + 4 if length else -1
        valid = length is not None and data[after - 4 : after] == b"\r\n\r\n"
        offsets.append(at)
        bodies.append(body)
        successors.append(after if valid else -1)
    return Candidates(*(np.array(x, np.int64) for x in (offsets, bodies, successors)))


def reachable(found: Candidates) -> np.ndarray:
    """Mask of the candidates on the chain from offset 0, by pointer jumping."""
    n = len(found.offsets)
    reached = np.zeros(n + 1, bool)
    if not n or found.offsets[0]:
        return reached[:n]
    slot = np.searchsorted(found.offsets, found.successors)
    hit = (slot < n) & (found.offsets[np.minimum(slot, n - 1)] == found.successors)
    jump = np.append(np.where(hit, slot, n), n)  # n: the end
    reached[0] = found.successors[0] >= 0
    steps = 1
    while steps < 2 * n:
        reached[jump[np.flatnonzero(reached)]] = True
        jump = jump[jump]
        steps *= 2
    return reached[:n] & (found.successors >= 0)


def _header(data: bytes, name: bytes) -> str | None:
    found = re.search(rb"\r\n" + name + rb":[ \t]*([^\r\n]*)", data, re.I)
    return found[1].decode() if found else None


def _records(data: bytes) -> Iterator[dict]:
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    found = candidates(data)
    for k in np.flatnonzero(reachable(found)):
        head = data[found.offsets[k] : found.bodies[k] - 2]
        block = data[found.bodies[k] : found.successors[k] - 4]
        http, _, payload = block.partition(b"\r\n\r\n")
        kind = _header(head, b"WARC-Type")
        if kind == "revisit":
            size = int(_header(b"\r\n" + http, b"Content-Length") or 0)
            digest = (_header(head, b"WARC-Payload-Digest") or "").rpartition(":")[2]
            payload = None
        else:
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        yield {
            "record_id": _header(head, b"WARC-Record-ID"),
            "url": _header(head, b"WARC-Target-URI"),
            "record_type": kind,
            "refers_to": _header(head, b"WARC-Refers-To"),
            "payload_bytes": size,
            "payload_digest": digest,
            "payload": payload,
        }


_FIELDS = ("record_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string").split(", ")


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False, glob: str = "*") -> DataFrame:
    """The records that the chain of each archive reaches, with sizes and digests of full payloads.

    An archive is read whole, by one task, and records are made one after another, so the writer's
    ``per_archive`` bounds the memory. Archives may be gzipped. Digests of responses are computed
    from the payload read, those of revisits stand in the record. ``with_payload`` adds the bytes.
    """
    names = [f.split()[0] for f in _FIELDS] + (["payload"] if with_payload else [])
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    kinds = [kinds.get(n, pa.string()) for n in names]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows: list[dict] = []
                for row in _records(archive.as_py()):
                    rows.append(row)
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("content")
    return files.mapInArrow(read, ", ".join(_FIELDS + (["payload binary"] if with_payload else [])))


def page_of(urn: str, kind) -> Column:
    """The page id in a record id; null for an empty one."""
    return F.nullif(F.url_decode(F.regexp_extract(urn, r"^<urn:page:(.*)>$", 1)), F.lit("")).cast(kind)


def round_trip(pages: DataFrame, id_column: str = "page_id", **options) -> DataFrame:
    """Write all pages to archives in the shared folder, read them back, one row a page.

    Columns: id, payload_bytes, payload_digest, record_type, refers_to. See ``write_archives`` for
    nulls and ties; rows that share the smallest id of their payload are all responses.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, "archives")
    write_archives(pages, folder, id_column, **options)
    kind = pages.schema[id_column].dataType
    return read_archives(spark, folder, glob="part-*").select(
        page_of("record_id", kind).alias(id_column),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_of("refers_to", kind).alias("refers_to"),
    )
