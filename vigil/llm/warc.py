"""WARC archives: written as monolithic gzip files, normalised to a gzip member per record with a sidecar offset index, read back.

Spark's own sinks and sources move the bytes, so any store that Spark reaches will do:
- a record is a line of the text sink, CR LF CR LF (the end of a WARC record) its line separator, gzip its codec: the file
  is one gzip stream of WARC records;
- the normaliser reads whole files, inflates each stream once, piece by piece, compresses every record as a member of its
  own and notes where it starts; archive and index of a file are written in one pass, side by side under archive=NAME/;
- the reader takes each record by offset and length out of the index, not by scanning.

Copies: of equal payloads of at least MIN_REVISIT bytes, that with the largest page id is the response, others are revisit
records without payload. Files, and with them tasks, are bounded in bytes by size classes of payloads; the index meets its
archive in as many tasks as the archives have READ_BYTES. Groups of copies are found by a digest aggregate that combines before it shuffles; the table of
digests with copies goes to all tasks only up to BROADCAST_ROWS rows, beyond which Spark joins (and splits hot digests).
Null html is an empty payload; rows with equal page id and payload are both responses; an empty table gives no records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import fresh_path, written

MIN_REVISIT = 1000
BROADCAST_ROWS = 300_000
#: Size classes of payloads: bytes of a payload at most, and records in a file at most, so that a file has no more than 64 MiB
#: unless one record alone has. A file is inflated by one task.
CLASSES = ((16 << 10, 4096), (256 << 10, 256), (4 << 20, 16), (1 << 31, 1))
#: Compressed bytes of archives that a task reads, about.
READ_BYTES = 32 << 20
LEVEL = 4
_END = "\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


#: What the text sink puts after an archive: a gzip member without content, which readers pass over.
EMPTY_MEMBER = _member(b"").decode("latin-1")


def with_copies(pages: DataFrame) -> DataFrame:
    """pages with payload_digest, payload_bytes and refers_to (null for responses)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    known = pages.withColumn("payload_digest", F.sha1(payload)).withColumn("payload_bytes", F.octet_length(payload).cast("long"))
    copies = written(
        known.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest").agg(F.max("page_id").alias("_of"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("payload_digest", "_of"),
        "copies",
    )
    small = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = known.join(F.broadcast(copies) if small else copies, "payload_digest", "left")
    revisit = F.col("_of").isNotNull() & ~F.col("_of").eqNullSafe(F.col("page_id"))
    return joined.withColumn("refers_to", F.when(revisit, F.col("_of"))).drop("_of")


def record(url: Column, html: Column) -> Column:
    """The text of a WARC record without its end; needs page_id, payload_digest, payload_bytes and refers_to."""
    crlf, revisit = F.lit("\r\n"), F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.coalesce(html, F.lit(""))))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")),
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]+", "%0A"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), crlf, crlf, block,
    )


def write_monolithic(pages: DataFrame, path: str) -> None:
    """One gzip stream of WARC records per file; a write for each size class that the pages have."""
    known = with_copies(pages)
    bounds = [0, *(most + 1 for most, _ in CLASSES)]
    octets = F.coalesce(F.octet_length("html"), F.lit(0))
    kinds = [octets.between(bounds[i], bounds[i + 1] - 1) for i in range(len(CLASSES))]
    held = pages.agg(*(F.count_if(c).alias(f"n{i}") for i, c in enumerate(kinds))).first()
    for i, (_, records_at_most) in enumerate(CLASSES):
        if held[i] or not (i or any(held)):  # an empty table still makes an empty folder
            lines = known.where(kinds[i]).select(record(F.col("url"), F.col("html")).alias("value"))
            lines.write.mode("append").option("compression", "gzip").option("lineSep", _END).option("maxRecordsPerFile", records_at_most).text(path)


def _inflated(data: bytes) -> Iterator[bytes]:
    """The content of a gzip file, piece by piece, whatever number of members it has."""
    z = zlib.decompressobj(31)
    while data:
        piece = z.decompress(data, 1 << 20)
        if piece:
            yield piece
        if z.eof:
            data, z = z.unused_data, zlib.decompressobj(31)
        else:
            data = z.unconsumed_tail
            if not piece and not data:
                break


def headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, dict[str, str]]]:
    """(record with its end, its headers) out of a stream of WARC records."""
    held = bytearray()
    more = True
    while more:
        at = held.find(b"\r\n\r\n")
        while at >= 0:
            named = headers(bytes(held[:at]))
            size = at + 4 + int(named.get("content-length", "0")) + 4
            while len(held) < size and (piece := next(pieces, None)) is not None:
                held += piece
            yield bytes(held[:size]), named
            del held[:size]
            at = held.find(b"\r\n\r\n")
        piece = next(pieces, None)
        more = piece is not None
        held += piece or b""


def normalise(spark: SparkSession, path: str, to: str) -> None:
    """Rewrite the monolithic files at path as archives of a member per record under to/archive=NAME/part=warc, with
    to/archive=NAME/part=index beside each: gzipped lines "page id, type, offset, length"."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                archive, index = bytearray(), []
                for whole, named in records(_inflated(content.as_py())):
                    member = _member(whole)
                    index.append(f"{named['warc-record-id'][10:-1]} {named['warc-type']} {len(archive)} {len(member)}\n")
                    archive += member
                if index:
                    short = name.as_py().rpartition("/")[2].partition(".")[0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([short] * 2), pa.array(["warc", "index"]), pa.array([bytes(archive), _member("".join(index).encode())], pa.binary())], ["archive", "part", "value"]
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = files.mapInArrow(run, "archive string, part string, value binary").withColumn("value", F.col("value").cast("string"))
    out.write.partitionBy("archive", "part").option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER).text(to)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the indices under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        number = lambda urn: None if urn[10:-1] == "null" else int(urn[10:-1])
        for batch in batches:
            for content, index in zip(batch.column("content"), batch.column("index"), strict=True):
                archive, rows = memoryview(content.as_py()), []
                for line in b"".join(_inflated(index.as_py())).decode().splitlines():
                    _, kind, offset, length = line.split(" ")
                    whole = zlib.decompress(archive[int(offset) : int(offset) + int(length)], 31)
                    head, _, block = whole[:-4].partition(b"\r\n\r\n")
                    named = headers(head)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, size = named["warc-payload-digest"].removeprefix("sha1:"), int(headers(http)["content-length"])
                    if kind == "response":
                        found = hashlib.sha1(payload).hexdigest()
                        if found != digest or len(payload) != size:
                            raise ValueError(f"record {named['warc-record-id']}: payload and digest differ")
                    rows.append((number(named["warc-record-id"]), size, digest, kind, number(named["warc-refers-to"]) if kind == "revisit" else None))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").load(path)
    if "archive" not in files.columns:  # no records, so no folders
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    size = files.agg(F.sum("length")).first()[0]
    keyed = files.select("archive", "part", "content").repartition(max(1, -(-size // READ_BYTES)), "archive")
    pairs = keyed.where("part = 'warc'").select("archive", "content").join(keyed.where("part = 'index'").select("archive", F.col("content").alias("index")), "archive")
    return pairs.select("content", "index").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as monolithic archives, normalise these, and read the normalised ones through their indices."""
    spark = pages.sparkSession
    raw, tidy = fresh_path(spark, "monolithic"), fresh_path(spark, "archives")
    write_monolithic(pages.select("page_id", "url", "html"), raw)
    normalise(spark, raw, tidy)
    return read_archives(spark, tidy)
