"""WARC archives of pages, with revisit records in the place of payloads that another record holds already."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import batched, joined, scratch, table, written

#: Payloads under this many bytes always stay responses: a revisit record would be no shorter.
MIN_BYTES = 100
#: Records in one archive at most, and the bytes of payloads that its records have on average at most. A reader holds one
#: archive as it is, compressed, and one record.
RECORDS_PER_FILE, ARCHIVE_BYTES = 4000, 256 << 20
#: The date of fresh headers; a parameter of write_archives(), fixed by default so that runs agree.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a record that one gzip member holds. A member ends with the size of what it holds, whose last byte is zero up to
#: 16 MB: the text sink, which can't write values without something between them, writes that byte at a record's end.
MEMBER = (1 << 24) - 1

_SCAN = "path string, place int, record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary"
_ARROW = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}[t]) for n, t in (x.split() for x in _SCAN.split(", "))])


def _record(date: str, record_id: str | None, record_type: str, url: str | None, payload_bytes: int, payload_digest: str, refers_to: str | None, payload: bytes) -> bytes:
    """A record as gzip members without the very last byte: WARC headers, and for a response an HTTP head and the payload."""
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    revisit = record_type == "revisit"
    body = f"{http}\r\n".encode() + (b"" if revisit else payload)
    lines = [("WARC-Type", record_type), ("WARC-Record-ID", record_id and f"<urn:x-record:{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", url and re.sub(r"[\r\n]+", " ", url)), ("WARC-Payload-Digest", f"sha256:{payload_digest}"), ("X-Payload-Length", payload_bytes), ("WARC-Refers-To", refers_to and f"<urn:x-record:{refers_to}>"), ("WARC-Profile", PROFILE if revisit else None), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(body))]
    whole = b"WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in lines if value is not None).encode() + b"\r\n" + body + b"\r\n\r\n"
    out = []
    for at in range(0, len(whole), MEMBER):
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += [pack.compress(whole[at : at + MEMBER]), pack.flush()]
    out[-1] = out[-1][:-1]
    return b"".join(out)


def _write(rows: DataFrame, members: Callable[[Iterator[pa.RecordBatch]], Iterator[bytes]], path: str, records: int) -> None:
    """Write the records of ``rows`` as archives of so many or fewer. A record is one value of the sink, whatever its gzip members, so that files
    end between records; the sink's separator is its last byte.

    The sink names files .txt, as it knows nothing of what they hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for member in members(batches):
            held.append(member)
            size += len(member)
            if size > 1 << 20 or len(held) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.options(lineSep="\0", maxRecordsPerFile=records).text(path)


def write_archives(records: DataFrame, path: str, date: str = DATE) -> None:
    """Write records (record_id, record_type, url, payload_bytes, payload_digest, refers_to, payload) as gzipped archives.

    Each record is a gzip member of its own, as readers of archives expect that seek; revisit records carry no payload, but
    the length and digest of the one they stand for.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _record(date, **row)

    columns = ("record_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to", "payload")
    _write(batched(records.select(*columns)), members, path, _records_per_file(records))


def _records_per_file(records: DataFrame) -> int:
    size = records.agg(F.count("*").alias("n"), F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("bytes")).first()
    return max(1, min(RECORDS_PER_FILE, ARCHIVE_BYTES * size["n"] // max(1, size["bytes"])))


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives under ``path``, with the file and place of each; without ``payloads`` that column is null
    and only headers travel."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for place, row in enumerate(_records(content.as_buffer())):
                    rows.append(row | {"path": name, "place": place, "payload": row["payload"] if payloads else None})
                    size += row["payload_bytes"] if payloads else 0
                    if len(rows) >= 500 or size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return batched(_files(spark, path)).select("path", "content").mapInArrow(scan, _SCAN)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def _inflated(archive: memoryview) -> Iterator[bytes]:
    """What the gzip members of an archive hold, one after another."""
    at = 0
    while at < len(archive):
        unpack, out, step = zlib.decompressobj(31), [], 1 << 16
        while not unpack.eof and at < len(archive):
            part = archive[at : at + step]
            out.append(unpack.decompress(part))
            at += len(part) - len(unpack.unused_data)
        if not unpack.eof:
            raise ValueError("the archive ends inside a gzip member")
        yield b"".join(out)


def _records(archive: memoryview) -> Iterator[dict]:
    """Records one after another, found by the length that each header states and checked against its digest."""
    held, bare = b"", lambda x: x and x.removeprefix("<urn:x-record:").removesuffix(">")
    for part in _inflated(memoryview(archive)):
        held = held + part if held else part
        if (end := held.find(b"\r\n\r\n")) < 0:
            continue
        head = dict(x.split(": ", 1) for x in held[:end].decode().split("\r\n")[1:])
        start, size = end + 4, int(head["Content-Length"])
        if len(held) < start + size + 4:  # a record of more than one member
            continue
        body, held = held[start : start + size], b""
        payload, digest = body[body.index(b"\r\n\r\n") + 4 :], head["WARC-Payload-Digest"].removeprefix("sha256:")
        if head["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"record {head.get('WARC-Record-ID')} doesn't hold the payload of its digest")
        yield {"record_id": bare(head.get("WARC-Record-ID")), "record_type": head["WARC-Type"], "url": head.get("WARC-Target-URI"), "payload_bytes": int(head["X-Payload-Length"]), "payload_digest": digest, "refers_to": bare(head.get("WARC-Refers-To")), "payload": payload}
    if held:
        raise ValueError("the archive ends inside a record")


def resolve_revisits(headers: DataFrame, order: Column, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``headers`` with refers_to, for each that repeats the payload of one that comes first in ``order``.

    Headers alone are shuffled by digest, and summed up before that; those of a payload with very many copies aren't dealt
    to one task. Rows without a rank, or of the first one's rank, repeat nothing.
    """
    heads = headers.where(F.col("payload_bytes") >= min_bytes).drop("refers_to", "payload").withColumn("rank", order)
    first = heads.groupBy("payload_digest").agg(F.min("rank").alias("first_rank"), F.min_by("record_id", "rank").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    return joined(heads, first, "payload_digest", "copies").where("rank > first_rank").drop("rank", "first_rank")


def page_records(pages: DataFrame) -> DataFrame:
    """A response record for each page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("string").alias("record_id"), F.lit("response").alias("record_type"), F.col("url").cast("string").alias("url"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"), F.lit(None).cast("string").alias("refers_to"), payload.alias("payload"))


def deduplicated(spark: SparkSession, path: str, out: str, date: str = DATE) -> None:
    """Read the archives under ``path`` and write them under ``out`` with revisit records, all with fresh headers.

    What is decided by headers goes to the archives, a row for each with the places of its revisits, and each archive is
    written anew in the task that has it. Payloads are never dealt out by a key; archives are, compressed as they are, where
    the decisions are too many for a broadcast. Without archives nothing is written; null ids and repeats: see
    op2_warc_revisits().
    """
    headers = written(read_archives(spark, path, payloads=False).drop("payload"), "headers")
    again = resolve_revisits(headers, F.col("record_id").cast("long"))
    decided = again.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("place", "refers_to"))).alias("places"))  # RECORDS_PER_FILE at most

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for content, places in zip(batch.column(0), batch.column(1).to_pylist()):
                places = dict(places or ())
                for place, row in enumerate(_records(content.as_buffer())):
                    found = {"record_type": "revisit", "refers_to": places[place]} if place in places else {"record_type": "response", "refers_to": None}
                    yield _record(date, **(row | found))

    files = _files(spark, path).select("path", "content").join(written(decided, "revisits"), "path", "left").select("content", "places")
    _write(batched(files), members, out, _records_per_file(headers))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, archives, revisits resolved, new archives, and what stands in those.

    Null html: an empty payload. Null urls stay out of the header. Null page_id: a record without an id, whose payload
    others may hold and which is never referred to while a page with an id has the same one. A repeated page_id: each row is
    a record, and those with the least id of their payload are all responses. An empty table: no rows. Other columns are
    ignored, whatever their names. A payload may be as long as a value of Spark's: its record is several gzip members, in one archive, and is
    held whole by the task that writes or reads it. An archive that ends inside a record is an error.
    """
    raw, out = scratch(spark, "warc-raw"), scratch(spark, "warc")
    write_archives(page_records(table(spark, sf_dir, "pages")), raw)
    deduplicated(spark, raw, out)
    found = read_archives(spark, out, payloads=False)
    return found.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "url")
