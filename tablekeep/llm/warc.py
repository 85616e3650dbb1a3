"""WARC archives: writing pages, and the monolithic gzip normaliser.

- ``write_archives`` writes a record per page with Spark's own text writer:
  the writer's line separator is the record separator, and its gzip codec
  makes each file one monolithic gzip stream of many records. Of pages with
  equal payloads, the one with the largest id is written in full; the others
  are revisit records that refer to it.
- ``normalise`` inflates each monolithic file once, as a stream, and writes
  every record as a gzip member of its own into a new archive, with a sidecar
  index of where each member lies, so a record can be read alone.
- ``read_archives`` reads the normalised archives back, member by member.

Archives are read with Spark's binary file reader (a file up to 2 GB;
``records_per_file`` keeps them far smaller) and written through the file
system of the output path. A task writes under a name of its own and renames
when done, so a task that is run again leaves the same files.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeep.session import scratch_path, ship_package

from .common import stage

END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # RFC 4648
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20


def base32(hex_digits: Column) -> Column:
    """Bare upper-case base32 of 40 hex digits (a SHA-1): eight groups of 20 bits."""
    def group(i: Column) -> Column:
        value = F.conv(F.substring(hex_digits, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(BASE32), (F.shiftright(value, s).bitwiseAND(F.lit(31)) + 1), F.lit(1)) for s in (15, 10, 5, 0)])
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), group), "")


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page_id, url, payload, payload_bytes, sha1, refers_to, revisit)``.
    Pages with equal payloads of at least ``min_bytes`` revisit the one with
    the largest page_id."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    # who refers to whom is settled on ids and digests; the payloads do not pass the shuffle of a hot digest
    ids = stage(rows.select("page_id", "sha1", "payload_bytes"), "payload-digests")
    top = ids.groupBy("sha1").agg(F.max("page_id").alias("top"))
    known = (ids.distinct().join(top, "sha1")
             .filter((F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("top")))
             .select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), F.col("top").alias("refers_to")))
    return (rows.join(known, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha1") == F.col("_sha1")), "left")
            .withColumn("revisit", F.col("_sha1").isNotNull()).drop("_id", "_sha1"))


def record_text(rows: DataFrame) -> Column:
    """The bytes of a record without its end, as a string column: WARC header,
    HTTP header and, for a response, the payload."""
    def name(page: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(END))
    body = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload"))
    # control characters and blanks in a URL would break the header: percent-encode
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), r"[\x00-\x20\x7f]", "%20")
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.lit(f"\r\nWARC-Date: {DATE}"), F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("sha1")),
        F.when(F.col("revisit"), F.concat(F.lit("\r\nWARC-Refers-To: "), name(F.col("refers_to")), F.lit(f"\r\nWARC-Profile: {PROFILE}")))
        .otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.octet_length(body)).cast("string"), F.lit(END))
    return F.concat(header.cast("binary"), http.cast("binary"), body).cast("string")


#: Bounds of a file's content: this many records, and about this many bytes
#: (one record may be larger). Readers take a file whole, below 2 GB.
RECORDS_PER_FILE = 5000
FILE_BYTES = 400 << 20
HEADER_BYTES = 4096  # of a record besides its payload, about


def size_classes(largest: int, file_bytes: int = FILE_BYTES, records: int = RECORDS_PER_FILE) -> list[tuple[int, int, int]]:
    """``(from, below, records per file)``: payload sizes in classes so that
    as many records as a file takes stay within its bytes. The first class is
    of those of which a full file of records fits."""
    out, low, high = [], 0, max(1, file_bytes // records - HEADER_BYTES)
    while True:
        out.append((low, high, max(1, min(records, file_bytes // (high + HEADER_BYTES)))))
        if high > largest:
            return out
        low, high = high, high * 8


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Write the pages as monolithic gzip WARC files under ``path``: files are
    cut by records and by bytes, pages of similar size together."""
    rows = page_records(pages, min_bytes)
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    for low, below, records in size_classes(largest, file_bytes, records_per_file):
        part = rows.filter((F.col("payload_bytes") >= low) & (F.col("payload_bytes") < below)) if largest else rows
        (part.select(record_text(part).alias("value")).write.mode("append").option("compression", "gzip").option("lineSep", END)
         .option("maxRecordsPerFile", records).text(path))


_LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)[ \t]*$", re.I | re.M)


def inflate(data: bytes) -> Iterator[bytes]:
    """Pieces of the content of a gzip file of one or more members."""
    view, engine = memoryview(data), zlib.decompressobj(31)
    at = 0
    while at < len(view):
        piece = engine.decompress(view[at:at + CHUNK])
        at += CHUNK
        if piece:
            yield piece
        while engine.eof:
            rest = engine.unused_data
            if not rest:
                if at >= len(view):
                    return
                engine = zlib.decompressobj(31)
                break
            engine = zlib.decompressobj(31)
            piece = engine.decompress(rest)
            if piece:
                yield piece
    if not engine.eof and at and len(view):
        raise ValueError("truncated gzip stream")


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Records (with their end) of a stream of WARC records; holds one record
    and a piece at a time."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(END.encode())
                if end < 0:
                    break
                length = _LENGTH.search(bytes(held[:end]).replace(b"\r\n", b"\n"))
                if not held.startswith(b"WARC/") or length is None:
                    raise ValueError("not a WARC record")
                need = end + len(END) + int(length[1]) + len(END)
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("truncated WARC record")


def parse_record(record: bytes) -> dict:
    """Header fields and payload of a record."""
    head, _, rest = record.partition(END.encode())
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        fields[key.strip().lower()] = value.strip()
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(END.encode())
    length = _LENGTH.search(http.replace(b"\r\n", b"\n"))

    def page(urn: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(found[1]) if found else None
    return {"page_id": page(fields.get("warc-record-id")), "record_type": fields["warc-type"], "url": fields.get("warc-target-uri"),
            "payload": payload, "payload_bytes": int(length[1]) if length else len(payload),
            "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "refers_to": page(fields.get("warc-refers-to"))}


INDEX = "archive string, offset long, length long, record_type string, page_id long, payload_digest string"


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def normalise(spark: SparkSession, source: str, target: str, level: int = 6) -> DataFrame:
    """Rewrite the archives under ``source`` to ``target``/archives with every
    record as its own gzip member; write and return the sidecar index
    (``target``/index): archive, offset, length, type, page and digest of
    every record."""
    ship_package(spark)
    out = f"{target}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                fs, root = _file_system(out)
                fs.create_dir(root, recursive=True)
                name = re.sub(r"(\.txt)?\.gz$", "", posixpath.basename(path)) + ".warc.gz"
                draft = posixpath.join(root, f".{name}.{uuid.uuid4().hex}")
                rows: list[tuple] = []
                at = 0
                with fs.open_output_stream(draft, compression=None) as sink:
                    for record in split_records(inflate(content.as_py())):
                        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = packer.compress(record) + packer.flush()
                        sink.write(member)
                        got = parse_record(record)
                        rows.append((name, at, len(member), got["record_type"], got["page_id"], got["payload_digest"]))
                        at += len(member)
                fs.move(draft, posixpath.join(root, name))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6,
                                                    (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()))],
                    names=[f.split()[0] for f in INDEX.split(", ")])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "content")
    files.mapInArrow(run, INDEX).write.parquet(f"{target}/index")
    return spark.read.schema(INDEX).parquet(f"{target}/index")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, offset, length, page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, payload_ok)`` of every member of the archives
    under ``path``. ``payload_ok``: the payload of a response has the size and
    digest its header states."""
    ship_package(spark)
    fields = ("archive string, offset long, length long, page_id long, url string, payload_bytes long, payload_digest string, "
              "record_type string, refers_to long, payload_ok boolean")
    names = [f.split()[0] for f in fields.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = memoryview(content.as_py())
                rows: list[dict] = []
                at = 0
                while at < len(data):
                    engine, record, to = zlib.decompressobj(31), [], at
                    while not engine.eof and to < len(data):
                        record.append(engine.decompress(data[to:to + (1 << 16)]))
                        to += 1 << 16
                    if not engine.eof:
                        raise ValueError(f"truncated member in {file}")
                    end = min(to, len(data)) - len(engine.unused_data)
                    row = parse_record(b"".join(record))
                    payload = row.pop("payload")
                    row["payload_ok"] = row["record_type"] != "response" or (
                        len(payload) == row["payload_bytes"]
                        and base64.b32encode(hashlib.sha1(payload).digest()).decode() == row["payload_digest"])
                    rows.append(row | {"archive": posixpath.basename(file), "offset": at, "length": end - at})
                    at = end
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[f.split()[1]])
                                                  for n, f in zip(names, fields.split(", "))], names=names)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(run, fields)


def read_record(path: str, offset: int, length: int) -> dict:
    """One record of a normalised archive, by the index."""
    fs, file = _file_system(path)
    with fs.open_input_file(file) as f:
        f.seek(offset)
        return parse_record(zlib.decompress(f.read(length), 31))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages as archives in the shared folder, normalise them, read
    them back.

    A null html is an empty payload, a null url has no header field; a null
    page_id is written as no number and read back null. Equal rows are equal
    records. Empty tables give an empty result; other columns are ignored,
    whatever their names.
    """
    spark = pages.sparkSession
    home = scratch_path(spark, "warc")
    write_archives(pages, f"{home}/monolithic", min_bytes)
    normalise(spark, f"{home}/monolithic", f"{home}/normalised")
    try:
        return read_archives(spark, f"{home}/normalised/archives")
    except Exception as error:  # no archive at all: the table was empty
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "archive string, offset long, length long, page_id long, url string, payload_bytes long, "
                                     "payload_digest string, record_type string, refers_to long, payload_ok boolean")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([32768, 1024, 32, 1], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(hex, i * 5 + 1, 5) AS BIGINT) // s) % 32 + 1)::INT, 1)), '')), '')
    AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM t"""
