"""One object at the key: a dump's gzip parts as the members of one gzip file.

The object is the parts one after the other, in path order: gzip members may
be concatenated, so ``gunzip`` gives the dump's text. It ends with members
that inflate to nothing and carry, in the extra field of their headers, an
index of all members: table, offset and length. A restore reads the index from
the end of the object and inflates the members in parallel by ranged reads.

Parts are put together without passing the driver: where the file system can
concatenate files (HDFS) by that call, which moves no bytes; in a folder that
is mounted on all machines by tasks that write each part at its offset, which
may be repeated.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import remove_path, ship_package
from . import dump

SUBFIELD = b"TK"
EXTRA_BYTES = 65_000  # of the index in one member; the field holds 65,535
COPY_BYTES = 4 << 20
_TRAILER = struct.Struct("<QQ")  # offset of the index, bytes of its text


def empty_member(payload: bytes) -> bytes:
    """A gzip member of no data with ``payload`` in its extra field."""
    extra = SUBFIELD + struct.pack("<H", len(payload)) + payload
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra + b"\x03\x00" + struct.pack("<II", 0, 0)


def payload_of(member: bytes) -> bytes:
    if member[:4] != b"\x1f\x8b\x08\x04" or member[12:14] != SUBFIELD:
        raise ValueError("this gzip file holds no member index")
    size = struct.unpack("<H", member[14:16])[0]
    return member[16:16 + size]


def index_members(index: dict, offset: int) -> bytes:
    """The members that hold ``index`` from ``offset`` on; the last, of fixed
    size, says where they begin."""
    text = zlib.compress(json.dumps(index, separators=(",", ":")).encode(), 9)
    body = b"".join(empty_member(text[i:i + EXTRA_BYTES]) for i in range(0, len(text), EXTRA_BYTES))
    return body + empty_member(_TRAILER.pack(offset, len(text)))


TRAILER_BYTES = len(empty_member(_TRAILER.pack(0, 0)))


def _filesystem(path: str):
    from pyarrow import fs as pafs
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def read_index(path: str) -> dict:
    """The member index of a single object."""
    files, name = _filesystem(path)
    with files.open_input_file(name) as f:
        size = f.size()
        offset, length = _TRAILER.unpack(payload_of(f.read_at(TRAILER_BYTES, size - TRAILER_BYTES)))
        data, text = f.read_at(size - TRAILER_BYTES - offset, offset), b""
    at = 0
    while at < len(data):
        part = payload_of(data[at:at + 16 + EXTRA_BYTES])
        text += part
        at += len(empty_member(b"")) + len(part)
    if len(text) != length:
        raise ValueError("the member index is damaged")
    return json.loads(zlib.decompress(text))


def compose(spark: SparkSession, dump_path: str, target: str) -> int:
    """Make the dump folder ``dump_path`` the single object ``target`` (a new
    path) and remove the folder. Returns the object's bytes. The driver lists
    the parts, one path and length each."""
    root = dump_path.rstrip("/")
    columns = [r.asDict() for r in dump.read_tables_meta(spark, root).collect()]
    tables = {c["dir"]: c["table_name"] for c in columns}
    jvm = spark._jvm.org.apache.hadoop.fs
    folder = jvm.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(jvm.Path(target)):
        raise FileExistsError(f"the object {target} exists")
    found, listing = [], fs.listFiles(folder, True)
    while listing.hasNext():
        f = listing.next()
        name = f.getPath().toString()
        if name.endswith(".gz") and f.getLen():
            found.append((name, f.getLen()))
    found.sort()
    members, offset = [], 0
    for name, size in found:
        members.append({"table": tables.get(name.split("/")[-2]), "offset": offset, "bytes": size})
        offset += size
    tail = index_members({"members": members, "columns": columns}, offset)
    parent = target.rpartition("/")[0]
    staging = f"{parent}/_writing-{uuid.uuid4().hex}"
    fs.mkdirs(jvm.Path(parent))
    try:
        last = f"{root}/zz-index.gz"
        out = fs.create(jvm.Path(last), False)
        out.write(bytearray(tail))
        out.close()
        if fs.getUri().getScheme() == "file":
            _write_at_offsets(spark, [*found, (last, len(tail))], staging)
        elif fs.hasPathCapability(folder, "fs.capability.paths.concat"):
            fs.create(jvm.Path(staging), False).close()
            paths = spark._sc._gateway.new_array(jvm.Path, len(found) + 1)
            for i, (name, _) in enumerate([*found, (last, 0)]):
                paths[i] = jvm.Path(name)
            fs.concat(jvm.Path(staging), paths)
        else:
            raise NotImplementedError(f"{fs.getUri()} can neither concatenate files nor write at an offset; keep the dump as a folder")
        if not fs.rename(jvm.Path(staging), jvm.Path(target)):
            raise RuntimeError(f"cannot publish {target}")
    except BaseException:
        remove_path(spark, staging)
        raise
    remove_path(spark, root)
    return offset + len(tail)


def _write_at_offsets(spark: SparkSession, parts: list[tuple[str, int]], target: str) -> None:
    rows, offset = [], 0
    for name, size in parts:
        rows.append((name, offset))
        offset += size
    out = _filesystem(target)[1]
    with open(out, "wb") as f:
        f.truncate(offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with open(out, "r+b") as f:
                for name, at in zip(*[c.to_pylist() for c in batch.columns]):
                    f.seek(at)
                    with open(_filesystem(name)[1], "rb") as part:
                        while data := part.read(COPY_BYTES):
                            f.write(data)
            yield pa.RecordBatch.from_arrays([batch.column(1)], names=["done"])
    ship_package(spark)
    plan = _dealt(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, name string, at long"), min(len(rows), 1000))
    plan.mapInArrow(run, "done long").count()


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows numbered by ``i`` in so many tasks, as many in each: dealt in turn
    from where each task happens to begin, some tasks would get several of few
    long members."""
    return rows.repartitionById(parts, F.col("i").cast("int")).drop("i")


def member_rows(spark: SparkSession, path: str, index: dict) -> DataFrame:
    """``table, offset, bytes`` of the members with rows, spread over tasks."""
    rows = [(i, m["table"], m["offset"], m["bytes"]) for i, m in enumerate(m for m in index["members"] if m["table"])]
    return _dealt(spark.createDataFrame(rows, "i long, table string, offset long, bytes long"), max(1, min(len(rows), 10_000)))


def inflate_lines(members: DataFrame, path: str) -> DataFrame:
    """``table, value``: the text lines of members, each read by its range and
    inflated a piece at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, name = _filesystem(path)
        with files.open_input_file(name) as f:
            for batch in batches:
                for table, offset, size in zip(*[c.to_pylist() for c in batch.columns]):
                    inflate, rest, at = zlib.decompressobj(31), b"", offset
                    while at < offset + size:
                        data = f.read_at(min(COPY_BYTES, offset + size - at), at)
                        if not data:
                            raise EOFError(f"{path} ends within a member")
                        at += len(data)
                        while data:
                            piece = inflate.decompress(data)
                            data = inflate.unused_data
                            if inflate.eof:
                                inflate = zlib.decompressobj(31)
                            lines = (rest + piece).split(b"\n")
                            rest = lines.pop()
                            if lines:
                                yield pa.RecordBatch.from_arrays([pa.array([table] * len(lines)), pa.array([x.decode() for x in lines])],
                                                                 names=["table", "value"])
                    if rest:
                        yield pa.RecordBatch.from_arrays([pa.array([table]), pa.array([rest.decode()])], names=["table", "value"])
    ship_package(members.sparkSession)
    return members.mapInArrow(run, "table string, value string")


def read_object(spark: SparkSession, path: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """Typed DataFrames of the tables in a single object."""
    index = read_index(path)
    by_table: dict[str, list[dict]] = {}
    for c in index["columns"]:
        by_table.setdefault(c["table_name"], []).append(c)
    out = {}
    for name, cols in sorted(by_table.items()):
        if tables is None or name in tables:
            cols.sort(key=lambda c: c["ordinal"])
            schema = T.StructType([T.StructField(c["name"], T._parse_datatype_string(c["spark_type"]), c["nullable"]) for c in cols])
            members = member_rows(spark, path, {"members": [m for m in index["members"] if m["table"] == name]})
            out[name] = dump.parse_tuples(inflate_lines(members, path).filter(F.col("table") == name).select("value"), schema)
    return out
