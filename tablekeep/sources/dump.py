"""The dump: ordered SQL text, written as gzip part files, and read back.

Layout of one dump (the object key names a folder)::

    <dump>/000000-header/part-*.txt.gz     header text
    <dump>/000001-<table>/part-*.txt.gz    DROP + CREATE, then INSERT records
    ...
    <dump>/999999-footer/part-*.txt.gz     footer text
    <dump>/_tables/                        table name, folder, column types
    <dump>/complete.marker                 written last

Concatenating every part file in path order gives the single SQL text of the
reference (gzip members may be concatenated). Each table has its own folder,
so a restore of one table reads only that table's files, and part files never
mix tables. Each record is one statement; the text sink ends it with a newline,
which gives the blank line between statements.
"""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from .. import schemas
from ..functions.literals import EXACT, Dialect, from_utc_text
from ..operators import chunks
from ..session import remove_path
from .catalog import column_rows, create_section

HEADER_DIR = "000000-header"
FOOTER_DIR = "999999-footer"
TABLES_DIR = "_tables"
COMPLETE = "complete.marker"


def header_text(generated_iso: str) -> str:
    """Header record (the sink adds the final newline)."""
    return f"{K.DUMP_TITLE}\n{K.DUMP_GENERATED}{generated_iso}\n\n{K.DUMP_SESSION_LINES}"


def footer_text() -> str:
    return K.DUMP_FOOTER


def table_dir(index: int, name: str) -> str:
    safe = re.sub(K.SAFE_NAME_PATTERN, "_", name.encode("utf-8").decode("latin-1")) or "table"
    return f"{index:06d}-{safe}"


def _text_frame(spark: SparkSession, text: str) -> DataFrame:
    """One record in one partition, so it is the first part file of a union."""
    return spark.range(0, 1, 1, 1).select(F.lit(text).alias("value"))


def table_records(df: DataFrame, name: str, size: int = K.DEFAULT_CHUNK_ROWS,
                  key: list[str] | None = None, dialect: Dialect = EXACT) -> DataFrame:
    """``value`` records of one table: its CREATE section, then its INSERTs.

    With ``key`` the chunks follow the exact key order; without, chunks are
    runs of consecutive rows of each partition and nothing is shuffled."""
    spark = df.sparkSession
    create = _text_frame(spark, create_section(name, df.schema))
    if key:
        inserts = chunks.insert_statements(df, name, key, size, dialect, ordered=True).select("value")
    else:
        inserts = chunks.insert_records_streaming(df, name, size, dialect)
    return create.unionByName(inserts)


def dump_lines(tables: dict[str, DataFrame], generated_iso: str, size: int = K.DEFAULT_CHUNK_ROWS,
               keys: dict[str, list[str]] | None = None, dialect: Dialect = EXACT) -> DataFrame:
    """X4 + P1 text: ``table_name, section, chunk_id, value`` for the whole
    dump. Sort by ``(section order, table_name, chunk_id)`` to read it in
    order; with ``keys`` every table is chunked in exact key order."""
    spark = next(iter(tables.values())).sparkSession

    def one_row(table, section, text):
        # a literal record in a single partition
        return spark.range(0, 1, 1, 1).select(F.lit(table).cast("string").alias("table_name"),
                                              F.lit(section).alias("section"),
                                              F.lit(0).cast("long").alias("chunk_id"), F.lit(text).alias("value"))

    parts = [one_row(None, schemas.SECTION_HEADER, header_text(generated_iso))]
    for name in sorted(tables):
        df = tables[name]
        parts.append(one_row(name, schemas.SECTION_CREATE, create_section(name, df.schema)))
        key = (keys or {}).get(name)
        if key:
            ins = chunks.insert_statements(df, name, key, size, dialect)
        else:
            ins = chunks.insert_records_streaming(df, name, size, dialect) \
                .withColumn("chunk_id", F.monotonically_increasing_id())
        parts.append(ins.select(F.lit(name).alias("table_name"),
                                F.lit(schemas.SECTION_INSERT).alias("section"),
                                F.col("chunk_id").cast("long"), "value"))
    parts.append(one_row(None, schemas.SECTION_FOOTER, footer_text()))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dump_size(lines: DataFrame) -> DataFrame:
    """Bytes of the dump text (each record plus its newline). An empty
    dump is an error, as a zero-byte file is."""
    total = F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).cast("long")
    return lines.agg(total.alias("size_bytes")).select(
        F.when(F.col("size_bytes") > 0, F.col("size_bytes"))
        .otherwise(F.raise_error(F.lit("database dump is empty")).cast("long")).alias("size_bytes"))


def _write_text(df: DataFrame, path: str, max_records: int | None, gzip_level: int | None = None):
    w = df.write.mode("errorifexists").option("compression", "gzip")
    if max_records:
        w = w.option("maxRecordsPerFile", str(max_records))
    if gzip_level is not None:  # an option of this write alone
        w = w.option("zlib.compress.level", K.GZIP_LEVELS[gzip_level])
    w.text(path)


def write_dump(tables: dict[str, DataFrame], path: str, generated_iso: str,
               size: int = K.DEFAULT_CHUNK_ROWS, keys: dict[str, list[str]] | None = None,
               dialect: Dialect = EXACT, max_records: int | None = 1_000,
               parallel: int = 8, gzip_level: int | None = None, check=None) -> list[str]:
    """Write the dump under ``path`` (any Hadoop path, ``s3a://`` too).

    The dump is written under a hidden staging name beside ``path``, renamed
    when whole, and marked complete by a last file; listings take only marked
    dumps. On any failure the staging folder is removed and nothing appears.
    ``check(staging path)`` runs before the dump is published and may raise.

    Tables are written by concurrent jobs; each job is a single pass with no
    shuffle unless ``keys`` asks for exact key order. ``max_records`` caps the
    INSERT records per part file (1,000 records of 1,000 rows by default),
    since gzip files cannot be split on read and each file is one restore
    task. ``gzip_level`` 1 to 9 sets the level of this write, else the codec's
    own. An existing path is an error, as two runs in the same second would
    otherwise overwrite each other. Returns the table folders written."""
    if not tables:
        raise ValueError("no tables to export")
    if gzip_level is not None and gzip_level not in K.GZIP_LEVELS:
        raise ValueError("the gzip level is a whole number from 1 to 9")
    spark = next(iter(tables.values())).sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path.rstrip("/"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(f"the dump {path} exists")
    parent, _, name = path.rstrip("/").rpartition("/")
    staging = f"{parent}/_writing-{uuid.uuid4().hex}-{name}"
    published = False
    try:
        written = _write_dump(spark, tables, staging, generated_iso, size, keys, dialect, max_records, parallel, gzip_level)
        if check is not None:
            check(staging)
        if not fs.rename(hadoop.Path(staging), target):
            raise RuntimeError(f"cannot publish the dump {path}")
        published = True
        marker = fs.create(hadoop.Path(f"{path.rstrip('/')}/{COMPLETE}"), False)
        marker.write(bytearray(b"complete\n"))  # listings by Spark pass over empty files
        marker.close()
    except BaseException:
        remove_path(spark, staging)
        if published:
            remove_path(spark, path)
        raise
    return written


def _write_dump(spark, tables, path, generated_iso, size, keys, dialect, max_records, parallel, gzip_level) -> list[str]:
    root = path.rstrip("/")
    names = sorted(tables)
    dirs = {n: table_dir(i + 1, n) for i, n in enumerate(names)}

    meta = []
    for n in names:
        for r in column_rows(n, tables[n].schema):
            meta.append((dirs[n],) + r)
    meta_schema = T.StructType([T.StructField("dir", T.StringType())] + schemas.COLUMNS.fields)
    spark.createDataFrame(meta, meta_schema).coalesce(1).write.mode("errorifexists").json(f"{root}/{TABLES_DIR}")

    _write_text(_text_frame(spark, header_text(generated_iso)), f"{root}/{HEADER_DIR}", None, gzip_level)

    def one(n):
        recs = table_records(tables[n], n, size, (keys or {}).get(n), dialect)
        _write_text(recs, f"{root}/{dirs[n]}", max_records, gzip_level)
        return dirs[n]

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        written = list(pool.map(one, names))
    _write_text(_text_frame(spark, footer_text()), f"{root}/{FOOTER_DIR}", None, gzip_level)
    return written


# --- restore ------------------------------------------------------------------

# A string literal (possessive, so long values do not overflow the regex
# stack), NULL, an empty binary, a hex binary, or a number. Numbers, the most
# frequent, are tried first, after the hex binaries that begin like one.
TOKEN_PATTERN = r"0x[0-9a-fA-F]*+|[-+0-9.eE]++|'[^'\\]*+(?:\\.[^'\\]*+)*+'|NULL|X''"

_UNESCAPES = [("\\0", "\x00"), ("\\n", "\n"), ("\\r", "\r"), ("\\'", "'"), ('\\"', '"'), ("\\Z", "\x1a")]


def unescape_string(body) -> F.Column:
    """Undo the string escape. The body is split on the escaped backslash
    first, so the other escapes are undone in pieces that hold no backslash
    pair, and the pieces are joined with a single backslash. Most bodies hold
    no backslash and are left as they are."""
    parts = F.split(body, r"\\\\", -1)

    def fix(p):
        for esc, raw in _UNESCAPES:
            p = F.replace(p, F.lit(esc), F.lit(raw))
        return p

    return F.when(F.contains(body, F.lit("\\")), F.array_join(F.transform(parts, fix), "\\")).otherwise(body)


def _body(tok) -> F.Column:
    return tok.substr(F.lit(2), F.length(tok) - 2)


def decode_token(tok, dtype: T.DataType) -> F.Column:
    """Typed value of one literal token."""
    if isinstance(dtype, T.BinaryType):
        val = F.when(tok == "X''", F.unhex(F.lit(""))).otherwise(F.unhex(tok.substr(F.lit(3), F.length(tok))))
    elif isinstance(dtype, T.BooleanType):
        val = tok == F.lit("1")
    elif isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                            T.DoubleType, T.DecimalType)):
        val = tok.cast(dtype)
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        val = F.from_json(unescape_string(_body(tok)), dtype)
    elif isinstance(dtype, T.StringType):
        val = unescape_string(_body(tok))
    elif isinstance(dtype, T.TimestampType):
        val = from_utc_text(unescape_string(_body(tok)))
    else:
        val = unescape_string(_body(tok)).cast(dtype)
    return F.when(tok == F.lit(K.NULL_LITERAL), F.lit(None).cast(dtype)).otherwise(val)


def parse_tuples(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed rows from the tuple lines of one table's dump text. A tuple with
    the wrong number of values is an error, not a silent null."""
    toks = F.regexp_extract_all(F.col("value"), F.lit(TOKEN_PATTERN), 0)
    n = len(schema.fields)
    rows = lines.filter(F.col("value").startswith("(")).select(toks.alias("t"))
    checked = rows.select(F.when(F.size("t") == n, F.col("t"))
                          .otherwise(F.raise_error(F.concat(F.lit("bad tuple: "), F.size("t").cast("string"),
                                                            F.lit(f" values, expected {n}")))
                                     .cast("array<string>")).alias("t"))
    return checked.select(*[decode_token(F.get(F.col("t"), i), f.dataType).alias(f.name)
                            for i, f in enumerate(schema.fields)])


def read_tables_meta(spark: SparkSession, path: str) -> DataFrame:
    meta_schema = T.StructType([T.StructField("dir", T.StringType())] + schemas.COLUMNS.fields)
    return spark.read.schema(meta_schema).json(f"{path.rstrip('/')}/{TABLES_DIR}")


def read_dump(spark: SparkSession, path: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """Typed DataFrames of the tables in a dump. The column types come
    from the dump's table list, as a restore takes them from the DDL."""
    meta = read_tables_meta(spark, path).collect()   # one row per column: bounded by the schema
    by_table: dict[str, list] = {}
    for r in meta:
        by_table.setdefault(r.table_name, []).append(r)
    out = {}
    for name, cols in sorted(by_table.items()):
        if tables is not None and name not in tables:
            continue
        cols.sort(key=lambda r: r.ordinal)
        schema = T.StructType([T.StructField(c.name, T._parse_datatype_string(c.spark_type), c.nullable)
                               for c in cols])
        lines = spark.read.text(f"{path.rstrip('/')}/{cols[0].dir}")
        out[name] = parse_tuples(lines, schema)
    return out


def read_dump_text(spark: SparkSession, path: str) -> DataFrame:
    """Every text line of a dump with the folder it came from."""
    return spark.read.option("recursiveFileLookup", "true").text(path) \
        .withColumn("file", F.input_file_name())
