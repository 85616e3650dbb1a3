"""The registered queries: one per operator of the inventory, each as a Spark
callable ``(spark, sf_dir) -> DataFrame`` with, where SQL can express it, the
equivalent SQL over the same tables (DuckDB dialect) for cross-checking.

Every query reads whole tables (or tables derived from them by ``derived``);
none samples, caps or filters rows to make the check cheaper.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import dates, hashing, keys, labels, literals, numbers
from ..functions.literals import PLAIN10
from ..operators import chunks, digest, history as hist, retention, verify
from ..session import ensure_checkpoint_dir, scratch_path
from ..sources import catalog, dump, history_store, objects
from . import derived, reports
from .derived import HISTORY_SQL, JOBS_SQL, LISTING_SQL, LISTING_TEXT_SQL, SETTINGS_SQL, load

COLUMNS_OF = {
    "benchmark": ["item_id", "text"], "conversations": ["conv_id", "turn", "role", "text"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"], "embeddings": ["vec_id", "embedding", "label"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"], "labels": ["doc_id", "quality", "toxic"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                 "l_returnflag", "l_linestatus", "l_shipdate"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "pages": ["page_id", "url", "html"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "region": ["r_regionkey", "r_name"], "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]}
TABLES = ["benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels",
          "lineitem", "nation", "orders", "pages", "part", "region", "supplier"]
NOW = "2024-01-15 12:00:00"
KEEP = 5
PREFIX = "site"


def _prep(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)


def _src(spark, d) -> catalog.ParquetDirSource:
    return catalog.ParquetDirSource(spark, d.rstrip("/"))


def _tables(spark, d, names) -> dict[str, DataFrame]:
    return {n: load(spark, d, n) for n in names}


# --- SQL building blocks (DuckDB) ---------------------------------------------

def sql_escape(x: str) -> str:
    c = x
    c = rf"replace({c}, '\', '\\')"
    c = rf"replace({c}, chr(0), '\0')"
    c = rf"replace({c}, chr(10), '\n')"
    c = rf"replace({c}, chr(13), '\r')"
    c = rf"replace({c}, '''', '\''')"
    c = rf"""replace({c}, '"', '\"')"""
    c = rf"replace({c}, chr(26), '\Z')"
    return c


def sql_str(x: str) -> str:
    return f"('''' || {sql_escape(x)} || '''')"


def sql_null(x: str, rendered: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN 'NULL' ELSE {rendered} END)"


def sql_plain10(x: str) -> str:
    # through the shortest round-trip text, as the Spark side does
    return f"CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,10)) AS VARCHAR)"


def sql_lit(x: str, kind: str) -> str:
    """Literal of column ``x``: kind int | double | str | ts | floats."""
    r = {"int": f"CAST({x} AS VARCHAR)", "double": sql_plain10(x), "str": sql_str(x),
         "ts": sql_str(f"CAST({x} AS VARCHAR)"),
         "floats": "(chr(39) || '[' || array_to_string(list_transform(" + x + ", lambda f: " + sql_plain10("f")
                   + "), ',') || ']' || chr(39))"}[kind]
    return sql_null(x, r)


def sql_tuple(cols: list[tuple[str, str]]) -> str:
    return "('(' || " + " || ', ' || ".join(sql_lit(c, k) for c, k in cols) + " || ')')"


ORDERS_COLS = [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "str"),
               ("o_totalprice", "double"), ("o_orderdate", "ts"), ("o_orderpriority", "str")]
LINEITEM_COLS = [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"),
                 ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"),
                 ("l_tax", "double"), ("l_returnflag", "str"), ("l_linestatus", "str"), ("l_shipdate", "ts")]

SQL_BASENAME = "regexp_extract(rtrim({k}, '/'), '[^/]*$')"


def sql_is_backup_key(k: str, prefix_norm: str = "site/backups/database/") -> str:
    b = SQL_BASENAME.format(k=k)
    return (f"(coalesce({k} <> '' AND starts_with({k}, '{prefix_norm}') AND starts_with({b}, 'db-') "
            f"AND ends_with({b}, '.sql.gz'), false))")


def sql_is_safe_key(bk: str, k: str) -> str:
    b = SQL_BASENAME.format(k=k)
    return (f"(coalesce({bk} <> '' AND {k} <> '' AND (contains({k}, '/backups/database/') "
            f"OR starts_with({k}, 'backups/database/')) AND starts_with({b}, 'db-') AND ends_with({b}, '.sql.gz'), false))")


SQL_NORMALISED_LISTING = f"""
SELECT bucket, key, size_bytes, last_modified FROM ({LISTING_SQL}) l
WHERE {sql_is_backup_key('key')} AND last_modified IS NOT NULL
"""

SQL_RANKED = f"""
SELECT bucket, key, size_bytes, last_modified,
  row_number() OVER (PARTITION BY bucket ORDER BY epoch_us(last_modified) // 1000000 DESC, key DESC) AS rank
FROM ({SQL_NORMALISED_LISTING}) n
"""

# the trimmed characters: blank, tab, LF, CR, NUL, VT
SQL_TRIM_CHARS = "' ' || chr(9) || chr(10) || chr(13) || chr(0) || chr(11)"
SQL_KEEP = (r"(CASE WHEN regexp_full_match(trim({x}, " + SQL_TRIM_CHARS + r"), '\+?[1-9][0-9]*|0') "
            r"THEN coalesce(TRY_CAST(trim({x}, " + SQL_TRIM_CHARS + r") AS BIGINT), 0) ELSE 0 END)")

SQL_SCHEDULE = ("(CASE WHEN regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9_\\-]', '', 'g') IN ('disabled', 'daily') "
                "THEN regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9_\\-]', '', 'g') ELSE 'disabled' END)")

SQL_DISPLAY = "(strftime({t}, '%Y-%m-%d %H:%M') || ' UTC')"
SQL_PARSE_ISO = "try_strptime({x}, '%Y-%m-%dT%H:%M:%S+00:00')"


def sql_history_date(x: str, unparsed: str) -> str:
    p = SQL_PARSE_ISO.format(x=x)
    fb = x if unparsed == "raw" else "'Unknown'"
    return (f"(CASE WHEN coalesce({x}, '') = '' THEN '-' WHEN {p} IS NULL THEN {fb} "
            f"ELSE {SQL_DISPLAY.format(t=p)} END)")


def sql_size_label(x: str) -> str:
    n = f"TRY_CAST(CAST({x} AS VARCHAR) AS DOUBLE)"
    parts = []
    for i in range(len(K.SIZE_UNITS) - 1, -1, -1):
        scale = float(1024 ** i)
        cond = f"{n} >= {scale!r}" if i else f"{n} >= 0"
        parts.append(f"WHEN {cond} THEN format('{{:,}}', CAST(round({n} / {scale!r}) AS BIGINT)) || ' {K.SIZE_UNITS[i]}'")
    return f"(CASE WHEN {n} IS NULL THEN '-' {' '.join(parts)} ELSE '-' END)"


# --- catalogue: S1, S2, S5, G4, C8 -------------------------------------------

def q_table_catalog(spark, d):
    _prep(spark)
    src = _src(spark, d)
    return catalog.list_base_tables(spark, src).join(catalog.table_row_counts(src.tables()), "table_name")


SQL_BASE_TABLES = ("SELECT DISTINCT table_name, 'BASE TABLE' AS table_type FROM information_schema.tables "
                     "WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")")


def q_table_row_counts(spark, d):
    _prep(spark)
    return catalog.table_row_counts(_src(spark, d).tables())


SQL_TABLE_ROW_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES)

SQL_VALUES = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS name, count(*) AS row_count, count({c}) AS value_count FROM {t}"
    for t, cols in COLUMNS_OF.items() for c in cols)

SQL_COLUMNS = """
SELECT DISTINCT table_name, CAST(ordinal_position AS INTEGER) AS ordinal, column_name AS name,
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
    WHEN 'FLOAT' THEN 'float' WHEN 'VARCHAR' THEN 'longtext' WHEN 'TIMESTAMP' THEN 'datetime'
    WHEN 'BLOB' THEN 'longblob' WHEN 'BOOLEAN' THEN 'tinyint' WHEN 'SMALLINT' THEN 'smallint'
    WHEN 'DATE' THEN 'date' ELSE 'json' END AS data_type,
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
    WHEN 'FLOAT' THEN 'float' WHEN 'VARCHAR' THEN 'longtext' WHEN 'TIMESTAMP' THEN 'datetime(6)'
    WHEN 'BLOB' THEN 'longblob' WHEN 'BOOLEAN' THEN 'tinyint(1)' WHEN 'SMALLINT' THEN 'smallint'
    WHEN 'DATE' THEN 'date' ELSE 'json' END AS column_type,
  CASE WHEN data_type = 'VARCHAR' OR data_type LIKE '%[]' THEN 'utf8mb4' END AS character_set,
  is_nullable = 'YES' AS nullable
FROM information_schema.columns WHERE table_name IN (""" + ", ".join(f"'{t}'" for t in TABLES) + ")"


def _row_values(spark, d) -> DataFrame:
    """``table_name, name, row_count, value_count`` of every column: rows and
    non-null values, one aggregate per table."""
    out = None
    for t, df in _src(spark, d).tables().items():
        one = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(c)).alias(c) for c in df.columns])
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value_count")) for c in df.columns]))
        part = one.select(F.lit(t).alias("table_name"), F.col("__rows").alias("row_count"), cells.alias("x")) \
            .select("table_name", "row_count", "x.name", "x.value_count")
        out = part if out is None else out.unionByName(part)
    return out


def q_column_metadata(spark, d):
    _prep(spark)
    cols = catalog.column_metadata(spark, _src(spark, d).tables()).drop("spark_type")
    return cols.join(_row_values(spark, d), ["table_name", "name"])


def q_table_ddl(spark, d):
    _prep(spark)
    src = _src(spark, d)
    return catalog.table_ddl(catalog.column_metadata(spark, src.tables())).join(catalog.table_row_counts(src.tables()), "table_name")


SQL_TABLE_DDL = f"""
SELECT table_name, 'CREATE TABLE `' || replace(table_name, '`', '``') || '` (' || chr(10) ||
  string_agg('  `' || replace(name, '`', '``') || '` ' || column_type ||
             CASE WHEN nullable THEN ' DEFAULT NULL' ELSE ' NOT NULL' END, ',' || chr(10) ORDER BY ordinal)
  || chr(10) || ')' AS ddl
FROM ({SQL_COLUMNS}) c GROUP BY table_name
"""


def q_create_sections(spark, d):
    _prep(spark)
    ddl = q_table_ddl(spark, d)
    return ddl.select("table_name", "row_count", F.concat(F.lit("DROP TABLE IF EXISTS "), literals.quote_identifier("table_name"),
                                             F.lit(";\n"), F.col("ddl"), F.lit(";\n")).alias("value"))


SQL_CREATE_SECTIONS = f"""
SELECT table_name, 'DROP TABLE IF EXISTS `' || replace(table_name, '`', '``') || '`;' || chr(10) || ddl || ';' || chr(10) AS value
FROM ({SQL_TABLE_DDL}) d
"""


# --- scans: S3, S4, F2 ---------------------------------------------------------

def q_table_scan(spark, d):
    _prep(spark)
    return _src(spark, d).load("customer")


def q_ordered_projection(spark, d):
    _prep(spark)
    from ..sources.scan import project_ordered
    return project_ordered(load(spark, d, "customer"), ["c_name", "c_custkey", "c_acctbal"])


def q_row_page(spark, d):
    _prep(spark)
    from ..sources.scan import row_page
    return row_page(load(spark, d, "customer"), ["c_custkey"], 50, 100)


# --- literals: C1-C7 -----------------------------------------------------------

def q_literal_string(spark, d):
    _prep(spark)
    doc = load(spark, d, "documents")
    return doc.select("doc_id", literals.or_null("text", literals.string_literal("text")).alias("lit"))


def q_literal_binary(spark, d):
    _prep(spark)
    doc = load(spark, d, "documents")
    return doc.select("doc_id", literals.or_null("text", literals.binary_literal(F.encode("text", "UTF-8"))).alias("lit"))


def q_literal_numeric(spark, d):
    _prep(spark)
    li = load(spark, d, "lineitem")
    out = [F.col("l_orderkey"), F.col("l_linenumber")]
    for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]:
        out.append(literals.literal(li.schema[c], PLAIN10).alias(c + "_lit"))
    out.append(literals.numeric_literal(F.col("l_partkey").cast("string")).alias("partkey_lit"))
    return li.select(*out)


def q_literal_null(spark, d):
    _prep(spark)
    doc = load(spark, d, "documents").select("doc_id")
    lab = load(spark, d, "labels")
    j = doc.join(lab, "doc_id", "left")
    return j.select("doc_id", literals.literal(lab.schema["quality"]).alias("quality_lit"),
                    literals.literal(lab.schema["toxic"]).alias("toxic_lit"))


def q_typed_cells(spark, d):
    _prep(spark)
    return literals.typed_cells(load(spark, d, "orders"), PLAIN10)


def q_row_tuples(spark, d):
    _prep(spark)
    li = load(spark, d, "lineitem")
    return literals.row_tuples(li, PLAIN10, keep=["l_orderkey", "l_linenumber"])


def q_quote_identifier(spark, d):
    _prep(spark)
    return load(spark, d, "part").select("p_partkey", literals.quote_identifier("p_name").alias("quoted"))


# --- chunks and dump text: W1, G3, G5, G6, X4, C9 ------------------------------

def q_chunk_profile(spark, d):
    _prep(spark)
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    ch = chunks.with_chunks(li, ["l_orderkey", "l_linenumber"], 1000)
    return ch.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("row_count"),
                                      F.min("l_orderkey").alias("first_orderkey"),
                                      F.max("l_orderkey").alias("last_orderkey"))


SQL_CHUNK_PROFILE = """
SELECT chunk_id, count(*) AS row_count, min(l_orderkey) AS first_orderkey, max(l_orderkey) AS last_orderkey
FROM (SELECT l_orderkey, (row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1) // 1000 AS chunk_id FROM lineitem) t
GROUP BY chunk_id
"""


def q_insert_statements(spark, d):
    _prep(spark)
    return chunks.insert_statements(load(spark, d, "orders"), "orders", ["o_orderkey"], 1000, PLAIN10)


def _sql_inserts(table: str, cols, key: list[str], size: int = 1000) -> str:
    header = f"INSERT INTO `{table}` (" + ", ".join(f"`{c}`" for c, _ in cols) + ") VALUES"
    return f"""
SELECT chunk_id, '{header}' || chr(10) || string_agg(tup, ',' || chr(10) ORDER BY rn) || ';' || chr(10) AS value
FROM (SELECT rn, (rn - 1) // {size} AS chunk_id, tup
      FROM (SELECT row_number() OVER (ORDER BY {', '.join(key)}) AS rn, {sql_tuple(cols)} AS tup FROM {table}) u) t
GROUP BY chunk_id
"""


SQL_INSERT_STATEMENTS = _sql_inserts("orders", ORDERS_COLS, ["o_orderkey"])

GENERATED = "2024-01-15T12:00:00+00:00"
#: The literal kind of every column, and a unique key, of every table.
KINDS = {
    "benchmark": ("int str", ["item_id"]), "conversations": ("int int str str", ["conv_id", "turn"]),
    "customer": ("int str int double str", ["c_custkey"]), "documents": ("int str str str int", ["doc_id"]),
    "embeddings": ("int floats int", ["vec_id"]), "events": ("int ts int str double str", ["event_id"]),
    "labels": ("int int int", ["doc_id"]),
    # order and line number repeat in the test data: equal ones go by all columns
    "lineitem": ("int int int int double double double double str str ts",
                 ["l_orderkey", "l_linenumber", *[c for c in COLUMNS_OF["lineitem"] if c not in ("l_orderkey", "l_linenumber")]]),
    "nation": ("int str int", ["n_nationkey"]), "orders": ("int int str double ts str", ["o_orderkey"]),
    "pages": ("int str str", ["page_id"]), "part": ("int str str str int double", ["p_partkey"]),
    "region": ("int str", ["r_regionkey"]), "supplier": ("int str int double", ["s_suppkey"])}
KEYS = {t: k for t, (_, k) in KINDS.items()}


def sql_digest(texts: str) -> str:
    """``rows, content`` (see ``operators/digest``) of the texts ``t`` of a sub-select."""
    sums = ", ".join(f"CAST(coalesce(sum(CAST(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT) AS HUGEINT)), 0) AS VARCHAR)" for i in range(4))
    return f"SELECT count(*) AS rows, concat_ws(':', CAST(count(*) AS VARCHAR), {sums}) AS content FROM (SELECT sha256(t) AS h FROM ({texts}) x) y"


def sql_tuples(table: str, salt: str = "") -> str:
    return f"SELECT '{salt}' || {sql_tuple(list(zip(COLUMNS_OF[table], KINDS[table][0].split())))} AS t FROM {table}"


#: Rows and digest of the whole database, every row marked with its table.
SQL_DB_CONTENT = sql_digest(" UNION ALL ".join(sql_tuples(t, t) for t in TABLES))


def _contents(spark, listing: DataFrame) -> DataFrame:
    """``key, rows, content`` of every dump in a listing of a few, from its
    restored tables: a dump with a wrong, lost or repeated row shows."""
    out = spark.createDataFrame([], "key string, rows long, content string")
    for r in listing.select("key", "path").collect():
        one = digest.database_digest(dump.read_dump(spark, r.path), PLAIN10)
        out = out.unionByName(one.select(F.lit(r.key).alias("key"), "rows", "content"))
    return out


def _dump_in_key_order(spark, d):
    return dump.dump_lines(_tables(spark, d, TABLES), GENERATED, 1000, KEYS, PLAIN10)


def q_dump_lines(spark, d):
    _prep(spark)
    return _dump_in_key_order(spark, d)


def _sql_dump_lines() -> str:
    header = (f"'{K.DUMP_TITLE}' || chr(10) || '{K.DUMP_GENERATED}{GENERATED}' || chr(10) || chr(10) || "
              f"'SET NAMES utf8mb4;' || chr(10) || 'SET FOREIGN_KEY_CHECKS=0;' || chr(10)")
    parts = [f"SELECT CAST(NULL AS VARCHAR) AS table_name, 0 AS section, CAST(0 AS BIGINT) AS chunk_id, {header} AS value"]
    parts.append(f"SELECT table_name, 1 AS section, CAST(0 AS BIGINT) AS chunk_id, value FROM ({SQL_CREATE_SECTIONS}) c")
    for t, (kinds, key) in KINDS.items():
        cols = list(zip(COLUMNS_OF[t], kinds.split()))
        parts.append(f"SELECT '{t}' AS table_name, 2 AS section, CAST(chunk_id AS BIGINT) AS chunk_id, value "
                     f"FROM ({_sql_inserts(t, cols, key)}) i")
    parts.append(f"SELECT CAST(NULL AS VARCHAR), 3, CAST(0 AS BIGINT), '{K.DUMP_FOOTER}'")
    return " UNION ALL ".join(parts)


SQL_DUMP_LINES = _sql_dump_lines()


def q_dump_size(spark, d):
    _prep(spark)
    return dump.dump_size(_dump_in_key_order(spark, d))


SQL_DUMP_SIZE = f"SELECT CAST(sum(strlen(value) + 1) AS BIGINT) AS size_bytes FROM ({SQL_DUMP_LINES}) x"


# --- keys: C10-C16, D1, A1, F3, F4 --------------------------------------------

def q_safe_name(spark, d):
    _prep(spark)
    return load(spark, d, "documents").select("doc_id", keys.safe_name("text").alias("safe"))


SQL_SAFE_NAME = """
SELECT doc_id, CASE WHEN coalesce(s, '') = '' THEN 'database' ELSE s END AS safe FROM (
  SELECT doc_id, array_to_string(list_transform(string_split(text, ''),
    lambda c: CASE WHEN regexp_full_match(c, '[A-Za-z0-9._-]') THEN c ELSE repeat('_', octet_length(encode(c))) END), '') AS s
  FROM documents) t
"""


def _odd_url() -> F.Column:
    """URLs with the white space around them that settings forms send."""
    url, i = F.col("url"), F.col("page_id")
    return (F.when(i % 3 == 0, F.concat(F.lit("\t/"), url, F.lit("/\r\n")))
            .when(i % 3 == 1, F.concat(F.lit(" "), url, F.lit("\x00"))).otherwise(url))


def q_prefix_normalise(spark, d):
    _prep(spark)
    return load(spark, d, "pages").select("page_id", keys.normalise_prefix(_odd_url()).alias("prefix"))


def q_key_normalise(spark, d):
    _prep(spark)
    return load(spark, d, "pages").select("page_id", keys.normalise_key(_odd_url()).alias("key"))


def q_backup_key(spark, d):
    _prep(spark)
    ev = load(spark, d, "events")
    prefix = F.when(ev.event_id % 3 == 0, F.lit("")).when(ev.event_id % 3 == 1, F.lit(" /site/ ")).otherwise(F.lit("0"))
    name = F.concat(ev.event_type, F.lit(" #"), ev.user_id.cast("string"))
    return ev.select("event_id", keys.backup_key(prefix, name, ev.ts).alias("key"))


SQL_BACKUP_KEY = """
SELECT event_id, array_to_string(list_filter([p, 'backups', 'database', strftime(ts, '%Y/%m/%d'),
    'db-' || regexp_replace(n, '[^A-Za-z0-9._-]', '_', 'g') || '-' || strftime(ts, '%Y%m%d-%H%M%S') || '.sql.gz'],
    lambda x: x <> ''), '/') AS key
FROM (SELECT event_id, ts, trim(trim(CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' /site/ ' ELSE '0' END), '/') AS p,
             event_type || ' #' || CAST(user_id AS VARCHAR) AS n FROM events) t
"""


def q_etag_trim(spark, d):
    _prep(spark)
    ev = load(spark, d, "events")
    h = F.md5(ev.event_id.cast("string"))
    etag = F.when(ev.event_id % 5 == 0, F.lit(None)).when(ev.event_id % 5 == 1, h) \
        .otherwise(F.concat(F.lit('"'), h, F.lit('"')))
    return ev.select("event_id", keys.trim_etag(etag).alias("etag"))


SQL_ETAG_TRIM = """
SELECT event_id, trim(CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN md5(CAST(event_id AS VARCHAR))
  ELSE '"' || md5(CAST(event_id AS VARCHAR)) || '"' END, '"') AS etag FROM events
"""


def q_backup_key_filter(spark, d):
    _prep(spark)
    ls = derived.listing_raw(spark, d)
    return ls.select("bucket", "key", keys.basename("key").alias("basename"),
                     keys.is_backup_key(F.col("key"), F.lit(PREFIX)).alias("is_backup"))


SQL_BACKUP_KEY_FILTER = f"""
SELECT bucket, key, {SQL_BASENAME.format(k='key')} AS basename, {sql_is_backup_key('key')} AS is_backup
FROM ({LISTING_SQL}) l
"""


def q_delete_safety(spark, d):
    _prep(spark)
    ls = derived.listing_raw(spark, d)
    return ls.select("bucket", "key", keys.is_safe_key("bucket", "key").alias("is_safe"))


SQL_DELETE_SAFETY = f"SELECT bucket, key, {sql_is_safe_key('bucket', 'key')} AS is_safe FROM ({LISTING_SQL}) l"


# --- listing and retention: D5, D6, M1, M3, F5, W2, T3, T4, J2, J4, G1, G2 ------

def _fmt_ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def q_listing_normalise(spark, d):
    _prep(spark)
    n = retention.normalise_listing(derived.listing_text(spark, d), PREFIX)
    return n.select("bucket", "key", "size_bytes", _fmt_ts("last_modified").alias("last_modified"))


SQL_LISTING_NORMALISE = f"""
SELECT bucket, key, coalesce(CAST(TRY_CAST(size_bytes AS DOUBLE) AS BIGINT), 0) AS size_bytes,
  strftime({SQL_PARSE_ISO.format(x='last_modified')}, '%Y-%m-%d %H:%M:%S') AS last_modified
FROM ({LISTING_TEXT_SQL}) l
WHERE {sql_is_backup_key('key')} AND {SQL_PARSE_ISO.format(x='last_modified')} IS NOT NULL
"""


def _listing(spark, d):
    return retention.normalise_listing(derived.listing_raw(spark, d), PREFIX)


def q_retention_rank(spark, d):
    _prep(spark)
    return retention.retention_rank(_listing(spark, d)).select("bucket", "key", "rank")


SQL_RETENTION_RANK = f"SELECT bucket, key, rank FROM ({SQL_RANKED}) r"


def q_retention_candidates(spark, d):
    _prep(spark)
    return retention.retention_candidates(_listing(spark, d), KEEP, method="rank") \
        .select("bucket", "key", "size_bytes")


SQL_RETENTION_CANDIDATES = f"SELECT bucket, key, size_bytes FROM ({SQL_RANKED}) r WHERE rank > {KEEP}"


def q_retention_antijoin(spark, d):
    _prep(spark)
    return retention.retention_candidates(_listing(spark, d), KEEP, method="antijoin") \
        .select("bucket", "key", "size_bytes")


def q_delete_summary(spark, d):
    _prep(spark)
    return retention.delete_summary(retention.retention_candidates(_listing(spark, d), KEEP), by=["bucket"])


SQL_DELETE_SUMMARY = f"""
SELECT bucket, count(*) AS deleted_count, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS deleted_bytes
FROM ({SQL_RANKED}) r WHERE rank > {KEEP} GROUP BY bucket
"""


def q_retention_verify(spark, d):
    _prep(spark)
    listing = _listing(spark, d)
    plan = retention.retention_candidates(listing, KEEP)
    kept_rows = retention.kept(listing, KEEP)
    after = listing.join(plan.select("bucket", "key"), ["bucket", "key"], "left_anti")
    return retention.verify_retention(plan, kept_rows, after)


SQL_RETENTION_VERIFY = f"""
SELECT bucket, key, CASE WHEN rank > {KEEP} THEN 'deleted' ELSE 'kept' END AS expected,
  rank <= {KEEP} AS present, true AS ok
FROM ({SQL_RANKED}) r
"""


def q_keep_count(spark, d):
    _prep(spark)
    s = derived.settings(spark, d)
    raw = F.element_at("options", F.lit("retention_keep_count"))
    return s.select("c_custkey", raw.alias("raw"), numbers.keep_count(raw).alias("keep"))


SQL_KEEP_COUNT = f"""
SELECT c_custkey, retention_keep_count AS raw, {SQL_KEEP.format(x='retention_keep_count')} AS keep
FROM ({SETTINGS_SQL}) s
"""


# --- verification: H1, J5, X1-X3, S9, S11, P6 ---------------------------------

def q_row_fingerprint(spark, d):
    _prep(spark)
    li = load(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", hashing.row_fingerprint(li, dialect=PLAIN10).alias("fingerprint"))


SQL_FINGERPRINT = "sha256(" + " || chr(31) || ".join(sql_lit(c, k) for c, k in LINEITEM_COLS) + ")"
SQL_ROW_FINGERPRINT = f"SELECT l_orderkey, l_linenumber, {SQL_FINGERPRINT} AS fingerprint FROM lineitem"


def _changed_lineitem(li: DataFrame) -> DataFrame:
    """A copy with known differences: some quantities changed, some rows
    gone, some rows doubled."""
    changed = li.withColumn("l_quantity", F.when(li.l_orderkey % 100 == 0, li.l_quantity + 1).otherwise(li.l_quantity))
    kept_rows = changed.filter(~((changed.l_orderkey % 250 == 1) & (changed.l_linenumber == 1)))
    extra = changed.filter((changed.l_orderkey % 333 == 0) & (changed.l_linenumber == 1))
    return kept_rows.unionByName(extra)


SQL_CHANGED_LINEITEM = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_orderkey % 100 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
FROM lineitem WHERE NOT (l_orderkey % 250 = 1 AND l_linenumber = 1)
UNION ALL
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_orderkey % 100 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
FROM lineitem WHERE l_orderkey % 333 = 0 AND l_linenumber = 1
"""


def q_verify_rows(spark, d):
    _prep(spark)
    li = load(spark, d, "lineitem")
    return verify.diff_rows(li, _changed_lineitem(li), "fingerprint", PLAIN10)


SQL_VERIFY_ROWS = f"""
WITH a AS (SELECT {SQL_FINGERPRINT} AS fingerprint, count(*) AS n FROM lineitem GROUP BY 1),
     b AS (SELECT {SQL_FINGERPRINT} AS fingerprint, count(*) AS n FROM ({SQL_CHANGED_LINEITEM}) c GROUP BY 1)
SELECT coalesce(a.fingerprint, b.fingerprint) AS fingerprint, CAST(coalesce(a.n, 0) AS BIGINT) AS source_count,
       CAST(coalesce(b.n, 0) AS BIGINT) AS restore_count
FROM a FULL OUTER JOIN b ON a.fingerprint = b.fingerprint
WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)
"""


def q_verify_rows_exceptall(spark, d):
    _prep(spark)
    li = load(spark, d, "lineitem")
    return verify.diff_rows(li, _changed_lineitem(li), "exceptall")


SQL_VERIFY_ROWS_EXCEPTALL = f"""
SELECT *, 'source_only' AS side FROM (SELECT * FROM lineitem EXCEPT ALL SELECT * FROM ({SQL_CHANGED_LINEITEM}) c) x
UNION ALL
SELECT *, 'restore_only' AS side FROM (SELECT * FROM ({SQL_CHANGED_LINEITEM}) c EXCEPT ALL SELECT * FROM lineitem) y
"""


def _whole_dump(spark, d, tables=None) -> str:
    path = scratch_path(spark, "dump")
    dump.write_dump(tables or _tables(spark, d, TABLES), path, GENERATED)
    return path


def _damaged(spark, d) -> dict[str, DataFrame]:
    """The database with known damage: a table gone, one too many, a column
    gone, a column of another type."""
    t = _tables(spark, d, TABLES)
    del t["region"]
    t["extra"] = t["nation"]
    t["labels"] = t["labels"].drop("toxic")
    t["supplier"] = t["supplier"].withColumn("s_nationkey", F.col("s_nationkey").cast("string"))
    return t


def q_verify_tables(spark, d):
    _prep(spark)
    restored = dump.read_dump(spark, _whole_dump(spark, d, _damaged(spark, d)))
    a = catalog.list_base_tables(spark, _src(spark, d))
    b = spark.createDataFrame([(n,) for n in sorted(restored)], "table_name string")
    counts = catalog.table_row_counts(_src(spark, d).tables() | {"extra": restored["extra"]})
    return verify.diff_tables(a, b).join(counts, "table_name")


SQL_VERIFY_TABLES = ("SELECT 'region' AS table_name, 'source_only' AS side, count(*) AS row_count FROM region "
                     "UNION ALL SELECT 'extra', 'restore_only', count(*) FROM nation")


def q_verify_schema(spark, d):
    _prep(spark)
    restored = dump.read_dump(spark, _whole_dump(spark, d, _damaged(spark, d)))
    a = catalog.column_metadata(spark, _src(spark, d).tables())
    b = catalog.column_metadata(spark, restored)
    rows = catalog.table_row_counts(_src(spark, d).tables() | {"extra": restored["extra"]})
    return verify.diff_schema(a, b).join(rows, "table_name")


SQL_VERIFY_SCHEMA = f"""
WITH c AS ({SQL_COLUMNS}),
r AS (SELECT * FROM c WHERE table_name <> 'region' AND NOT (table_name = 'labels' AND name = 'toxic')
      AND NOT (table_name = 'supplier' AND name = 's_nationkey')
      UNION ALL SELECT 'extra', ordinal, name, data_type, column_type, character_set, nullable FROM c WHERE table_name = 'nation'
      UNION ALL SELECT table_name, ordinal, name, 'longtext', 'longtext', 'utf8mb4', nullable FROM c
                WHERE table_name = 'supplier' AND name = 's_nationkey'),
n AS ({SQL_TABLE_ROW_COUNTS} UNION ALL SELECT 'extra', count(*) FROM nation)
SELECT * FROM (SELECT *, 'source_only' AS side FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM r) x
  UNION ALL SELECT *, 'restore_only' AS side FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM c) y) z JOIN n USING (table_name)
"""


def q_restore_rows(spark, d):
    _prep(spark)
    return dump.read_dump(spark, _whole_dump(spark, d))["documents"]


def q_restore_verify(spark, d):
    """Every table of the source against a restore in which one was damaged."""
    _prep(spark)
    from .export import restore_and_verify
    tables = _tables(spark, d, TABLES)
    tables["lineitem"] = _changed_lineitem(tables["lineitem"])
    return restore_and_verify(spark, _whole_dump(spark, d, tables), _src(spark, d))


SQL_RESTORE_VERIFY = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, true AS in_source, true AS in_restore, true AS schema_equal, "
    f"CAST(0 * count(*) AS BIGINT) AS differing_rows FROM {t}" for t in TABLES if t != "lineitem") + (
    " UNION ALL SELECT 'lineitem', true, true, true, "
    f"(SELECT CAST(sum(abs(source_count - restore_count)) AS BIGINT) FROM ({SQL_VERIFY_ROWS}) v)")


def q_write_verify(spark, d):
    _prep(spark)
    return objects.write_verify(load(spark, d, "lineitem"), scratch_path(spark, "write-verify"))


SQL_WRITE_VERIFY = ("SELECT count(*) AS written, count(*) AS read, CAST(0 AS BIGINT) AS differing, "
                    "true AS success FROM lineitem")


# --- history: S10, T5, T6, F6, F8, A3, D2, D3, C16-C20, P7, P8 -----------------

def q_history_all(spark, d):
    _prep(spark)
    return derived.history(spark, d)


def q_history_append(spark, d):
    _prep(spark)
    path = scratch_path(spark, "history")
    h = derived.history(spark, d)
    history_store.append_history(h.filter(F.col("seq") % 2 == 0), path)
    history_store.append_history(h.filter(F.col("seq") % 2 == 1), path)
    return history_store.read_history(spark, path)


def q_history_latest(spark, d):
    _prep(spark)
    return hist.latest_history(derived.history(spark, d))


SQL_HISTORY_LATEST = f"SELECT * FROM ({HISTORY_SQL}) h ORDER BY seq DESC LIMIT 20"


def q_last_success(spark, d):
    _prep(spark)
    return hist.last_success(derived.history(spark, d), window=None, by=["database_name"])


SQL_LAST_SUCCESS = f"""
SELECT database_name, arg_max(seq, seq) AS seq, arg_max(created_at, seq) AS created_at,
  {sql_history_date('arg_max(created_at, seq)', 'unknown')} AS label
FROM ({HISTORY_SQL}) h WHERE success AND coalesce(created_at, '') <> '' GROUP BY database_name
"""


def _history_json(spark, d):
    js = hist.history_to_json(derived.history(spark, d))
    spoiled = F.when(F.col("seq") % 37 == 0, F.lit("garbage")).when(F.col("seq") % 41 == 0, F.lit("[1, 2]")) \
        .otherwise(F.col("value"))
    return js.select("seq", spoiled.alias("value"))


def q_history_parse(spark, d):
    _prep(spark)
    return hist.parse_history(_history_json(spark, d))


SQL_HISTORY_PARSE = f"SELECT * FROM ({HISTORY_SQL}) h WHERE NOT (seq % 37 = 0 OR seq % 41 = 0)"


def q_history_report(spark, d):
    _prep(spark)
    return reports.history_report(derived.history(spark, d), n=None)


SQL_HISTORY_REPORT = f"""
SELECT seq, {sql_history_date('created_at', 'raw')} AS date,
  CASE WHEN coalesce(success, false) THEN 'Success' ELSE 'Failed' END AS status,
  coalesce(database_name, '-') AS database, coalesce(backend, '-') AS backend,
  {sql_size_label('size_bytes')} AS size,
  CASE WHEN coalesce(bucket, '') = '' OR coalesce(key, '') = '' THEN '-' ELSE 's3://' || bucket || '/' || key END AS s3_object,
  coalesce(message, '') AS message
FROM ({HISTORY_SQL}) h
"""


def _settings_norm(spark, d):
    return hist.normalise_settings(derived.settings(spark, d))


def q_settings_normalise(spark, d):
    _prep(spark)
    return _settings_norm(spark, d)


SQL_SETTINGS_NORMALISE = f"""
SELECT c_custkey, trim(region, {SQL_TRIM_CHARS}) AS region, trim(bucket, {SQL_TRIM_CHARS}) AS bucket, trim(prefix, {SQL_TRIM_CHARS}) AS prefix,
  {SQL_SCHEDULE.format(x='backup_schedule')} AS backup_schedule,
  {SQL_KEEP.format(x='retention_keep_count')} AS retention_keep_count
FROM ({SETTINGS_SQL}) s
"""


def q_status_labels(spark, d):
    _prep(spark)
    s = _settings_norm(spark, d)
    return s.select("c_custkey", labels.schedule_label("backup_schedule").alias("schedule"),
                    labels.retention_label("retention_keep_count").alias("retention"))


SQL_STATUS_LABELS = f"""
SELECT c_custkey, CASE WHEN backup_schedule = 'daily' THEN 'Daily' ELSE 'Disabled' END AS schedule,
  CASE WHEN retention_keep_count = 0 THEN 'Disabled' ELSE 'Keep last ' || CAST(retention_keep_count AS VARCHAR) END AS retention
FROM ({SQL_SETTINGS_NORMALISE}) s
"""


def q_status_report(spark, d):
    _prep(spark)
    s = _settings_norm(spark, d).withColumn("backend", F.lit("spark"))
    return reports.status_report(derived.history(spark, d), s, F.lit(NOW).cast("timestamp"))


SQL_STATUS_REPORT = f"""
WITH last AS (
  SELECT coalesce((SELECT {sql_history_date('arg_max(created_at, seq)', 'unknown')}
                   FROM (SELECT * FROM ({HISTORY_SQL}) h ORDER BY seq DESC LIMIT 20) w
                   WHERE success AND coalesce(created_at, '') <> ''), 'None') AS label)
SELECT CASE WHEN backup_schedule = 'daily' THEN 'Daily' ELSE 'Disabled' END AS schedule,
  CASE WHEN backup_schedule = 'daily' THEN '2024-01-16 03:00 UTC' ELSE 'None' END AS next_backup,
  CASE WHEN retention_keep_count = 0 THEN 'Disabled' ELSE 'Keep last ' || CAST(retention_keep_count AS VARCHAR) END AS retention,
  'spark' AS backend, (SELECT label FROM last) AS last_success
FROM ({SQL_SETTINGS_NORMALISE}) s
"""


def q_run_messages(spark, d):
    _prep(spark)
    ev = load(spark, d, "events")
    return ev.select("event_id", labels.run_message(F.lit(K.MSG_AUTO_OK), ev.user_id % 4, ev.event_id % 3,
                                                    ev.event_type == "error").alias("message"))


SQL_RUN_MESSAGES = f"""
SELECT event_id, CASE WHEN user_id % 4 = 0 THEN '{K.MSG_AUTO_OK}'
  WHEN event_type = 'error' THEN '{K.MSG_AUTO_OK} {K.MSG_RETENTION_FAILED}'
  WHEN event_id % 3 = 0 THEN '{K.MSG_AUTO_OK} Retention: keeping the latest ' || CAST(user_id % 4 AS VARCHAR) || ' backups; no old backups required deletion.'
  ELSE '{K.MSG_AUTO_OK} Retention: deleted ' || CAST(event_id % 3 AS VARCHAR) || ' old backup(s), keeping the latest ' || CAST(user_id % 4 AS VARCHAR) || '.' END AS message
FROM events
"""


def q_error_class(spark, d):
    _prep(spark)
    ev = load(spark, d, "events")
    status = F.when(ev.event_id % 4 == 0, F.lit(403)).when(ev.event_id % 4 == 1, F.lit(404)) \
        .when(ev.event_id % 4 == 2, F.lit(500))
    code = F.when(ev.event_type == "error", F.lit("AccessDenied")).when(ev.event_type == "click", F.lit("NoSuchBucket"))
    return ev.select("event_id", labels.error_class(status, code).alias("message"),
                     labels.error_class(status, code, "test").alias("test_message"))


SQL_ERROR_CLASS = f"""
SELECT event_id, CASE WHEN coalesce(st, 0) = 403 OR coalesce(cd, '') = 'AccessDenied' THEN '{K.ERR_UPLOAD_DENIED}'
  WHEN coalesce(st, 0) = 404 OR coalesce(cd, '') = 'NoSuchBucket' THEN '{K.ERR_BUCKET_MISSING}'
  ELSE '{K.ERR_UPLOAD_OTHER}' END AS message,
  CASE WHEN coalesce(st, 0) = 403 OR coalesce(cd, '') = 'AccessDenied' THEN '{K.ERR_TEST_DENIED}'
  WHEN coalesce(st, 0) = 404 OR coalesce(cd, '') = 'NoSuchBucket' THEN '{K.ERR_BUCKET_MISSING}'
  ELSE '{K.ERR_TEST_OTHER}' END AS test_message
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN 500 END AS st,
             CASE event_type WHEN 'error' THEN 'AccessDenied' WHEN 'click' THEN 'NoSuchBucket' END AS cd FROM events) e
"""


def q_size_label(spark, d):
    _prep(spark)
    ev = load(spark, d, "events")
    raw = F.when(ev.event_id % 11 == 0, F.lit("n/a")) \
        .otherwise(F.floor(ev.value * ev.value * ev.value * ev.value * 1000).cast("long").cast("string"))
    return ev.select("event_id", numbers.size_label(raw).alias("size"))


SQL_SIZE_LABEL = f"""
SELECT event_id, {sql_size_label('raw')} AS size FROM (
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'n/a'
    ELSE CAST(CAST(floor(value * value * value * value * 1000) AS BIGINT) AS VARCHAR) END AS raw FROM events) e
"""


def q_next_run(spark, d):
    _prep(spark)
    ev = load(spark, d, "events")
    nxt = dates.epoch_seconds(dates.next_daily_run(ev.ts, "UTC"))
    return ev.select("event_id", nxt.alias("next_epoch"), dates.epoch_display(nxt, "UTC").alias("next_run"))


SQL_NEXT_RUN = f"""
SELECT event_id, epoch_us(n) // 1000000 AS next_epoch, {SQL_DISPLAY.format(t='n')} AS next_run FROM (
  SELECT event_id, CASE WHEN date_trunc('day', ts) + INTERVAL 3 HOUR <= ts
                        THEN date_trunc('day', ts) + INTERVAL 3 HOUR + INTERVAL 1 DAY
                        ELSE date_trunc('day', ts) + INTERVAL 3 HOUR END AS n FROM events) e
"""


def q_history_dates(spark, d):
    _prep(spark)
    h = derived.history(spark, d)
    return h.select("seq", dates.history_date("created_at", "UTC", "raw").alias("page_date"),
                    dates.history_date("created_at", "UTC", "unknown").alias("status_date"))


SQL_HISTORY_DATES = f"""
SELECT seq, {sql_history_date('created_at', 'raw')} AS page_date, {sql_history_date('created_at', 'unknown')} AS status_date
FROM ({HISTORY_SQL}) h
"""


def q_history_dates_zone(spark, d):
    """Order times as history dates in a zone with summer time."""
    _prep(spark)
    o = load(spark, d, "orders")
    return o.select("o_orderkey", dates.history_date(dates.iso_text(o.o_orderdate), "Europe/Berlin", "raw").alias("shown"))


SQL_HISTORY_DATES_ZONE = """
SELECT o_orderkey, strftime(l, '%Y-%m-%d %H:%M') || CASE WHEN l - t = INTERVAL 1 HOUR THEN ' CET' ELSE ' CEST' END AS shown
FROM (SELECT o_orderkey, date_trunc('second', CAST(o_orderdate AS TIMESTAMP)) AS t,
             timezone('Europe/Berlin', timezone('UTC', date_trunc('second', CAST(o_orderdate AS TIMESTAMP)))) AS l FROM orders) x
"""


def q_job_gate(spark, d):
    _prep(spark)
    return hist.gate_jobs(derived.jobs(spark, d))


SQL_JOB_GATE = f"""
SELECT c_custkey, region, bucket, least(length(coalesce(region, '')), length(coalesce(bucket, ''))) > 0 AS runnable,
  CASE WHEN least(length(coalesce(region, '')), length(coalesce(bucket, ''))) > 0 THEN NULL
       ELSE '{K.MSG_SETTINGS_MISSING}' END AS message
FROM ({JOBS_SQL}) j
"""


SQL_LITERAL_STRING = f"SELECT doc_id, {sql_null('text', sql_str('text'))} AS lit FROM documents"
SQL_LITERAL_BINARY = ("SELECT doc_id, CASE WHEN text IS NULL THEN 'NULL' WHEN text = '' THEN 'X''''' "
                      "ELSE '0x' || lower(hex(encode(text))) END AS lit FROM documents")
SQL_LITERAL_NUMERIC = ("SELECT l_orderkey, l_linenumber, "
                       + ", ".join(f"{sql_lit(c, 'double')} AS {c}_lit"
                                   for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
                       + ", CAST(l_partkey AS VARCHAR) AS partkey_lit FROM lineitem")
SQL_LITERAL_NULL = (f"SELECT d.doc_id, {sql_lit('l.quality', 'int')} AS quality_lit, "
                    f"{sql_lit('l.toxic', 'int')} AS toxic_lit "
                    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
SQL_TYPED_CELLS = "SELECT " + ", ".join(f"{sql_lit(c, k)} AS {c}" for c, k in ORDERS_COLS) + " FROM orders"
SQL_ROW_TUPLES = f"SELECT l_orderkey, l_linenumber, {sql_tuple(LINEITEM_COLS)} AS tuple FROM lineitem"
SQL_QUOTE_IDENTIFIER = "SELECT p_partkey, '`' || replace(p_name, '`', '``') || '`' AS quoted FROM part"
SQL_TABLE_SCAN = "SELECT * FROM customer"
SQL_ORDERED_PROJECTION = "SELECT c_name, c_custkey, c_acctbal FROM customer"
SQL_ROW_PAGE = "SELECT * FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100"
SQL_ODD_URL = "(CASE page_id % 3 WHEN 0 THEN chr(9) || '/' || url || '/' || chr(13) || chr(10) WHEN 1 THEN ' ' || url || chr(0) ELSE url END)"
SQL_PREFIX_NORMALISE = f"SELECT page_id, trim(trim(coalesce({SQL_ODD_URL}, ''), {SQL_TRIM_CHARS}), '/') AS prefix FROM pages"
SQL_KEY_NORMALISE = f"SELECT page_id, ltrim(trim({SQL_ODD_URL}, {SQL_TRIM_CHARS}), '/') AS key FROM pages"
SQL_RESTORE_ROWS = "SELECT * FROM documents"


# --- streaming: U1-U3 ----------------------------------------------------------

def q_overlap_suppress(spark, d):
    _prep(spark)
    from ..streaming.overlap import suppress_overlaps
    ev = load(spark, d, "events")
    return suppress_overlaps(ev, "event_type", "ts", "event_id", K.LOCK_SECONDS).select("event_type", "event_id")


SQL_OVERLAP_SUPPRESS = f"""
WITH RECURSIVE
nx AS MATERIALIZED (SELECT a.event_id, b.event_id AS next_id FROM events a
  ASOF JOIN events b ON a.event_type = b.event_type AND a.ts + INTERVAL {K.LOCK_SECONDS} SECOND <= b.ts),
heads AS (SELECT arg_min(event_id, ts) AS event_id FROM events GROUP BY event_type),
chain(event_id) AS (SELECT event_id FROM heads
                    UNION ALL SELECT nx.next_id FROM chain JOIN nx ON nx.event_id = chain.event_id)
SELECT event_type, event_id FROM events WHERE event_id IN (SELECT event_id FROM chain)
"""


def _file_stream(spark, d, name):
    schema = load(spark, d, name).schema
    # a file source watches a folder; the glob picks the table's file
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("pathGlobFilter", f"{name}.parquet").parquet(d.rstrip("/")))


def q_overlap_suppress_stream(spark, d):
    _prep(spark)
    from ..session import ship_package
    from ..streaming.overlap import arrivals, suppress_overlaps_stream
    ship_package(spark)
    out, ck = scratch_path(spark, "overlap-out"), scratch_path(spark, "overlap-ck")
    ev = load(spark, d, "events").select("event_id", "ts", "event_type")
    src = arrivals(ev, [F.col("ts").asc_nulls_last(), F.col("event_id")], scratch_path(spark, "overlap-in"))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    acc = suppress_overlaps_stream(stream, "event_type", "ts", "event_id", K.LOCK_SECONDS)
    q = (acc.select("event_type", "event_id").writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def q_history_stream(spark, d):
    _prep(spark)
    from ..streaming.history_stream import history_stream, read_rolling
    src = scratch_path(spark, "history-src")
    # several files, so several micro-batches merge into the rolling top 20
    derived.history(spark, d).repartition(4).write.parquet(src)
    stream = spark.readStream.schema(derived.history(spark, d).schema).option("maxFilesPerTrigger", 1).parquet(src)
    out, ck = scratch_path(spark, "history-roll"), scratch_path(spark, "history-ck")
    history_stream(stream, out, ck).awaitTermination()
    return read_rolling(spark, out)


def q_incremental_export(spark, d):
    _prep(spark)
    from ..streaming.incremental import incremental_export
    ev = load(spark, d, "events")
    out, ck = scratch_path(spark, "incr-out"), scratch_path(spark, "incr-ck")
    incremental_export(_file_stream(spark, d, "events"), "events", out, ck).awaitTermination()
    return dump.parse_tuples(spark.read.option("recursiveFileLookup", "true").text(out), ev.schema)


# --- jobs over files: S6, S8, S12, G7, P2, P3, P5 -------------------------------

def _exports(spark, d, root, times):
    """Exports of the whole database at the given times."""
    from .export import export_database
    return [export_database(spark, _src(spark, d), f"{root}/store", PREFIX, "shop", t).first() for t in times]


_TIMES = [datetime(2026, 8, 10, 3, 0, tzinfo=timezone.utc), datetime(2026, 8, 11, 3, 0, tzinfo=timezone.utc),
          datetime(2026, 8, 12, 3, 0, tzinfo=timezone.utc)]
_KEYS = [f"site/backups/database/2026/08/{t.day}/db-shop-202608{t.day}-030000.sql.gz" for t in _TIMES]


def _failing_export(spark, d, root):
    """An export that fails half-way: one table holds a value without a literal."""
    from .export import export_database
    tables = _tables(spark, d, TABLES)
    tables["zz_broken"] = tables["region"].select(F.lit(float("nan")).alias("x"))
    try:
        export_database(spark, tables, f"{root}/store", PREFIX, "broken", _TIMES[2], snapshot_check=False)
    except Exception:
        return
    raise AssertionError("the export should have failed")


def q_object_listing(spark, d):
    _prep(spark)
    root = scratch_path(spark, "bucket")
    _exports(spark, d, root, _TIMES[:1])
    _failing_export(spark, d, root)
    ls = objects.list_objects(spark, f"{root}/store", "b1")
    return ls.join(_contents(spark, ls), "key").select("bucket", "key", (F.col("size_bytes") > 0).alias("has_bytes"), "rows", "content")


SQL_OBJECT_LISTING = f"SELECT 'b1' AS bucket, '{_KEYS[0]}' AS key, true AS has_bytes, rows, content FROM ({SQL_DB_CONTENT}) c"


def q_snapshot_check(spark, d):
    """Rows of every table, and whether its files changed while they were
    counted."""
    _prep(spark)
    before = scratch_path(spark, "manifest")
    objects.file_manifest(spark, d).write.parquet(before)
    counts = scratch_path(spark, "counts")
    catalog.table_row_counts(_src(spark, d).tables()).write.parquet(counts)
    changed = objects.manifest_diff(spark.read.parquet(before), objects.file_manifest(spark, d))
    changed = changed.select(F.regexp_extract("path", r"([^/]+)[.]parquet", 1).alias("table_name"), F.lit(True).alias("c")).distinct()
    return (spark.read.parquet(counts).join(changed, "table_name", "left")
            .select("table_name", "row_count", F.coalesce("c", F.lit(False)).alias("changed")))


SQL_SNAPSHOT_CHECK = f"SELECT table_name, row_count, false AS changed FROM ({SQL_TABLE_ROW_COUNTS}) c"


def q_retention_apply(spark, d):
    """Three exports, keep two: what a fresh listing shows of each (J2 on a
    real deletion)."""
    _prep(spark)
    from .runs import apply_retention, backup_listing
    root = scratch_path(spark, "bucket")
    _exports(spark, d, root, _TIMES)

    def listing():
        return backup_listing(spark, f"{root}/store", "b1", PREFIX)
    log = scratch_path(spark, "retention-log")
    done = apply_retention(spark, listing(), 2, objects.PathDeleter(f"{root}/store"), log, relist=listing)
    checked = spark.read.parquet(f"{log}/checked").withColumn("_one", F.lit(1))
    summary = done.select("deleted_count", "missing_count", "failed_count", F.lit(1).alias("_one"))
    return checked.join(F.broadcast(summary), "_one").drop("_one").join(_contents(spark, listing()), "key", "left")


SQL_RETENTION_APPLY = " UNION ALL ".join(
    f"SELECT CASE WHEN {p} THEN c.rows END AS rows, CASE WHEN {p} THEN c.content END AS content, 'b1' AS bucket, '{k}' AS key, '{e}' AS expected, {p} AS present, true AS ok, CAST(1 AS BIGINT) AS deleted_count, "
    f"CAST(0 AS BIGINT) AS missing_count, CAST(0 AS BIGINT) AS failed_count FROM ({SQL_DB_CONTENT}) c"
    for k, e, p in zip(_KEYS, ("deleted", "kept", "kept"), ("false", "true", "true")))


def q_compression_report(spark, d):
    """Bytes of a dump's text in key order, and whether its files are smaller."""
    _prep(spark)
    path = scratch_path(spark, "dump")
    dump.write_dump(_tables(spark, d, TABLES), path, GENERATED, 1000, KEYS, PLAIN10)
    text = dump.read_dump_text(spark, path).filter(F.col("file").endswith(".gz")) \
        .agg(F.sum(F.octet_length("value") + 1).alias("text_bytes"))
    gz = objects.file_manifest(spark, path, "*.gz").agg(F.sum("length").alias("gz_bytes"))
    both = text.select(F.col("text_bytes").cast("long"), F.lit(0).cast("long").alias("gz_bytes")) \
        .unionByName(gz.select(F.lit(0).cast("long").alias("text_bytes"), F.col("gz_bytes").cast("long")))
    agg = both.agg(F.sum("text_bytes").alias("text_bytes"), F.sum("gz_bytes").alias("gz_bytes"))
    return agg.select("text_bytes", (F.col("gz_bytes") < F.col("text_bytes")).alias("smaller"))


SQL_COMPRESSION_REPORT = f"SELECT size_bytes AS text_bytes, true AS smaller FROM ({SQL_DUMP_SIZE}) s"


def _job(spark, d, root):
    from .runs import Job
    return Job(database_name="shop", source=_src(spark, d), root=f"{root}/store", region="eu-west-1", bucket="b1", prefix=PREFIX,
               retention_keep_count="2")


def _run_outcome(spark, root, hist_path):
    """The history entries, whether each entry's object is still listed, and
    the rows and digest of what a listed one restores."""
    listed = objects.list_objects(spark, f"{root}/store", "b1")
    h = history_store.read_history(spark, hist_path)
    return h.join(_contents(spark, listed), "key", "left").select(
        "success", "created_at", "database_name", "backend", "bucket", "key", "message",
        (F.col("size_bytes") > 0).alias("has_bytes"), F.col("rows").isNotNull().alias("listed"), "rows", "content")


def q_full_run(spark, d):
    """Three scheduled runs over the whole database, keep two."""
    _prep(spark)
    from .runs import full_run
    root, hist_path = scratch_path(spark, "bucket"), scratch_path(spark, "history")
    for t in _TIMES:
        full_run(spark, _job(spark, d, root), hist_path, now=t)
    return _run_outcome(spark, root, hist_path)


def _sql_run(i: int, message: str, listed: bool) -> str:
    return (f"SELECT true AS success, '{_TIMES[i]:%Y-%m-%dT%H:%M:%S}+00:00' AS created_at, 'shop' AS database_name, 'spark' AS backend, "
            f"'b1' AS bucket, '{_KEYS[i]}' AS key, '{message}' AS message, true AS has_bytes, {str(listed).lower()} AS listed, "
            f"CASE WHEN {listed} THEN c.rows END AS rows, CASE WHEN {listed} THEN c.content END AS content FROM ({SQL_DB_CONTENT}) c")


SQL_FULL_RUN = " UNION ALL ".join([
    _sql_run(0, f"{K.MSG_AUTO_OK} {K.MSG_RETENTION_NONE % 2}", False), _sql_run(1, f"{K.MSG_AUTO_OK} {K.MSG_RETENTION_NONE % 2}", True),
    _sql_run(2, f"{K.MSG_AUTO_OK} {K.MSG_RETENTION_DELETED % (1, 2)}", True)])


def q_manual_run(spark, d):
    """A manual run over the whole database; it never deletes."""
    _prep(spark)
    from .runs import manual_run
    root, hist_path = scratch_path(spark, "bucket"), scratch_path(spark, "history")
    manual_run(spark, _job(spark, d, root), hist_path, _TIMES[0])
    return _run_outcome(spark, root, hist_path)


SQL_MANUAL_RUN = _sql_run(0, K.MSG_MANUAL_OK, True)


# --- registry ------------------------------------------------------------------

REGISTRY: dict[str, tuple] = {
    "table_catalog": (q_table_catalog, f"SELECT * FROM ({SQL_BASE_TABLES}) b JOIN ({SQL_TABLE_ROW_COUNTS}) c USING (table_name)"),
    "table_row_counts": (q_table_row_counts, SQL_TABLE_ROW_COUNTS),
    "column_metadata": (q_column_metadata, f"SELECT * FROM ({SQL_COLUMNS}) c JOIN ({SQL_VALUES}) v USING (table_name, name)"),
    "table_ddl": (q_table_ddl, f"SELECT * FROM ({SQL_TABLE_DDL}) b JOIN ({SQL_TABLE_ROW_COUNTS}) c USING (table_name)"),
    "create_sections": (q_create_sections, f"SELECT * FROM ({SQL_CREATE_SECTIONS}) b JOIN ({SQL_TABLE_ROW_COUNTS}) c USING (table_name)"),
    "table_scan": (q_table_scan, SQL_TABLE_SCAN),
    "ordered_projection": (q_ordered_projection, SQL_ORDERED_PROJECTION),
    "row_page": (q_row_page, SQL_ROW_PAGE),
    "literal_string": (q_literal_string, SQL_LITERAL_STRING),
    "literal_binary": (q_literal_binary, SQL_LITERAL_BINARY),
    "literal_numeric": (q_literal_numeric, SQL_LITERAL_NUMERIC),
    "literal_null": (q_literal_null, SQL_LITERAL_NULL),
    "typed_cells": (q_typed_cells, SQL_TYPED_CELLS),
    "row_tuples": (q_row_tuples, SQL_ROW_TUPLES),
    "quote_identifier": (q_quote_identifier, SQL_QUOTE_IDENTIFIER),
    "chunk_profile": (q_chunk_profile, SQL_CHUNK_PROFILE),
    "insert_statements": (q_insert_statements, SQL_INSERT_STATEMENTS),
    "dump_lines": (q_dump_lines, SQL_DUMP_LINES),
    "dump_size": (q_dump_size, SQL_DUMP_SIZE),
    "safe_name": (q_safe_name, SQL_SAFE_NAME),
    "prefix_normalise": (q_prefix_normalise, SQL_PREFIX_NORMALISE),
    "key_normalise": (q_key_normalise, SQL_KEY_NORMALISE),
    "backup_key": (q_backup_key, SQL_BACKUP_KEY),
    "etag_trim": (q_etag_trim, SQL_ETAG_TRIM),
    "backup_key_filter": (q_backup_key_filter, SQL_BACKUP_KEY_FILTER),
    "delete_safety": (q_delete_safety, SQL_DELETE_SAFETY),
    "listing_normalise": (q_listing_normalise, SQL_LISTING_NORMALISE),
    "retention_rank": (q_retention_rank, SQL_RETENTION_RANK),
    "retention_candidates": (q_retention_candidates, SQL_RETENTION_CANDIDATES),
    "retention_antijoin": (q_retention_antijoin, SQL_RETENTION_CANDIDATES),
    "delete_summary": (q_delete_summary, SQL_DELETE_SUMMARY),
    "retention_verify": (q_retention_verify, SQL_RETENTION_VERIFY),
    "keep_count": (q_keep_count, SQL_KEEP_COUNT),
    "row_fingerprint": (q_row_fingerprint, SQL_ROW_FINGERPRINT),
    "verify_rows": (q_verify_rows, SQL_VERIFY_ROWS),
    "verify_rows_exceptall": (q_verify_rows_exceptall, SQL_VERIFY_ROWS_EXCEPTALL),
    "verify_tables": (q_verify_tables, SQL_VERIFY_TABLES),
    "verify_schema": (q_verify_schema, SQL_VERIFY_SCHEMA),
    "restore_rows": (q_restore_rows, SQL_RESTORE_ROWS),
    "restore_verify": (q_restore_verify, SQL_RESTORE_VERIFY),
    "write_verify": (q_write_verify, SQL_WRITE_VERIFY),
    "history_all": (q_history_all, HISTORY_SQL),
    "history_append": (q_history_append, HISTORY_SQL),
    "history_latest": (q_history_latest, SQL_HISTORY_LATEST),
    "last_success": (q_last_success, SQL_LAST_SUCCESS),
    "history_parse": (q_history_parse, SQL_HISTORY_PARSE),
    "history_report": (q_history_report, SQL_HISTORY_REPORT),
    "history_dates": (q_history_dates, SQL_HISTORY_DATES),
    "settings_normalise": (q_settings_normalise, SQL_SETTINGS_NORMALISE),
    "status_labels": (q_status_labels, SQL_STATUS_LABELS),
    "status_report": (q_status_report, SQL_STATUS_REPORT),
    "run_messages": (q_run_messages, SQL_RUN_MESSAGES),
    "error_class": (q_error_class, SQL_ERROR_CLASS),
    "size_label": (q_size_label, SQL_SIZE_LABEL),
    "next_run": (q_next_run, SQL_NEXT_RUN),
    "history_dates_zone": (q_history_dates_zone, SQL_HISTORY_DATES_ZONE),
    "job_gate": (q_job_gate, SQL_JOB_GATE),
    "overlap_suppress": (q_overlap_suppress, SQL_OVERLAP_SUPPRESS),
    "overlap_suppress_stream": (q_overlap_suppress_stream, SQL_OVERLAP_SUPPRESS),
    "history_stream": (q_history_stream, SQL_HISTORY_LATEST),
    "incremental_export": (q_incremental_export, "SELECT * FROM events"),
    "object_listing": (q_object_listing, SQL_OBJECT_LISTING),
    "snapshot_check": (q_snapshot_check, SQL_SNAPSHOT_CHECK),
    "retention_apply": (q_retention_apply, SQL_RETENTION_APPLY),
    "compression_report": (q_compression_report, SQL_COMPRESSION_REPORT),
    "full_run": (q_full_run, SQL_FULL_RUN),
    "manual_run": (q_manual_run, SQL_MANUAL_RUN),
}
