"""Table sources and their catalogue: base-table list, column metadata, DDL.

A *source* maps table names to DataFrames. Three kinds are offered:

- ``ParquetDirSource``: a folder holding one Parquet file or folder per table
  (the table list comes from a distributed file listing);
- ``CatalogSource``: a database of the session catalog (views and temporary
  tables are left out, as only base tables are exported);
- ``JdbcSource``: a JDBC database, tables from ``information_schema``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.literals import quote_identifier, quote_identifier_text


class TableSource:
    spark: SparkSession

    def table_names(self) -> list[str]:
        raise NotImplementedError

    def load(self, name: str) -> DataFrame:
        raise NotImplementedError

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.load(n) for n in self.table_names()}

    def catalog_frame(self) -> DataFrame:
        """``table_name, table_type`` of every base table, sorted by name."""
        rows = [(n, "BASE TABLE") for n in self.table_names()]
        return self.spark.createDataFrame(rows, "table_name string, table_type string") \
            .orderBy("table_name")


@dataclass
class ParquetDirSource(TableSource):
    spark: SparkSession
    path: str
    suffix: str = ".parquet"
    _names: list[str] | None = field(default=None, repr=False)

    def table_names(self) -> list[str]:
        if self._names is None:
            jvm = self.spark._jvm
            conf = self.spark._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(self.path)
            fs = p.getFileSystem(conf)
            names = []
            for st in fs.listStatus(p):
                n = st.getPath().getName()
                if n.startswith((".", "_")):
                    continue
                if n.endswith(self.suffix):
                    names.append(n[: -len(self.suffix)])
            self._names = sorted(names)
        return list(self._names)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path.rstrip('/')}/{name}{self.suffix}")


@dataclass
class CatalogSource(TableSource):
    spark: SparkSession
    database: str | None = None

    def table_names(self) -> list[str]:
        tabs = self.spark.catalog.listTables(self.database)
        return sorted(t.name for t in tabs if not t.isTemporary and (t.tableType or "").upper() != "VIEW")

    def load(self, name: str) -> DataFrame:
        full = f"{quote_identifier_text(self.database)}.{quote_identifier_text(name)}" \
            if self.database else quote_identifier_text(name)
        return self.spark.table(full)


@dataclass
class JdbcSource(TableSource):
    """A JDBC database. ``partitions`` splits each table read on a numeric
    key; give one partition when a single consistent snapshot is needed."""
    spark: SparkSession
    url: str
    schema: str | None = None
    properties: dict = field(default_factory=dict)
    tables_query: str | None = None

    def _reader(self):
        r = self.spark.read.format("jdbc").option("url", self.url)
        for k, v in self.properties.items():
            r = r.option(k, v)
        return r

    def table_names(self) -> list[str]:
        q = self.tables_query or (
            "SELECT TABLE_NAME AS table_name FROM information_schema.TABLES "
            "WHERE TABLE_TYPE = 'BASE TABLE'"
            + (" AND TABLE_SCHEMA = '{}'".format(self.schema.replace("'", "''")) if self.schema else ""))
        df = self._reader().option("query", q).load()
        return sorted(r[0] for r in df.collect())

    def load(self, name: str, key: str | None = None, lower: int | None = None,
             upper: int | None = None, partitions: int | None = None) -> DataFrame:
        r = self._reader().option("dbtable", f"{self.schema}.{name}" if self.schema else name)
        if key and partitions and partitions > 1:
            r = (r.option("partitionColumn", key).option("lowerBound", str(lower))
                 .option("upperBound", str(upper)).option("numPartitions", str(partitions)))
        return r.load()


@dataclass
class DictSource(TableSource):
    spark: SparkSession
    frames: dict[str, DataFrame]

    def table_names(self) -> list[str]:
        return sorted(self.frames)

    def load(self, name: str) -> DataFrame:
        return self.frames[name]


def as_source(spark: SparkSession, source) -> TableSource:
    if isinstance(source, TableSource):
        return source
    if isinstance(source, dict):
        return DictSource(spark, source)
    if isinstance(source, str) and ("/" in source or ":" in source):
        return ParquetDirSource(spark, source)
    return CatalogSource(spark, source)


def list_base_tables(spark: SparkSession, source) -> DataFrame:
    """S1 + F1 + T1: base tables, sorted by name."""
    return as_source(spark, source).catalog_frame()


# --- column metadata --------------------------------------------------------

def column_type(dtype: T.DataType) -> tuple[str, str, str | None]:
    """``(data_type, column_type, character_set)`` of a Spark type, in the
    lower-case form a MySQL catalogue reports."""
    if isinstance(dtype, T.LongType):
        return "bigint", "bigint", None
    if isinstance(dtype, T.IntegerType):
        return "int", "int", None
    if isinstance(dtype, T.ShortType):
        return "smallint", "smallint", None
    if isinstance(dtype, T.ByteType):
        return "tinyint", "tinyint", None
    if isinstance(dtype, T.BooleanType):
        return "tinyint", "tinyint(1)", None
    if isinstance(dtype, T.DoubleType):
        return "double", "double", None
    if isinstance(dtype, T.FloatType):
        return "float", "float", None
    if isinstance(dtype, T.DecimalType):
        return "decimal", f"decimal({dtype.precision},{dtype.scale})", None
    if isinstance(dtype, T.StringType):
        return "longtext", "longtext", "utf8mb4"
    if isinstance(dtype, T.BinaryType):
        return "longblob", "longblob", None
    if isinstance(dtype, T.DateType):
        return "date", "date", None
    if isinstance(dtype, T.TimestampNTZType):
        return "datetime", "datetime(6)", None
    if isinstance(dtype, T.TimestampType):
        return "timestamp", "timestamp(6)", None
    return "json", "json", "utf8mb4"


def column_rows(name: str, schema: T.StructType) -> list[tuple]:
    rows = []
    for i, f in enumerate(schema.fields, start=1):
        dt, ct, cs = column_type(f.dataType)
        rows.append((name, i, f.name, dt, ct, cs, bool(f.nullable), f.dataType.simpleString()))
    return rows


def column_metadata(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """S2 + T2 + M4: one row per column, in table and ordinal order. The rows
    come from each DataFrame's schema (plan-time metadata, no data read)."""
    rows = []
    for name in sorted(tables):
        rows.extend(column_rows(name, tables[name].schema))
    return spark.createDataFrame(rows, schemas.COLUMNS).orderBy("table_name", "ordinal")


def ddl_line(c_name, c_type, c_nullable):
    """``  `name` type NOT NULL`` or ``DEFAULT NULL`` for one column."""
    return F.concat(F.lit("  "), quote_identifier(c_name), F.lit(" "), c_type,
                    F.when(c_nullable, F.lit(" DEFAULT NULL")).otherwise(F.lit(" NOT NULL")))


def table_ddl(columns: DataFrame) -> DataFrame:
    """``CREATE TABLE`` text per table from the column rows. A table has a
    bounded number of columns, so the ordered list per table is small."""
    lines = columns.select(
        "table_name", "ordinal",
        ddl_line(F.col("name"), F.col("column_type"), F.col("nullable")).alias("line"))
    return (lines.groupBy("table_name")
            .agg(F.array_sort(F.collect_list(F.struct("ordinal", "line"))).alias("cols"))
            .select("table_name",
                    F.concat(F.lit("CREATE TABLE "), quote_identifier(F.col("table_name")),
                             F.lit(" (\n"),
                             F.array_join(F.transform("cols", lambda x: x["line"]), ",\n"),
                             F.lit("\n)")).alias("ddl")))


def ddl_text(name: str, schema: T.StructType) -> str:
    """The same DDL for one table known at plan time."""
    lines = []
    for f in schema.fields:
        _, ct, _ = column_type(f.dataType)
        lines.append(f"  {quote_identifier_text(f.name)} {ct}" + (" DEFAULT NULL" if f.nullable else " NOT NULL"))
    return f"CREATE TABLE {quote_identifier_text(name)} (\n" + ",\n".join(lines) + "\n)"


def create_section(name: str, schema: T.StructType) -> str:
    """``DROP TABLE IF EXISTS`` + DDL + ``;`` + blank line (no trailing
    newline: the text sink adds one per record)."""
    return f"DROP TABLE IF EXISTS {quote_identifier_text(name)};\n{ddl_text(name, schema)};\n"


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, all tables in one job (one union, no count loop)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
