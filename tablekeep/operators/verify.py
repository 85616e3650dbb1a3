"""Comparing a source with its restore: table lists, schemas, row multisets.

Row multisets are compared without sorting or joining anything: both sides
are one union of fingerprints, counted per side in a single aggregate with a
map-side partial count (a row repeated a billion times costs one row per
task). ``exceptAll`` both ways is offered as the plain form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import row_fingerprint
from ..functions.literals import EXACT, Dialect


def diff_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Table names only in one list: ``table_name, side``."""
    a = a.select("table_name").distinct()
    b = b.select("table_name").distinct()
    return (a.subtract(b).withColumn("side", F.lit("source_only"))
            .unionByName(b.subtract(a).withColumn("side", F.lit("restore_only"))))


def diff_schema(a: DataFrame, b: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Column rows present on one side only (``exceptAll`` both ways)."""
    cols = cols or ["table_name", "ordinal", "name", "data_type", "column_type", "character_set", "nullable"]
    a, b = a.select(*cols), b.select(*cols)
    return (a.exceptAll(b).withColumn("side", F.lit("source_only"))
            .unionByName(b.exceptAll(a).withColumn("side", F.lit("restore_only"))))


def diff_rows(a: DataFrame, b: DataFrame, method: str = "fingerprint",
              dialect: Dialect = EXACT) -> DataFrame:
    """Where the row multisets differ.

    ``fingerprint``: ``fingerprint, source_count, restore_count`` for every
    fingerprint whose counts differ. ``exceptall``: the differing rows
    themselves with a ``side`` column.

    Rows are counted by the 32 bytes of the fingerprint, half of its hex text:
    with few equal rows a task's partial counts hold a key for every row."""
    if method == "exceptall":
        cols = a.columns
        b = b.select(*cols)
        return (a.exceptAll(b).withColumn("side", F.lit("source_only"))
                .unionByName(b.exceptAll(a).withColumn("side", F.lit("restore_only"))))
    def side(df: DataFrame, source: int) -> DataFrame:
        return df.select(F.unhex(row_fingerprint(df, dialect=dialect)).alias("fp"),
                         F.lit(source).cast("long").alias("s"), F.lit(1 - source).cast("long").alias("r"))
    both = side(a, 1).unionByName(side(b, 0))
    return (both.groupBy("fp").agg(F.sum("s").alias("source_count"), F.sum("r").alias("restore_count"))
            .filter("source_count <> restore_count")
            .select(F.lower(F.hex("fp")).alias("fingerprint"), "source_count", "restore_count"))


def diff_summary(a: DataFrame, b: DataFrame, table: str, dialect: Dialect = EXACT) -> DataFrame:
    """One row per table: row counts on both sides and differing rows."""
    d = diff_rows(a, b, "fingerprint", dialect)
    return d.agg(F.coalesce(F.sum(F.abs(F.col("source_count") - F.col("restore_count"))), F.lit(0))
                 .cast("long").alias("differing_rows")) \
        .select(F.lit(table).alias("table_name"), "differing_rows")
