"""Shared pieces of the training-data operators: loading tables, staging, the
word rule, UTF-8 bytes of a text, two-level running sums and connected
components over links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablekeep.session import remove_path, scratch_path, ship_package

#: A word: code points that are none of space, tab, LF, VT, FF, CR. On UTF-8
#: bytes this is what ``bytes.split()`` splits on.
WORD = r"[^\x20\x09-\x0D]+"

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder (at ``path``, if given)
    and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def narrowed(staged: DataFrame, path: str, columns: list[str], name: str) -> DataFrame:
    """Some columns of a table that was staged at ``path``, staged anew; the
    wide table is removed, so nothing may read it afterwards."""
    kept = stage(staged.select(*columns), name)
    remove_path(staged.sparkSession, path)
    return kept


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` of a function on one record batch."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
    return df.mapInArrow(run, schema)


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; a null text is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sum(df: DataFrame, group: list[str], major, minor: list, value: str, out: str) -> DataFrame:
    """``out`` = sum of ``value`` over the rows before this one in its group,
    in the order (``major``, ``minor``). ``major`` is a coarse integer column:
    the group is summed in pieces of one ``major`` value each, so that a hot
    group is no single task; only one row per (group, ``major``) meets in the
    second window."""
    pieces = df.groupBy(*group, F.col(major)).agg(F.sum(value).alias("_piece"))
    before = Window.partitionBy(*group).orderBy(major).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(major).alias("_m"),
                           F.coalesce(F.sum("_piece").over(before), F.lit(0)).alias("_base"))
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col(major) == F.col("_m")]
    inside = Window.partitionBy(*group, major).orderBy(*minor).rowsBetween(Window.unboundedPreceding, -1)
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    summed = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (summed.join(pieces, cond).withColumn(out, F.col("_base") + F.col("_inside"))
            .drop("_inside", "_base", "_m", *[f"_g{i}" for i in range(len(group))]))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the links ``edges(a, b)`` (long node ids):
    ``(node, root)`` for every linked node, ``root`` the smallest node id of
    its component.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each
    round links neighbours to the smallest node known near them, as joins and
    minima with map-side combine; the links of a round are written to the
    shared folder. Ends when a round changes nothing; raises if ``max_rounds``
    do not suffice (the number of rounds is logarithmic in practice).
    """
    def canon(df: DataFrame) -> DataFrame:
        return (df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .filter("a <> b").distinct())

    def mark(df: DataFrame):
        h = F.xxhash64("a", "b")
        return df.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))),
                      F.sum(F.shiftrightunsigned(h, 32))).first()

    links = stage(canon(edges), "links")
    seen = mark(links)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.least(F.col("n"), F.min("b")).alias("m"))
        large = (both.filter("b > a").join(low, F.col("a") == F.col("n"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = canon(large)
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = (large.join(least, F.col("a") == F.col("n"))
                 .select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("y")),
                                           F.struct(F.col("a").alias("x"), F.col("m").alias("y")))).alias("e"))
                 .select(F.col("e.x").alias("a"), F.col("e.y").alias("b")))
        links = stage(canon(small), "links")
        now = mark(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components: not settled after the given rounds")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
