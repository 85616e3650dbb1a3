"""Shared pieces of the vector operators: which vectors take part, whole-number
components, and exact totals over all vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.session import ship_package

SCALE = 1024
#: Whole components beyond this are refused: a squared distance of 64 of them
#: would not fit a long.
LARGEST = 1 << 27


def finite(vector: Column) -> Column:
    """True for a vector that is not null and has no null, NaN or infinite
    entry; never null."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(ok, F.lit(False))


def usable(df: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """``(id, vector array<double>)`` of the rows whose vector has exactly
    ``dims`` finite entries. A null id stays; other columns are dropped."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.filter((F.size("vector") == dims) & finite(F.col("vector")))


def whole(vectors: pa.Array, dims: int) -> np.ndarray:
    """floor(1024 * component) of a list column without nulls, one row each."""
    x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) * SCALE)
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"a vector has a component beyond {LARGEST // SCALE}: its squared distances do not fit a long")
    return x.astype(np.int64)


def exact_totals(df: DataFrame, fn: Callable[[pa.RecordBatch], np.ndarray]) -> dict[int, int]:
    """Sum over all record batches of the whole numbers ``fn`` gives for one
    (always as many), by position. Each task adds its batches up in Python
    integers and sends one row a position; their sums are exact to 38 digits.
    What reaches the driver depends on the positions alone."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = fn(batch).astype(object)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array([str(v) for v in total])],
                                             names=["pos", "total"])
    parts = df.mapInArrow(run, "pos int, total string")
    sums = parts.groupBy("pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return {r["pos"]: int(r["total"]) for r in sums.collect()}


def float_totals(df: DataFrame, fn: Callable[[pa.RecordBatch], np.ndarray]) -> dict[int, float]:
    """As ``exact_totals``, for sums of doubles."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = fn(batch)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["pos", "total"])
    parts = df.mapInArrow(run, "pos int, total double")
    return {r["pos"]: r["total"] for r in parts.groupBy("pos").agg(F.sum("total").alias("total")).collect()}
