"""Full scans, ordered projections and row pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.literals import quote_identifier_text
from ..operators import ranking


def project_ordered(df: DataFrame, columns: list[str]) -> DataFrame:
    """the columns in the given order. A missing column is an analysis
    error; columns not asked for are left out (and pruned from the scan)."""
    return df.select(*[F.col(quote_identifier_text(c)) for c in columns])


def row_page(df: DataFrame, key: list[str], limit: int, offset: int) -> DataFrame:
    """``limit`` rows after ``offset`` rows in key order, sorted, whatever
    the depth. ``limit`` must be positive and ``offset`` not negative."""
    if not isinstance(limit, int) or limit <= 0:
        raise ValueError("Row read limit must be greater than zero.")
    if not isinstance(offset, int) or offset < 0:
        raise ValueError("Row read offset must not be negative.")
    ranked = ranking.row_number(df, [], [(k, False) for k in key], out="__rn")
    return ranked.filter((F.col("__rn") > offset) & (F.col("__rn") <= offset + limit)).orderBy("__rn").drop("__rn")
