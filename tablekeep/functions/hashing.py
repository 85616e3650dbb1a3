"""Row fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .literals import EXACT, Dialect, literal

# Unit separator between values; a null is its own literal, so null and the
# text 'NULL' differ (the text is quoted).
SEPARATOR = "\x1f"


def row_fingerprint(df: DataFrame, columns: list[str] | None = None, dialect: Dialect = EXACT) -> Column:
    """H1: SHA-256 hex of the row's typed literal texts joined by a separator.
    Typed literals keep types apart (``1`` vs ``'1'``) and nulls apart."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    return F.sha2(F.concat_ws(SEPARATOR, *[literal(f, dialect) for f in fields]), 256)
