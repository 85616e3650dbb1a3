"""SQL value literals as Spark column expressions.

Type dispatch happens once per column at plan time from the ``StructField``;
each row then runs a plain JVM expression (whole-stage codegen, no Python).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quote_identifier(c) -> Column:
    """Wrap a name in backticks, doubling inner backticks."""
    return F.concat(F.lit("`"), F.replace(_col(c), F.lit("`"), F.lit("``")), F.lit("`"))


def quote_identifier_text(name: str) -> str:
    """The same rule for a name known at plan time."""
    return "`" + name.replace("`", "``") + "`"


def escape_string(c) -> Column:
    """Escape the seven characters of a MySQL-compatible string literal."""
    out = _col(c).cast("string")
    for raw, escaped in K.STRING_ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def string_literal(c) -> Column:
    """Escaped, single-quoted text (null stays null; see ``or_null``)."""
    return F.concat(F.lit("'"), escape_string(c), F.lit("'"))


def time_literal(text: Column) -> Column:
    """Quoted text of a date or time, which holds nothing to escape."""
    return F.concat(F.lit("'"), text, F.lit("'"))


def binary_literal(c) -> Column:
    """``0x`` + lower-case hex. An empty value gives ``X''`` (a bare ``0x`` is
    not a valid literal)."""
    c = _col(c)
    return F.when(F.length(c) == 0, F.lit("X''")).otherwise(
        F.concat(F.lit("0x"), F.lower(F.hex(c))))


def is_numeric_text(c) -> Column:
    return _col(c).cast("string").rlike(K.NUMERIC_PATTERN)


def numeric_literal(c) -> Column:
    """Text passed through unquoted; text that is not a number is an error.
    Null stays null (``or_null`` renders it)."""
    text = _col(c).cast("string")
    return F.when(text.isNull(), text).when(text.rlike(K.NUMERIC_PATTERN), text).otherwise(
        F.raise_error(F.lit("Invalid numeric database value.")).cast("string"))


def or_null(c, rendered: Column) -> Column:
    """``NULL`` for a null value, the rendered literal otherwise."""
    return F.when(_col(c).isNull(), F.lit(K.NULL_LITERAL)).otherwise(rendered)


@dataclass(frozen=True)
class Dialect:
    """How floating point values are written.

    ``exact``: Spark's shortest round-trip text (``1.234567825E7``); a valid
    literal and lossless, used for every export.
    ``plain10``: fixed notation with ten decimals via ``decimal(38,10)``; only
    for comparing with engines that print doubles differently. Lossy for very
    small or very large values, so never used to export.
    """
    float_mode: str = "exact"

    def float_text(self, c: Column) -> Column:
        if self.float_mode == "plain10":
            return c.cast("string").cast(T.DecimalType(38, 10)).cast("string")
        return c.cast("string")


EXACT = Dialect("exact")
PLAIN10 = Dialect("plain10")

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)


_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def utc_text(c) -> Column:
    """Text of an instant as UTC wall-clock time, whatever the session zone."""
    days = F.floor(F.unix_micros(c) / F.lit(86_400_000_000)).cast("int")
    rest = F.unix_micros(c) - days.cast("long") * 86_400_000_000
    seconds = (rest.cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(18,6)")
    return (F.expr(_EPOCH) + F.make_dt_interval(days, F.lit(0), F.lit(0), seconds)).cast("string")


def from_utc_text(c) -> Column:
    """The instant of a UTC wall-clock text, whatever the session zone."""
    gap = c.cast("timestamp_ntz") - F.expr(_EPOCH)
    days = F.extract(F.lit("DAY"), gap).cast("long")
    seconds = F.extract(F.lit("HOUR"), gap).cast("long") * 3600 + F.extract(F.lit("MINUTE"), gap).cast("long") * 60
    micros = (F.extract(F.lit("SECOND"), gap) * 1_000_000).cast("long")
    return F.timestamp_micros((days * 86_400 + seconds) * 1_000_000 + micros)


def render_value(c, dtype: T.DataType, dialect: Dialect = EXACT) -> Column:
    """Literal text of a non-null value of Spark type ``dtype``."""
    c = _col(c)
    if isinstance(dtype, _INTEGRAL):
        return c.cast("string")
    if isinstance(dtype, T.DecimalType):
        return c.cast("string")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
        return F.when(bad, F.raise_error(F.lit("Invalid numeric database value.")).cast("string")) \
            .otherwise(dialect.float_text(c))
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("1")).otherwise(F.lit("0"))
    if isinstance(dtype, T.BinaryType):
        return binary_literal(c)
    if isinstance(dtype, T.TimestampType):
        return time_literal(utc_text(c))
    if isinstance(dtype, _TIMES):
        return time_literal(c.cast("string"))
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.FloatType, T.DoubleType)) and dialect.float_mode == "plain10":
        return F.concat(F.lit("'["), F.array_join(F.transform(c, dialect.float_text), ","), F.lit("]'"))
    if isinstance(dtype, _NESTED):
        return string_literal(F.to_json(c))
    if isinstance(dtype, T.NullType):
        return F.lit(K.NULL_LITERAL)
    return string_literal(c)


def literal(field: T.StructField, dialect: Dialect = EXACT, source: Column | None = None) -> Column:
    """Type-dispatched literal of one column: ``NULL`` or the rendered value."""
    c = source if source is not None else F.col(quote_identifier_text(field.name))
    return or_null(c, render_value(c, field.dataType, dialect))


def row_tuple(schema: T.StructType, dialect: Dialect = EXACT) -> Column:
    """``(v1, v2, ...)`` for every column, in schema order."""
    parts = [literal(f, dialect) for f in schema.fields]
    return F.concat(F.lit("("), F.concat_ws(K.VALUE_SEPARATOR, *parts), F.lit(")"))


def row_tuples(df: DataFrame, dialect: Dialect = EXACT, keep: list[str] | None = None) -> DataFrame:
    """One tuple text per row; ``keep`` columns are carried along (e.g. keys)."""
    keep = keep or []
    return df.select(*[F.col(quote_identifier_text(k)) for k in keep],
                     row_tuple(df.schema, dialect).alias("tuple"))


def typed_cells(df: DataFrame, dialect: Dialect = EXACT) -> DataFrame:
    """Every column replaced by its literal text, same names."""
    return df.select(*[literal(f, dialect).alias(f.name) for f in df.schema.fields])
