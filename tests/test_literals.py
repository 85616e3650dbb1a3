"""Value literals (C1-C7): the table-driven cases of the reference's value
serializer script, and escape/unescape round trips on hostile strings."""

from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekeep.functions import literals as L
from tablekeep.sources.dump import parse_tuples, unescape_string


def one(spark, value, dtype):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", dtype)]))
    return df.select(L.literal(df.schema["v"]).alias("x")).first()["x"]


def test_value_literals(spark):
    assert one(spark, None, T.StringType()) == "NULL"
    assert one(spark, 123, T.IntegerType()) == "123"
    assert one(spark, Decimal("12.34"), T.DecimalType(10, 2)) == "12.34"
    assert one(spark, "simple text", T.StringType()) == "'simple text'"
    assert one(spark, "O'Reilly", T.StringType()) == "'O\\'Reilly'"
    assert one(spark, "line1\nline2", T.StringType()) == "'line1\\nline2'"
    assert one(spark, "C:\\path\\file", T.StringType()) == "'C:\\\\path\\\\file'"
    assert one(spark, "日本語テキスト", T.StringType()) == "'日本語テキスト'"
    assert one(spark, bytes([0, 1, 2, 255]), T.BinaryType()) == "0x000102ff"


def test_other_types(spark):
    assert one(spark, b"", T.BinaryType()) == "X''"
    assert one(spark, True, T.BooleanType()) == "1"
    assert one(spark, 1.234567825e7, T.DoubleType()) == "1.234567825E7"
    assert one(spark, "a\x00b\rc\x1ad\"e", T.StringType()) == "'a\\0b\\rc\\Zd\\\"e'"


def test_nan_is_an_error(spark):
    import pytest
    with pytest.raises(Exception):
        one(spark, float("nan"), T.DoubleType())


def test_numeric_text_check(spark):
    df = spark.createDataFrame([("12.5",), ("-3e4",), (None,)], "v string")
    got = [r[0] for r in df.select(L.or_null("v", L.numeric_literal("v"))).collect()]
    assert got == ["12.5", "-3e4", "NULL"]
    import pytest
    with pytest.raises(Exception):
        spark.createDataFrame([("12abc",)], "v string").select(L.numeric_literal("v")).collect()


def test_quote_identifier(spark):
    df = spark.createDataFrame([("a`b",)], "v string")
    assert df.select(L.quote_identifier("v")).first()[0] == "`a``b`"


HOSTILE = st.text(alphabet=st.sampled_from(list("ab'\"\\\n\r\x00\x1a,() é😀\u2028\u0085NUL")), max_size=40)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), HOSTILE), min_size=1, max_size=8))
def test_escape_round_trip(spark, values):
    schema = T.StructType([T.StructField("v", T.StringType()), T.StructField("i", T.IntegerType())])
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], schema)
    lines = df.select(L.row_tuple(df.schema).alias("value"))
    back = parse_tuples(lines, schema)
    assert sorted(back.collect(), key=lambda r: r.i) == sorted(df.collect(), key=lambda r: r.i)


def test_unescape_pieces(spark):
    df = spark.createDataFrame([("\\\\\\'x\\\\n",)], "v string")
    assert df.select(unescape_string(F.col("v"))).first()[0] == "\\'x\\n"
