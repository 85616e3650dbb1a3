"""Every supported type through the gzip dump and back, with extreme values
and nulls (property test)."""

import datetime as dt
import decimal
import os
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tablekeep.operators import verify
from tablekeep.sources import dump

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("b", T.ByteType()),
    T.StructField("s", T.ShortType()),
    T.StructField("f", T.FloatType()),
    T.StructField("d", T.DoubleType()),
    T.StructField("dec", T.DecimalType(38, 18)),
    T.StructField("txt", T.StringType()),
    T.StructField("bin", T.BinaryType()),
    T.StructField("flag", T.BooleanType()),
    T.StructField("day", T.DateType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("ntz", T.TimestampNTZType()),
    T.StructField("arr", T.ArrayType(T.FloatType())),
    T.StructField("m", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("st", T.StructType([T.StructField("a", T.IntegerType()), T.StructField("z", T.StringType())])),
])

TEXT = st.text(alphabet=st.sampled_from(list("az'\"\\\n\r\x00\x1a,();é€😀  ")), max_size=30)
FINITE = st.floats(allow_nan=False, allow_infinity=False)
FLOAT32 = st.floats(allow_nan=False, allow_infinity=False, width=32)
# decimal(38,18) values built exactly from integers (the string constructor does not round)
DEC = st.integers(-(10 ** 38) + 1, 10 ** 38 - 1).map(lambda n: decimal.Decimal(f"{n}e-18"))
TIMES = st.datetimes(min_value=dt.datetime(1900, 1, 1), max_value=dt.datetime(2200, 1, 1))


def opt(s):
    return st.one_of(st.none(), s)


ROW = st.tuples(
    opt(st.integers(-2 ** 63, 2 ** 63 - 1)), opt(st.integers(-128, 127)), opt(st.integers(-32768, 32767)),
    opt(FLOAT32), opt(FINITE), opt(DEC), opt(TEXT), opt(st.binary(max_size=12)), opt(st.booleans()),
    opt(st.dates(min_value=dt.date(1900, 1, 1), max_value=dt.date(2200, 1, 1))),
    opt(TIMES.map(lambda t: t.replace(tzinfo=dt.timezone.utc))), opt(TIMES),
    opt(st.lists(opt(FLOAT32), max_size=4)),
    opt(st.dictionaries(TEXT, opt(st.integers(-1000, 1000)), max_size=3)),
    opt(st.tuples(opt(st.integers(-5, 5)), opt(TEXT))),
)


@settings(max_examples=10, deadline=None)
@given(st.lists(ROW, min_size=1, max_size=12))
def test_all_types_round_trip(spark, tmp_path_factory, rows):
    rows = [(i,) + r[1:] for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, SCHEMA)
    path = os.path.join(str(tmp_path_factory.getbasetemp()), "rt-" + uuid.uuid4().hex)
    dump.write_dump({"t": df}, path, "2026-01-01T00:00:00+00:00", size=3)
    back = dump.read_dump(spark, path)["t"]
    cols = [c for c in SCHEMA.names if c != "m"]          # maps are not comparable in set operations
    assert verify.diff_rows(df, back).count() == 0
    assert df.select(*cols).exceptAll(back.select(*cols)).count() == 0
    assert back.select(*cols).exceptAll(df.select(*cols)).count() == 0


def test_instants_survive_any_session_zone(spark, tmp_path):
    """Both sides of an autumn clock change, written and read in three zones."""
    from tablekeep.sources import dump
    zone = spark.conf.get("spark.sql.session.timeZone")
    times = ["2024-11-03 05:30:00", "2024-11-03 06:30:00", "2024-10-27 00:30:00.000001", "2024-10-27 01:30:00", "1969-12-31 23:59:59.5", "2024-03-10 02:30:00"]
    try:
        for i, z in enumerate(("America/New_York", "Europe/Berlin", "UTC")):
            spark.conf.set("spark.sql.session.timeZone", z)
            df = spark.createDataFrame([(n, t) for n, t in enumerate(times)], "n int, t string").selectExpr("n", "timestamp(concat(t, ' UTC')) AS t")
            want = sorted((r.n, r.u) for r in df.selectExpr("n", "unix_micros(t) AS u").collect())
            dump.write_dump({"x": df}, f"{tmp_path}/{i}", "now")
            for back in ("Asia/Tokyo", "America/New_York", "UTC"):
                spark.conf.set("spark.sql.session.timeZone", back)
                got = dump.read_dump(spark, f"{tmp_path}/{i}")["x"].selectExpr("n", "unix_micros(t) AS u")
                assert sorted((r.n, r.u) for r in got.collect()) == want
                text = "".join(r.value for r in spark.read.text(f"{tmp_path}/{i}/000001-x").collect())
                assert "'2024-11-03 05:30:00'" in text and "'2024-10-27 00:30:00.000001'" in text
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_gzip_levels(spark, tmp_path):
    import os

    import pytest

    from tablekeep.sources import dump
    df = spark.range(20_000).selectExpr("id", "sha2(string(id), 256) AS h").coalesce(1)

    def size(level):
        dump.write_dump({"x": df}, f"{tmp_path}/{level}", "now", gzip_level=level)
        return sum(os.path.getsize(os.path.join(f"{tmp_path}/{level}/000001-x", f)) for f in os.listdir(f"{tmp_path}/{level}/000001-x") if f.endswith(".gz"))
    assert size(9) < size(1)
    for bad in (0, 10):
        with pytest.raises(ValueError):
            dump.write_dump({"x": df}, f"{tmp_path}/bad", "now", gzip_level=bad)
