"""Members of one object are dealt to tasks one each, and bodies without a
backslash pass the unescaping as they are."""

from pyspark.sql import functions as F

from tablekeep.sources import dump, single


def test_members_are_dealt_one_to_a_task(spark):
    index = {"members": [{"table": "t" if i % 7 else None, "offset": 10 * i, "bytes": 10} for i in range(49)]}
    rows = single.member_rows(spark, "", index)
    per_task = rows.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert sorted(r["count"] for r in per_task) == [1] * 42
    assert rows.columns == ["table", "offset", "bytes"]
    assert sorted(r.offset for r in rows.collect()) == [10 * i for i in range(49) if i % 7]


def test_unescape_with_and_without_backslash(spark):
    bodies = [("plain, 'text'", "plain, 'text'"), ("", ""), (None, None), (r"a\\nb", r"a\nb"), (r"a\nb\\", "a\nb\\"), (r"\'\"\0\Z\r", "'\"\x00\x1a\r")]
    df = spark.createDataFrame(bodies, "body string, want string")
    got = df.select(dump.unescape_string(F.col("body")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
