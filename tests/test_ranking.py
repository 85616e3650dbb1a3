"""Exact distributed row numbers equal the one-task window, including when
one group holds every row."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablekeep.operators.ranking import row_number

from conftest import SF001


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_global_order(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    a = row_number(li, [], [("l_orderkey", False), ("l_linenumber", False)])
    b = li.withColumn("rn", F.row_number().over(Window.orderBy("l_orderkey", "l_linenumber")))
    assert same(a, b)


def test_hot_group_and_descending(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet").withColumn(
        "g", F.when(F.col("user_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))
    a = row_number(ev, ["g"], [("ts", True), ("event_id", True)], buckets=16)
    w = Window.partitionBy("g").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    assert same(a, ev.withColumn("rn", F.row_number().over(w)))


def test_mixed_directions_and_nulls(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet").withColumn(
        "t", F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("event_type")))
    a = row_number(ev, [], [("t", False), ("event_id", True)], buckets=8)
    w = Window.orderBy(F.col("t").asc(), F.col("event_id").desc())
    assert same(a, ev.withColumn("rn", F.row_number().over(w)))


def test_more_buckets_than_a_literal_tree_would_hold(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    a = row_number(li, [], [("l_orderkey", True), ("l_linenumber", False)], buckets=600)
    w = Window.orderBy(F.col("l_orderkey").desc(), F.col("l_linenumber").asc())
    assert same(a, li.withColumn("rn", F.row_number().over(w)))
