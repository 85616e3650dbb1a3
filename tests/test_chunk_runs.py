"""Chunks in key order reach tasks as runs of consecutive chunks."""

from pyspark.sql import functions as F

from tablekeep.operators import chunks


def test_runs_of_chunks_need_no_sample(spark, monkeypatch):
    monkeypatch.setattr(chunks, "RUN_CHUNKS", 2)
    rows = spark.range(0, 1003, 1, 5).select((F.lit(1002) - F.col("id")).alias("k"), F.lit("x").alias("v"))
    got = chunks.insert_statements(rows, "t", ["k"], 10, ordered=True)
    assert "rangepartitioning" not in got._jdf.queryExecution().toString().lower()
    assert got.columns == ["chunk_id", "value"]
    seen = got.withColumn("p", F.spark_partition_id()).collect()
    assert [r.chunk_id for r in seen] == list(range(101)) and len({r.p for r in seen}) > 1
    plain = chunks.insert_statements(rows, "t", ["k"], 10).orderBy("chunk_id").collect()
    assert [r.value for r in seen] == [r.value for r in plain]


def test_a_table_without_rows_has_no_chunks(spark):
    rows = spark.range(0).select(F.col("id").alias("k"))
    assert chunks.insert_statements(rows, "t", ["k"], 10, ordered=True).count() == 0
