"""Statements in key order: one shuffle of the rows, chunks of exact size."""

import pytest
from pyspark.sql import functions as F

from tablekeep.operators import chunks


def chunk_rows(got):
    return [[int(line.strip("(),;").split(",")[0]) if line[1:5] != "NULL" else None for line in r.value.split("\n")[1:-1]]
            for r in sorted(got.collect(), key=lambda r: r.chunk_id)]


@pytest.mark.parametrize("size, runs", [(10, 1), (7, 2), (100, 2), (1, 50)])
@pytest.mark.parametrize("keys", ["unique", "repeated", "hot", "null"])
def test_chunks_of_exact_size_in_key_order(spark, monkeypatch, keys, size, runs):
    monkeypatch.setattr(chunks, "RUN_CHUNKS", runs)
    k = {"unique": "id", "repeated": "id div 37", "hot": "if(id % 10 < 9, 500, id)", "null": "if(id % 3 = 0, null, id)"}[keys]
    rows = spark.range(0, 2003, 1, 5).selectExpr(f"{k} as k", "id as v", "if(id % 2 = 0, 0.0D, -0.0D) as z").repartition(4)
    got = chunks.insert_statements(rows, "t", ["k"], size, buckets=9)
    held = chunk_rows(got)
    assert [len(c) for c in held] == [size] * (2003 // size) + [2003 % size] * (2003 % size > 0)
    want = sorted([r.k for r in rows.select("k").collect()], key=lambda x: (x is not None, x or 0))
    assert [x for c in held for x in c] == want
    lines = [x.strip(",;") for r in got.collect() for x in r.value.split("\n")[1:-1]]
    assert len(set(lines)) == len(lines) == 2003  # every row is there once


def test_equal_rows_across_tasks_are_neither_lost_nor_repeated(spark, monkeypatch):
    monkeypatch.setattr(chunks, "RUN_CHUNKS", 1)
    rows = spark.range(0, 900, 1, 3).selectExpr("id % 4 as k", "'x' as v")
    assert chunk_rows(chunks.insert_statements(rows, "t", ["k"], 8, buckets=6)) == [[n // 225 for n in range(s, min(900, s + 8))] for s in range(0, 900, 8)]


def test_the_rows_pass_one_shuffle(spark, monkeypatch):
    monkeypatch.setattr(chunks, "RUN_CHUNKS", 2)
    rows = spark.range(0, 5000, 1, 4).select(F.hash("id").alias("k"), F.col("id").alias("v"))
    got = chunks.insert_statements(rows, "t", ["k"], 10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "collect_list" not in plan
    assert got.count() == 500
