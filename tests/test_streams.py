"""Rolling history (U2) over several micro-batches and incremental export
(U3) picking up only files that arrived since the last run."""

import os

from pyspark.sql import functions as F

from tablekeep import schemas
from tablekeep.sources import dump
from tablekeep.streaming.history_stream import history_stream, read_rolling
from tablekeep.streaming.incremental import incremental_export

from conftest import SF0001


def test_rolling_history_over_batches(spark, tmp_root):
    src = os.path.join(tmp_root, "src")
    rows = [(i, i % 3 != 0, "2026-08-10T03:00:00+00:00", "wp", "spark", None, None, None, "m") for i in range(1, 101)]
    spark.createDataFrame(rows, schemas.HISTORY).repartition(5).write.parquet(src)
    stream = spark.readStream.schema(schemas.HISTORY).option("maxFilesPerTrigger", 1).parquet(src)
    out = os.path.join(tmp_root, "roll")
    q = history_stream(stream, out, os.path.join(tmp_root, "ck"), n=20)
    q.awaitTermination()
    assert len(q.recentProgress) >= 5
    assert sorted(r.seq for r in read_rolling(spark, out).collect()) == list(range(81, 101))


def test_incremental_export_only_new_files(spark, tmp_root):
    ev = spark.read.parquet(f"{SF0001}/events.parquet")
    src, out, ck = (os.path.join(tmp_root, x) for x in ("src", "out", "ck"))
    ev.filter(F.col("event_id") < 500).write.parquet(os.path.join(src, "a"))

    def run():
        stream = spark.readStream.schema(ev.schema).option("recursiveFileLookup", "true").parquet(src)
        incremental_export(stream, "events", out, ck).awaitTermination()
        return dump.parse_tuples(spark.read.option("recursiveFileLookup", "true").text(out), ev.schema)

    first = run()
    assert first.count() == 500
    ev.filter(F.col("event_id") >= 500).write.parquet(os.path.join(src, "b"))
    both = run()
    assert both.count() == ev.count()
    assert both.exceptAll(ev).count() == 0 and ev.exceptAll(both).count() == 0


def test_replayed_batch_gives_the_same_history(spark, tmp_root):
    src, out, ck = (os.path.join(tmp_root, x) for x in ("src", "roll", "ck"))
    rows = [(i, True, "2026-08-10T03:00:00+00:00", "wp", "spark", None, None, None, "m") for i in range(1, 101)]
    spark.createDataFrame(rows, schemas.HISTORY).repartition(5).write.parquet(src)

    def run():
        stream = spark.readStream.schema(schemas.HISTORY).option("maxFilesPerTrigger", 1).parquet(src)
        history_stream(stream, out, ck, n=20).awaitTermination()
        return sorted(r.seq for r in read_rolling(spark, out).collect())
    assert run() == list(range(81, 101))
    assert len([v for v in os.listdir(out) if v.startswith("v=")]) == 2  # older versions are gone
    last = max(int(n) for n in os.listdir(os.path.join(ck, "commits")) if n.isdigit())
    for name in (str(last), f".{last}.crc"):  # as after a crash between write and commit
        os.remove(os.path.join(ck, "commits", name))
    assert run() == list(range(81, 101))
