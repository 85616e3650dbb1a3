"""Export and restore (P1/P6): the reference's restore fixture, an empty
table, and every test table through gzip text and back."""

import os
from decimal import Decimal

from pyspark.sql import types as T

from tablekeep.operators import verify
from tablekeep.plans.export import export_database, restore_and_verify
from tablekeep.sources import dump
from tablekeep.sources.catalog import DictSource, ParquetDirSource

from conftest import SF0001

FIXTURE = T.StructType([
    T.StructField("id", T.DecimalType(20, 0), False),
    T.StructField("utf8_text", T.StringType(), False),
    T.StructField("nullable_text", T.StringType(), True),
    T.StructField("binary_data", T.BinaryType(), False),
    T.StructField("serialized_data", T.StringType(), False),
])
ROWS = [
    (Decimal(1), "日本語のテキスト 😀", None, bytes([0x00, 0x01, 0xFF, 0x7F]),
     'a:1:{s:5:"title";s:12:"ünïcödé";}'),
    (Decimal(2), "", "Grüße, 'quoted' \\ back", bytes([0x41, 0x00, 0x42]), "b:0;"),
]


def test_restore_fixture(spark, tmp_root):
    t = spark.createDataFrame(ROWS, FIXTURE)
    empty = spark.createDataFrame([], T.StructType([T.StructField("id", T.DecimalType(20, 0), False)]))
    tables = {"restore_fixture": t, "restore_fixture_empty": empty}
    path = os.path.join(tmp_root, "dump")
    dump.write_dump(tables, path, "2026-01-01T00:00:00+00:00", size=2)
    back = dump.read_dump(spark, path)
    assert sorted(back) == sorted(tables)
    assert back["restore_fixture_empty"].count() == 0
    assert verify.diff_rows(t, back["restore_fixture"]).count() == 0
    text = "".join(r.value + "\n" for r in spark.read.text(os.path.join(path, "000002-restore_fixture_empty"))
                   .collect())
    assert "DROP TABLE IF EXISTS `restore_fixture_empty`;" in text and "INSERT" not in text
    assert "`id` decimal(20,0) NOT NULL" in text


def test_whole_database_round_trip(spark, tmp_root):
    src = ParquetDirSource(spark, SF0001)
    path = os.path.join(tmp_root, "dump")
    dump.write_dump(src.tables(), path, "2026-01-01T00:00:00+00:00")
    res = restore_and_verify(spark, path, src).collect()
    assert len(res) == 14
    assert all(r.in_source and r.in_restore and r.schema_equal and r.differing_rows == 0 for r in res)


def test_export_database_key_and_size(spark, tmp_root):
    from datetime import datetime, timezone
    src = DictSource(spark, {"region": spark.read.parquet(f"{SF0001}/region.parquet")})
    r = export_database(spark, src, tmp_root, "/site/", "wp db", datetime(2026, 8, 10, 3, 0, tzinfo=timezone.utc),
                        snapshot_check=False).first()
    assert r.key == "site/backups/database/2026/08/10/db-wp_db-20260810-030000.sql.gz"
    assert r.size_bytes > 0 and r.created_at == "2026-08-10T03:00:00+00:00"
    text = "".join(x.value + "\n" for x in spark.read.text(os.path.join(tmp_root, r.key, "000000-header")).collect())
    assert text.endswith("SET NAMES utf8mb4;\nSET FOREIGN_KEY_CHECKS=0;\n\n")


def test_building_a_comparison_runs_no_job(spark, tmp_path):
    t = spark.range(100).repartition(2)
    dump.write_dump({"t": t}, f"{tmp_path}/d", "now")
    back = dump.read_dump(spark, f"{tmp_path}/d")["t"]
    spark.sparkContext.setJobGroup("plan-only", "building")
    try:
        diff = verify.diff_rows(t, back)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("plan-only")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert diff.count() == 0


def test_scratch_is_removed_at_the_end(spark):
    from tablekeep.session import clear_scratch, local_path, scratch_path
    path = scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert os.path.exists(local_path(path))
    clear_scratch(spark)
    assert not os.path.exists(local_path(path))
