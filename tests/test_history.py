"""History and status."""

from datetime import datetime

from pyspark.sql import functions as F

from tablekeep import schemas
from tablekeep.functions import dates, labels, numbers
from tablekeep.operators import history as hist
from tablekeep.plans import reports
from tablekeep.sources import history_store


def entries(spark, rows):
    return spark.createDataFrame(rows, schemas.HISTORY)


def row(seq, ok, created="2026-08-10T03:00:00+00:00"):
    return (seq, ok, created, "wp", "spark", "b" if ok else None, "k" if ok else None, 2048 if ok else None,
            "m")


def test_latest_and_last_success(spark):
    h = entries(spark, [row(i, i == 1) for i in range(1, 31)])
    assert [r.seq for r in hist.latest_history(h).collect()] == list(range(30, 10, -1))
    # the only success is older than the newest 20: the status line says None
    assert hist.last_success(h).first().label == "None"
    assert hist.last_success(h, window=None).first().label == "2026-08-10 03:00 UTC"


def test_first_match_with_bad_date_is_unknown(spark):
    h = entries(spark, [row(1, True), row(2, True, "garbage"), row(3, True, "")])
    assert hist.last_success(h).first().label == "Unknown"


def test_history_store_and_report(spark, tmp_root):
    path = f"{tmp_root}/hist"
    assert history_store.read_history(spark, path).count() == 0
    history_store.append_history(entries(spark, [row(1, True), row(2, False, "")]), path)
    a, b = history_store.new_seq(), history_store.new_seq()
    assert a > 2 and b >> 10 >= a >> 10
    rep = {r.seq: r for r in reports.history_report(history_store.read_history(spark, path)).collect()}
    assert rep[1].date == "2026-08-10 03:00 UTC" and rep[1].status == "Success"
    assert rep[1].s3_object == "s3://b/k" and rep[1].size == "2 KB"
    assert rep[2].date == "-" and rep[2].s3_object == "-" and rep[2].size == "-"


def test_json_records_round_trip(spark):
    h = entries(spark, [row(1, True), row(2, False)])
    js = hist.history_to_json(h).union(spark.createDataFrame([(3, "not json"), (4, "[1]")], "seq long, value string"))
    back = hist.parse_history(js)
    assert back.exceptAll(h).count() == 0 and h.exceptAll(back).count() == 0


def test_labels(spark):
    df = spark.createDataFrame([("daily", "3", 1023), ("weekly", "0", 1536), (None, "x", 5 * 1024 ** 3)],
                               "s string, k string, n long")
    got = df.select(labels.schedule_label("s"), labels.retention_label("k"), numbers.size_label("n")).collect()
    assert [tuple(r) for r in got] == [("Daily", "Keep last 3", "1,023 B"), ("Disabled", "Disabled", "2 KB"),
                                       ("Disabled", "Disabled", "5 GB")]


def test_run_message_and_error_class(spark):
    df = spark.createDataFrame([(0, 0, False, 403, None), (5, 0, False, 404, None), (5, 2, False, 500, "AccessDenied"),
                                (5, 2, True, None, "NoSuchBucket")], "k int, d int, f boolean, st int, cd string")
    got = df.select(labels.run_message(F.lit("Done."), "k", "d", "f"), labels.error_class("st", "cd")).collect()
    assert got[0][0] == "Done." and got[0][1].startswith("Access denied")
    assert got[1][0].endswith("keeping the latest 5 backups; no old backups required deletion.")
    assert got[1][1] == "The configured S3 bucket was not found."
    assert got[2][0] == "Done. Retention: deleted 2 old backup(s), keeping the latest 5."
    assert got[2][1].startswith("Access denied")
    assert got[3][0].endswith("the new backup was preserved.")


def test_next_run_keeps_local_hour_across_dst(spark):
    tz = "America/New_York"
    df = spark.createDataFrame([(datetime(2026, 3, 7, 12),), (datetime(2026, 10, 31, 12),), (datetime(2026, 3, 8, 2),)],
                               "now timestamp")
    out = df.select(F.from_utc_timestamp(dates.next_daily_run("now", tz), tz).alias("l")).collect()
    assert [r.l.hour for r in out] == [3, 3, 3]


def test_status_report(spark):
    h = entries(spark, [row(1, True), row(2, False)])
    s = spark.createDataFrame([("daily", 5, "spark"), ("x", 0, "spark")],
                              "backup_schedule string, retention_keep_count long, backend string")
    rep = reports.status_report(h, s, F.lit("2026-08-10 12:00:00").cast("timestamp")).collect()
    assert rep[0].schedule == "Daily" and rep[0].next_backup == "2026-08-11 03:00 UTC"
    assert rep[0].retention == "Keep last 5" and rep[0].last_success == "2026-08-10 03:00 UTC"
    assert rep[1].schedule == "Disabled" and rep[1].next_backup == "None" and rep[1].retention == "Disabled"


def test_zone_abbreviations(spark):
    df = spark.createDataFrame([("2024-07-01T10:00:00+00:00",), ("2024-01-01T10:00:00+00:00",)], "t string")
    shown = [r.v for r in df.select(dates.history_date("t", "Europe/Berlin").alias("v")).collect()]
    assert shown == ["2024-07-01 12:00 CEST", "2024-01-01 11:00 CET"]
    assert df.select(dates.history_date("t", "UTC").alias("v")).first().v == "2024-07-01 10:00 UTC"
    assert df.select(dates.history_date("t", "+02:00").alias("v")).first().v == "2024-07-01 12:00 +02:00"
