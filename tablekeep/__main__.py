"""Command line: ``python -m tablekeep <command> ...``.

    export   SOURCE ROOT --prefix P --name DB        export every base table
    restore-verify DUMP SOURCE                        compare a dump with its source
    run SOURCE ROOT HISTORY --region R --bucket B [--prefix P --name DB --keep N]
    manual-run SOURCE ROOT HISTORY --region R --bucket B [--prefix P --name DB]
    retention ROOT BUCKET --prefix P --keep N [--apply]
    status   HISTORY [--schedule daily --keep N --tz ZONE]
    history  HISTORY [--tz ZONE]

SOURCE is a folder of Parquet tables or a catalog database name. The
session comes from ``SparkSession.builder`` (spark-submit settings apply).
"""

from __future__ import annotations

import argparse
import sys


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="tablekeep")
    sub = ap.add_subparsers(dest="cmd", required=True)
    e = sub.add_parser("export")
    e.add_argument("source"), e.add_argument("root")
    e.add_argument("--prefix", default=""), e.add_argument("--name", default="database")
    e.add_argument("--no-snapshot-check", action="store_true")
    e.add_argument("--level", type=int, default=None, help="gzip level (9 = smallest files)")
    r = sub.add_parser("restore-verify")
    r.add_argument("dump"), r.add_argument("source")
    t = sub.add_parser("retention")
    t.add_argument("root"), t.add_argument("bucket")
    t.add_argument("--prefix", default=""), t.add_argument("--keep", type=int, required=True)
    t.add_argument("--apply", action="store_true")
    for name in ("run", "manual-run"):
        j = sub.add_parser(name)
        j.add_argument("source"), j.add_argument("root"), j.add_argument("history")
        j.add_argument("--prefix", default=""), j.add_argument("--name", default="database")
        j.add_argument("--region", default=""), j.add_argument("--bucket", default="")
        j.add_argument("--no-snapshot-check", action="store_true")
        if name == "run":
            j.add_argument("--keep", default="0")
    s = sub.add_parser("status")
    s.add_argument("history"), s.add_argument("--schedule", default="disabled")
    s.add_argument("--keep", default="0"), s.add_argument("--tz", default="UTC")
    h = sub.add_parser("history")
    h.add_argument("history"), h.add_argument("--tz", default="UTC")
    a = ap.parse_args(argv)

    from pyspark.sql import SparkSession

    from .session import clear_scratch, ensure_checkpoint_dir
    spark = SparkSession.builder.appName("tablekeep").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    try:
        return _command(spark, a)
    finally:
        clear_scratch(spark)


def _command(spark, a) -> int:
    from pyspark.sql import functions as F

    if a.cmd == "export":
        from .plans.export import export_database
        export_database(spark, a.source, a.root, a.prefix, a.name, gzip_level=a.level,
                        snapshot_check=not a.no_snapshot_check).show(truncate=False)
    elif a.cmd == "restore-verify":
        from .plans.export import restore_and_verify
        res = restore_and_verify(spark, a.dump, a.source)
        res.show(truncate=False)
        bad = res.filter(~(F.col("in_source") & F.col("in_restore") & F.col("schema_equal")
                           & (F.col("differing_rows") == 0))).take(1)
        return 1 if bad else 0
    elif a.cmd == "retention":
        from .plans.runs import apply_retention, backup_listing, retention_dry_run
        from .sources.objects import PathDeleter
        if not a.apply:
            retention_dry_run(spark, a.root, a.bucket, a.prefix, a.keep).show(truncate=False)
        else:
            def relist():
                return backup_listing(spark, a.root, a.bucket, a.prefix)
            done = apply_retention(spark, relist(), a.keep, PathDeleter(a.root), relist=relist)
            done.show()
            return 1 if done.first()["failed_count"] else 0
    elif a.cmd in ("run", "manual-run"):
        from .plans.runs import Job, full_run, manual_run
        job = Job(a.name, a.source, a.root, a.region, a.bucket, a.prefix, getattr(a, "keep", 0), not a.no_snapshot_check)
        entry = (full_run if a.cmd == "run" else manual_run)(spark, job, a.history)
        entry.show(truncate=False)
        return 0 if entry.first()["success"] else 1
    elif a.cmd == "status":
        from .plans.reports import status_report
        from .sources.history_store import read_history
        settings = spark.createDataFrame([(a.schedule, a.keep, "spark")],
                                         "backup_schedule string, retention_keep_count string, backend string")
        status_report(read_history(spark, a.history), settings, F.current_timestamp(), a.tz).show(truncate=False)
    elif a.cmd == "history":
        from .plans.reports import history_report
        from .sources.history_store import read_history
        history_report(read_history(spark, a.history), a.tz).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
