"""Tables the test data does not hold, derived from it by fixed expressions:
an object listing, a run history, backup jobs and settings. The same
expressions exist as SQL (``*_SQL``) so another engine can rebuild them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.dates import iso_text
from ..functions.keys import backup_key


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _name(ev) -> F.Column:
    return F.concat(ev.event_type, F.lit("_"), ev.event_id.cast("string"))


def _listing_key(ev) -> F.Column:
    day = F.date_format(ev.ts, K.KEY_DATE_PATH)
    return (F.when(ev.event_id % 13 == 0, F.concat(F.lit("site/backups/database/"), day, F.lit("/other-"),
                                                    _name(ev), F.lit(".sql.gz")))
            .when(ev.event_id % 17 == 0, F.concat(F.lit("site/backups/database/"), day, F.lit("/db-"), _name(ev),
                                                   F.lit(".sql")))
            .when(ev.event_id % 19 == 0, backup_key(F.lit("other"), _name(ev), ev.ts))
            .otherwise(backup_key(F.lit("site"), _name(ev), ev.ts)))


def listing_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object per event: ``bucket, key, size_bytes, last_modified``.
    Some keys are spoiled on purpose (wrong file name, suffix or folder) and
    some times are missing, so every filter has work to do."""
    ev = load(spark, sf_dir, "events")
    return ev.select(F.concat(F.lit("b"), (ev.user_id % 8).cast("string")).alias("bucket"),
                     _listing_key(ev).alias("key"),
                     F.floor(F.abs(ev.value) * 1000).cast("long").alias("size_bytes"),
                     F.when(ev.event_id % 23 == 0, F.lit(None)).otherwise(ev.ts).alias("last_modified"))


LISTING_SQL = """
SELECT 'b' || CAST(user_id % 8 AS VARCHAR) AS bucket,
  CASE WHEN event_id % 13 = 0 THEN 'site/backups/database/' || strftime(ts, '%Y/%m/%d') || '/other-' || event_type || '_' || CAST(event_id AS VARCHAR) || '.sql.gz'
       WHEN event_id % 17 = 0 THEN 'site/backups/database/' || strftime(ts, '%Y/%m/%d') || '/db-' || event_type || '_' || CAST(event_id AS VARCHAR) || '.sql'
       WHEN event_id % 19 = 0 THEN 'other/backups/database/' || strftime(ts, '%Y/%m/%d') || '/db-' || event_type || '_' || CAST(event_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d-%H%M%S') || '.sql.gz'
       ELSE 'site/backups/database/' || strftime(ts, '%Y/%m/%d') || '/db-' || event_type || '_' || CAST(event_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d-%H%M%S') || '.sql.gz' END AS key,
  CAST(floor(abs(value) * 1000) AS BIGINT) AS size_bytes,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE ts END AS last_modified
FROM events
"""


def listing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing as an object store API returns it: size and time as text,
    some of it unusable."""
    ev = load(spark, sf_dir, "events")
    size = F.when(ev.event_id % 31 == 0, F.lit("n/a")) \
        .otherwise(F.floor(F.abs(ev.value) * 1000).cast("long").cast("string"))
    lm = (F.when(ev.event_id % 23 == 0, F.lit("not a time"))
          .when(ev.event_id % 29 == 0, F.lit(""))
          .otherwise(iso_text(ev.ts)))
    return ev.select(F.concat(F.lit("b"), (ev.user_id % 8).cast("string")).alias("bucket"),
                     _listing_key(ev).alias("key"), size.alias("size_bytes"), lm.alias("last_modified"))


LISTING_TEXT_SQL = """
SELECT 'b' || CAST(user_id % 8 AS VARCHAR) AS bucket,
  CASE WHEN event_id % 13 = 0 THEN 'site/backups/database/' || strftime(ts, '%Y/%m/%d') || '/other-' || event_type || '_' || CAST(event_id AS VARCHAR) || '.sql.gz'
       WHEN event_id % 17 = 0 THEN 'site/backups/database/' || strftime(ts, '%Y/%m/%d') || '/db-' || event_type || '_' || CAST(event_id AS VARCHAR) || '.sql'
       WHEN event_id % 19 = 0 THEN 'other/backups/database/' || strftime(ts, '%Y/%m/%d') || '/db-' || event_type || '_' || CAST(event_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d-%H%M%S') || '.sql.gz'
       ELSE 'site/backups/database/' || strftime(ts, '%Y/%m/%d') || '/db-' || event_type || '_' || CAST(event_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d-%H%M%S') || '.sql.gz' END AS key,
  CASE WHEN event_id % 31 = 0 THEN 'n/a' ELSE CAST(CAST(floor(abs(value) * 1000) AS BIGINT) AS VARCHAR) END AS size_bytes,
  CASE WHEN event_id % 23 = 0 THEN 'not a time' WHEN event_id % 29 = 0 THEN ''
       ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS last_modified
FROM events
"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per event; ``error`` events are failed runs. Some dates are
    empty or unparseable."""
    ev = load(spark, sf_dir, "events")
    ok = ev.event_type != "error"
    db = F.concat(F.lit("db"), (ev.user_id % 3).cast("string"))
    created = (F.when(ev.event_id % 29 == 0, F.lit(""))
               .when(ev.event_id % 31 == 0, F.lit("not-a-date"))
               .otherwise(iso_text(ev.ts)))
    return ev.select(
        ev.event_id.alias("seq"), ok.alias("success"), created.alias("created_at"), db.alias("database_name"),
        F.when(ev.event_id % 2 == 0, F.lit("jdbc")).otherwise(F.lit("files")).alias("backend"),
        F.when(ok, F.concat(F.lit("b"), (ev.user_id % 8).cast("string"))).alias("bucket"),
        F.when(ok, backup_key(F.lit("site"), db, ev.ts)).alias("key"),
        F.when(ok, F.floor(F.abs(ev.value) * 1000).cast("long")).alias("size_bytes"),
        F.when(ok, F.lit(K.MSG_AUTO_OK)).otherwise(F.lit(K.MSG_AUTO_FAILED)).alias("message"))


HISTORY_SQL = """
SELECT event_id AS seq, event_type <> 'error' AS success,
  CASE WHEN event_id % 29 = 0 THEN '' WHEN event_id % 31 = 0 THEN 'not-a-date'
       ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS created_at,
  'db' || CAST(user_id % 3 AS VARCHAR) AS database_name,
  CASE WHEN event_id % 2 = 0 THEN 'jdbc' ELSE 'files' END AS backend,
  CASE WHEN event_type <> 'error' THEN 'b' || CAST(user_id % 8 AS VARCHAR) END AS bucket,
  CASE WHEN event_type <> 'error' THEN 'site/backups/database/' || strftime(ts, '%Y/%m/%d') || '/db-db'
       || CAST(user_id % 3 AS VARCHAR) || '-' || strftime(ts, '%Y%m%d-%H%M%S') || '.sql.gz' END AS key,
  CASE WHEN event_type <> 'error' THEN CAST(floor(abs(value) * 1000) AS BIGINT) END AS size_bytes,
  CASE WHEN event_type <> 'error' THEN 'Automatic backup completed successfully.'
       ELSE 'Automatic database backup failed.' END AS message
FROM events
"""


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One settings map per customer, with every kind of bad value."""
    c = load(spark, sf_dir, "customer")
    sched = (F.when(c.c_custkey % 5 == 0, F.lit("daily")).when(c.c_custkey % 5 == 1, F.lit("DAILY"))
             .when(c.c_custkey % 5 == 2, F.lit("weekly")).when(c.c_custkey % 5 == 3, F.lit(" dai ly")))
    odd = (F.when(c.c_custkey % 4 == 0, F.lit("\t7")).when(c.c_custkey % 4 == 1, F.lit("7\n"))
           .when(c.c_custkey % 4 == 2, F.lit("\r\n8\x00")).otherwise(F.lit("\x0b9 ")))
    keep = (F.when(c.c_custkey % 7 == 3, odd).when(c.c_custkey % 9 == 0, F.lit("0")).when(c.c_custkey % 9 == 1, c.c_nationkey.cast("string"))
            .when(c.c_custkey % 9 == 2, F.lit("-1")).when(c.c_custkey % 9 == 3, F.lit("1.5"))
            .when(c.c_custkey % 9 == 4, F.lit(" 7 ")).when(c.c_custkey % 9 == 5, F.lit("+5"))
            .when(c.c_custkey % 9 == 6, F.lit("007")).when(c.c_custkey % 9 == 7, F.lit("92233720368547758070"))
            .otherwise(F.lit("invalid")))
    opts = F.create_map(F.lit("region"), F.lower(c.c_mktsegment),
                        F.lit("bucket"), F.concat(F.lit("bk"), c.c_nationkey.cast("string")),
                        F.lit("prefix"), F.when(c.c_custkey % 3 == 0, F.lit("\t/site/\r\n")).otherwise(F.lit("/site/")),
                        F.lit("backup_schedule"), sched,
                        F.lit("retention_keep_count"), keep)
    return c.select("c_custkey", opts.alias("options"))


SETTINGS_SQL = """
SELECT c_custkey,
  lower(c_mktsegment) AS region, 'bk' || CAST(c_nationkey AS VARCHAR) AS bucket,
  CASE WHEN c_custkey % 3 = 0 THEN chr(9) || '/site/' || chr(13) || chr(10) ELSE '/site/' END AS prefix,
  CASE c_custkey % 5 WHEN 0 THEN 'daily' WHEN 1 THEN 'DAILY' WHEN 2 THEN 'weekly' WHEN 3 THEN ' dai ly' END AS backup_schedule,
  CASE WHEN c_custkey % 7 = 3 THEN CASE c_custkey % 4 WHEN 0 THEN chr(9) || '7' WHEN 1 THEN '7' || chr(10)
       WHEN 2 THEN chr(13) || chr(10) || '8' || chr(0) ELSE chr(11) || '9 ' END ELSE
  CASE c_custkey % 9 WHEN 0 THEN '0' WHEN 1 THEN CAST(c_nationkey AS VARCHAR) WHEN 2 THEN '-1' WHEN 3 THEN '1.5'
       WHEN 4 THEN ' 7 ' WHEN 5 THEN '+5' WHEN 6 THEN '007' WHEN 7 THEN '92233720368547758070'
       ELSE 'invalid' END END AS retention_keep_count
FROM customer
"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One backup job per customer; some lack a region or a bucket."""
    c = load(spark, sf_dir, "customer")
    region = F.when(c.c_nationkey % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("eu-"), F.lower(c.c_mktsegment)))
    bucket = F.when(c.c_custkey % 7 == 0, F.lit(None).cast("string")) \
        .otherwise(F.concat(F.lit("bk"), c.c_nationkey.cast("string")))
    return c.select("c_custkey", region.alias("region"), bucket.alias("bucket"))


JOBS_SQL = """
SELECT c_custkey,
  CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE 'eu-' || lower(c_mktsegment) END AS region,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'bk' || CAST(c_nationkey AS VARCHAR) END AS bucket
FROM customer
"""
