"""Run history: latest entries, last success, keyed records, job and settings
normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .. import schemas
from ..functions.dates import history_date
from ..functions.numbers import keep_count


def latest_history(history: DataFrame, n: int = K.HISTORY_LENGTH) -> DataFrame:
    """T5: the ``n`` newest entries by insertion sequence (newest first).
    ``orderBy().limit()`` runs as a per-task top-N merged once."""
    return history.orderBy(F.col("seq").desc()).limit(n)


def successful(history: DataFrame) -> DataFrame:
    """successful runs with a non-empty date."""
    return history.filter(F.coalesce(F.col("success"), F.lit(False))
                          & (F.coalesce(F.col("created_at"), F.lit("")) != ""))


def last_success(history: DataFrame, window: int | None = K.HISTORY_LENGTH,
                 by: list[str] | None = None, tz: str = "UTC") -> DataFrame:
    """The newest successful run, as ``seq, created_at, label``.

    With ``window`` only the newest ``window`` entries are looked at, as the
    stored history holds no more (20 failures in a row give ``None``). The
    first match decides: an unparseable date gives ``Unknown``, the search
    does not go on. ``by`` gives one row per group.

    The newest run per group is found with hash aggregation only: ``max(seq)``
    per group, then a left-semi join back on ``(group, seq)`` (``seq`` is
    unique); the per-group maxima are broadcast when adaptive execution sees
    they are small."""
    src = latest_history(history, window) if window else history
    ok = successful(src)
    keys = list(by or [])
    newest = ok.groupBy(*keys).agg(F.max("seq").alias("seq"))
    picked = ok.join(newest, keys + ["seq"], "left_semi") \
        .select(*keys, "seq", "created_at", history_date(F.col("created_at"), tz, "unknown").alias("label"))
    if by:
        return picked
    # one global answer, ``None`` when there is no successful run
    one = picked.unionByName(
        ok.sparkSession.range(1).select(F.lit(None).cast("long").alias("seq"),
                                        F.lit(None).cast("string").alias("created_at"),
                                        F.lit(K.LABEL_NONE).alias("label")))
    return one.orderBy(F.col("seq").desc_nulls_last()).limit(1)


def history_to_json(history: DataFrame) -> DataFrame:
    """A3: ``seq, value`` with the keyed record of each entry as JSON."""
    rec = F.struct(F.col("success").alias("success"), F.col("created_at").alias("createdAt"),
                   F.col("database_name").alias("databaseName"), F.col("backend").alias("backend"),
                   F.col("bucket").alias("bucket"), F.col("key").alias("key"),
                   F.col("size_bytes").alias("sizeBytes"), F.col("message").alias("message"))
    return history.select("seq", F.to_json(rec, {"ignoreNullFields": "false"}).alias("value"))


def parse_history(records: DataFrame) -> DataFrame:
    """F8 + A3: entries back from ``seq, value`` JSON; malformed records
    (not a JSON object) are skipped."""
    parsed = records.select("seq", F.from_json("value", schemas.HISTORY_RECORD,
                                               {"mode": "PERMISSIVE"}).alias("r"),
                            F.col("value").startswith("{").alias("__obj"))
    ok = parsed.filter(F.col("r").isNotNull() & F.col("__obj"))
    return ok.select("seq", F.col("r.success").alias("success"), F.col("r.createdAt").alias("created_at"),
                     F.col("r.databaseName").alias("database_name"), F.col("r.backend").alias("backend"),
                     F.col("r.bucket").alias("bucket"), F.col("r.key").alias("key"),
                     F.col("r.sizeBytes").alias("size_bytes"), F.col("r.message").alias("message"))


def gate_jobs(jobs: DataFrame) -> DataFrame:
    """a job runs only when region and bucket are both non-empty; else it
    becomes a failed, skipped run with the fixed message."""
    region = F.coalesce(F.col("region"), F.lit(""))
    bucket = F.coalesce(F.col("bucket"), F.lit(""))
    runnable = F.least(F.length(region), F.length(bucket)) > 0
    return jobs.withColumn("runnable", runnable) \
        .withColumn("message", F.when(runnable, F.lit(None).cast("string")).otherwise(F.lit(K.MSG_SETTINGS_MISSING)))


def normalise_settings(df: DataFrame, options: str = "options") -> DataFrame:
    """F9 + A2 + M1: typed settings from a ``map<string,string>`` column.
    Missing keys read as ``''``; a schedule other than ``disabled``/``daily``
    becomes ``disabled`` (after key sanitising: lower case, only
    ``a-z0-9_-`` kept); the keep count goes through M1."""
    get = lambda k: F.coalesce(F.element_at(F.col(options), F.lit(k)), F.lit(""))
    sched = F.regexp_replace(F.lower(get("backup_schedule")), K.SETTING_KEY_STRIP, "")
    sched = F.when(sched.isin(*K.SCHEDULE_VALUES), sched).otherwise(F.lit(K.SCHEDULE_DISABLED))
    rest = [c for c in df.columns if c != options]
    return df.select(*rest,
                     F.btrim(get("region"), F.lit(K.TRIM_CHARACTERS)).alias("region"),
                     F.btrim(get("bucket"), F.lit(K.TRIM_CHARACTERS)).alias("bucket"),
                     F.btrim(get("prefix"), F.lit(K.TRIM_CHARACTERS)).alias("prefix"),
                     sched.alias("backup_schedule"),
                     keep_count(F.element_at(F.col(options), F.lit("retention_keep_count"))).alias("retention_keep_count"))
