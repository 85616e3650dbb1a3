"""P7 status report and P8 history report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.dates import epoch_display, epoch_seconds, history_date, next_daily_run
from ..functions.keys import object_uri
from ..functions.labels import retention_label, schedule_label, status_label
from ..functions.numbers import size_label
from ..operators.history import last_success, latest_history


def history_report(history: DataFrame, tz: str = "UTC", n: int | None = K.HISTORY_LENGTH) -> DataFrame:
    """The seven display columns of the newest ``n`` entries (all when
    ``n`` is None): date, status, database, backend, size, object, message."""
    src = latest_history(history, n) if n else history
    return src.select(
        "seq",
        history_date(F.col("created_at"), tz, "raw").alias("date"),
        status_label(F.col("success")).alias("status"),
        F.coalesce(F.col("database_name"), F.lit(K.LABEL_MISSING)).alias("database"),
        F.coalesce(F.col("backend"), F.lit(K.LABEL_MISSING)).alias("backend"),
        size_label(F.col("size_bytes")).alias("size"),
        object_uri(F.col("bucket"), F.col("key")).alias("s3_object"),
        F.coalesce(F.col("message"), F.lit("")).alias("message"))


def status_report(history: DataFrame, settings: DataFrame, now_col, tz: str = "UTC",
                  window: int | None = K.HISTORY_LENGTH, by: list[str] | None = None) -> DataFrame:
    """Per settings row: schedule, next run, retention, last success and
    backend labels. ``settings`` holds normalised settings (F9/M1) and a
    ``backend`` column; ``now_col`` is the clock as a column. With ``by`` the
    last success is looked up per group (e.g. per database), joined on it."""
    nxt = F.when(F.col("backup_schedule") == K.SCHEDULE_DAILY,
                 epoch_display(epoch_seconds(next_daily_run(now_col, tz)), tz)).otherwise(F.lit(K.LABEL_NONE))
    base = settings.select(
        *(by or []),
        schedule_label(F.col("backup_schedule")).alias("schedule"),
        nxt.alias("next_backup"),
        retention_label(F.col("retention_keep_count")).alias("retention"),
        F.coalesce(F.col("backend"), F.lit(K.LABEL_UNKNOWN)).alias("backend"))
    last = last_success(history, window, by, tz)
    if by:
        # per-group lookup: both sides are one row per group
        joined = base.join(last.select(*by, F.col("label").alias("last_success")), by, "left")
        return joined.withColumn("last_success", F.coalesce(F.col("last_success"), F.lit(K.LABEL_NONE)))
    # a single history: its one row is attached by a join on a constant
    one = last.select(F.lit(1).alias("_one"), F.col("label").alias("last_success"))
    return base.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")
