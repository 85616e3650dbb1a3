"""A rolling latest-N history fed by a stream of run entries.

Each micro-batch is merged with the newest whole version *below* its batch id
and written as the version of that id, so a replayed batch reads what it read
before and rewrites only itself. A version counts once it has its ``_SUCCESS``
file; the last two are kept, older ones removed. The state kept is N rows,
whatever the stream's length. The path belongs to one stream checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import schemas
from ..session import remove_path


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions under ``path``, sorted."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()
                  and fs.exists(hadoop.Path(f"{path.rstrip('/')}/{n}/_SUCCESS")))


def _read_version(spark: SparkSession, path: str, version: int | None) -> DataFrame:
    if version is None:
        return spark.createDataFrame([], schemas.HISTORY)
    return spark.read.schema(schemas.HISTORY).parquet(f"{path.rstrip('/')}/v={version}")


def read_rolling(spark: SparkSession, path: str) -> DataFrame:
    return _read_version(spark, path, max(_versions(spark, path), default=None))


def history_stream(entries: DataFrame, path: str, checkpoint: str, n: int = K.HISTORY_LENGTH,
                   available_now: bool = True):
    """Start the stream; returns the ``StreamingQuery``."""
    def merge(batch: DataFrame, epoch: int):
        spark = batch.sparkSession
        below = [v for v in _versions(spark, path) if v < epoch]
        current = _read_version(spark, path, max(below, default=None))
        top = (current.unionByName(batch.select(*current.columns))
               .orderBy(F.col("seq").desc()).limit(n))
        top.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/v={epoch}")
        for old in below[:-1]:
            remove_path(spark, f"{path.rstrip('/')}/v={old}")

    w = entries.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
