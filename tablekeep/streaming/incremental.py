"""Scheduled export of newly arrived rows.

A file stream over a table folder with ``trigger(availableNow=True)`` is the
daily run: each run exports only the files that arrived since the last one
(the checkpoint remembers them), as INSERT text under ``batch=<id>/``. The
reference exports everything each time; exporting only new files is our
deviation, and a full export is ``plans.export.export_database``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import constants as K
from ..functions.literals import EXACT, Dialect
from ..operators import chunks


def incremental_export(stream: DataFrame, table: str, path: str, checkpoint: str,
                       size: int = K.DEFAULT_CHUNK_ROWS, dialect: Dialect = EXACT,
                       available_now: bool = True):
    """Start the stream; returns the ``StreamingQuery``. Each batch is written
    once to its own folder, so a replayed batch overwrites only itself."""
    def export(batch: DataFrame, epoch: int):
        recs = chunks.insert_records_streaming(batch, table, size, dialect)
        recs.write.mode("overwrite").option("compression", "gzip").text(f"{path.rstrip('/')}/batch={epoch}")

    w = stream.writeStream.foreachBatch(export).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 day")
    return w.start()
