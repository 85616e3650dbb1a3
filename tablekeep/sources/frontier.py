"""File listings made by executors, and views pinned to a listing.

Spark's own file sources list on the driver and hold every file there. Here a
listing is a table: a frontier of folders is listed by tasks, the files found
are written, the folders found are the next frontier, until there are none.
The driver holds a count per round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package
from .single import _filesystem

FILES = "path string, length long, modified_us long"
_FOUND = "path string, folder boolean, length long, modified_us long"
BATCH = 10_000
#: A pinned table's manifest is broadcast up to this many files.
BROADCAST_FILES = 100_000


def _listed(frontier: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                files, name = _filesystem(folder)
                prefix = folder[:len(folder) - len(name)] if folder.endswith(name) else "file:"
                infos = files.get_file_info(pafs.FileSelector(name, recursive=False, allow_not_found=True))
                for at in range(0, len(infos), BATCH):
                    part = infos[at:at + BATCH]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([prefix + i.path for i in part]), pa.array([i.type == pafs.FileType.Directory for i in part]),
                         pa.array([i.size or 0 for i in part], pa.int64()),
                         pa.array([(i.mtime_ns or 0) // 1000 for i in part], pa.int64())], names=["path", "folder", "length", "modified_us"])
    return frontier.mapInArrow(run, _FOUND)


def list_files(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """``path, length, modified_us`` of every file below ``root``, staged. One
    round per level of folders; a folder is listed by one task. Names that
    begin with ``_`` or ``.`` are left out, as Spark's sources do, unless
    ``hidden``."""
    ship_package(spark)
    frontier = spark.createDataFrame([(root.rstrip("/"),)], "path string")
    staged: list[str] = []
    while True:
        at = scratch_path(spark, "frontier")
        found = _listed(frontier)
        if not hidden:
            found = found.filter(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]"))
        found.write.partitionBy("folder").parquet(at)
        staged.append(at)
        folders = spark.read.schema(_FOUND).parquet(at).filter("folder").select("path")
        n = folders.count()
        if not n:
            break
        frontier = folders.repartition(min(n, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)), "path")
    out = spark.read.schema(_FOUND).parquet(staged[0])
    for at in staged[1:]:
        out = out.unionByName(spark.read.schema(_FOUND).parquet(at))
    return out.filter("not folder").select("path", "length", "modified_us")


class PinnedView:
    """The files of a folder of tables as they were at one time. Rows come from
    those files only, however many are added after; a file that was replaced
    or changed since fails the task that reads it."""

    def __init__(self, spark: SparkSession, path: str, suffix: str = ".parquet") -> None:
        self.spark, self.path, self.suffix = spark, path.rstrip("/"), suffix
        at = scratch_path(spark, "pinned")
        files = list_files(spark, path)
        bare = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/")
        base = F.lit("/" + self.path.split(":", 1)[-1].lstrip("/") if ":" in self.path else self.path)
        name = F.regexp_replace(F.split(bare.substr(F.length(base) + 2, F.length(bare)), "/")[0], r"\.[^.]*$", "")
        files.select(name.alias("table_name"), bare.alias("file"), "length", "modified_us").write.parquet(at)
        self.manifest = spark.read.parquet(at)

    def table_names(self) -> list[str]:
        return sorted(r[0] for r in self.manifest.select("table_name").distinct().collect())

    @staticmethod
    def _is_file(path: str) -> bool:
        from pyarrow import fs as pafs
        files, name = _filesystem(path)
        return files.get_file_info(name).type == pafs.FileType.File

    def load(self, name: str) -> DataFrame:
        """The pinned rows of one table: its scan joined to the manifest on the
        file each row comes from."""
        pinned = self.manifest.filter(F.col("table_name") == name).select("file", "length", "modified_us")
        if pinned.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES:
            pinned = F.broadcast(pinned)
        where = f"{self.path}/{name}{self.suffix}"
        now = list_files(self.spark, where).select(F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/").alias("file"))
        gone = self.manifest.filter(F.col("table_name") == name).join(now, "file", "left_anti").select("file").take(1)
        if gone and not self._is_file(where):
            raise FileNotFoundError(f"gone since it was pinned: {gone[0].file}")
        df = self.spark.read.parquet(where)
        file = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/")
        rows = df.select("*", file.alias("__file"), F.col("_metadata.file_size").alias("__size"),
                         F.unix_millis(F.col("_metadata.file_modification_time")).alias("__ms"))
        joined = rows.join(pinned, F.col("__file") == F.col("file"))
        same = (F.col("__size") == F.col("length")) & (F.col("__ms") == F.floor(F.col("modified_us") / 1000))
        kept = F.when(same, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("file changed since it was pinned: "), F.col("file"))).cast("boolean"))
        return joined.filter(kept).select(*df.columns)

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.load(n) for n in self.table_names()}
