"""Session helpers: building a session for tests and local runs, and finding the
shared folder used to cut lineage and to stage intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_SCRATCH: dict[str, list[str]] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tablekeep") -> SparkSession:
    """A local session with the settings every job here assumes: UTC clock,
    adaptive execution on, UI off."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The value is read from the session. Only when it is unset on a local
    master (tests) is a folder of our own set; on a cluster executors could
    not read it, so there an unset folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not conf and not sc.master.split("[")[0] == "local":
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
    if not conf:
        conf = tempfile.mkdtemp(prefix="tablekeep-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder, for staged tables and
    job outputs that other tasks or jobs must be able to read."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/tablekeep-{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Remove everything staged by this application so far. Results that are
    not computed yet may read staged tables: call it when a job has ended."""
    for path in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        remove_path(spark, path)


def local_path(path: str) -> str:
    """Strip a file: scheme so Python-side helpers can touch local test paths."""
    if path.startswith("file:"):
        path = path[5:]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (``addPyFile`` of a
    zip of it), for the few steps that run Python on executors: the deleter
    and the stateful stream functions. Done once per session."""
    import zipfile
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    fd, zpath = tempfile.mkstemp(prefix="tablekeep-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    atexit.register(lambda: os.path.exists(zpath) and os.remove(zpath))
    _SHIPPED.add(key)


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder through its Hadoop file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))

