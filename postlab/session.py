"""SparkSession helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "postlab", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare_session(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``postlab`` importable in Python workers (grouped pandas functions reference it).

    The package is zipped once per SparkContext and distributed with ``addPyFile``.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import shutil

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="postlab-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "postlab"), "zip", os.path.dirname(pkg_dir), "postlab")
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def prepare_session(spark: SparkSession) -> str:
    """Checkpoint folder + package shipping; idempotent. Returns the checkpoint folder."""
    ship_package(spark)
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local-mode session (tests, laptops) without that setting gets a private folder;
    on a cluster a machine-local folder would be lost with its executor, so it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) on a cluster")
        configured = tempfile.mkdtemp(prefix="postlab-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


#: Spark deletes the shuffle files of a statement when it ends, instead of when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_RELEASING, _LOCK = {"depth": 0, "before": None}, threading.Lock()


@contextmanager
def shuffles_released(spark):
    """Statements begun inside delete their shuffle files at their end; for writes, whose plan nobody runs again."""
    with _LOCK:
        if not _RELEASING["depth"]:
            _RELEASING["before"] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _RELEASING["depth"] += 1
    try:
        yield
    finally:
        with _LOCK:
            _RELEASING["depth"] -= 1
            if not _RELEASING["depth"]:
                if _RELEASING["before"] is None:
                    spark.conf.unset(CLEANUP)
                else:
                    spark.conf.set(CLEANUP, _RELEASING["before"])


def written(df):
    """``df`` as a columnar table in the shared checkpoint folder: computed once, and later scans read only the columns they use.
    The shuffle files behind it are gone when it is there."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    with shuffles_released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
