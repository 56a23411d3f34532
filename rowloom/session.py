"""Session settings and the shared folder for data that must outlive a plan."""

from __future__ import annotations

import os
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a window or aggregate on (key, slice) must be shuffled by both, even where the
    # rows already lie by key: that is what spreads a hot key over many tasks
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    # a later map hides an earlier one key by key
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # "first n of each stream" drops rows before the shuffle, whatever n is
    "spark.sql.optimizer.windowGroupLimitThreshold": str(2**31 - 1),
}


def configure(spark: SparkSession) -> SparkSession:
    """Prepare an existing session: SQL settings the operators rely on, and this
    package on the executors."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_rowloom_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="rowloom-"), "rowloom"), "zip", os.path.dirname(package), "rowloom"
    )
    context.addPyFile(archive)
    context._rowloom_shipped = True


def local_session(cores: int = 8, shuffle_partitions: int | None = None, app: str = "rowloom") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a ``local[...]`` session may fall back to a temporary folder, because there the
    driver and the executors are one process; clusters of any kind must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_DIRS:
        _LOCAL_DIRS[application] = tempfile.mkdtemp(prefix="rowloom-")
    return _LOCAL_DIRS[application]


#: the temporary folder of each local application; the setting can't be changed while one runs
_LOCAL_DIRS: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for ``name`` in the shared folder, under the application's; never reused."""
    return f"{_scratch(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/rowloom"


def remove_scratch(spark: SparkSession, application: str | None = None, older_than_ms: int = 0) -> list[str]:
    """Remove the stored intermediate data of an application, this one unless another is named, or
    ``"*"`` for all but this one; only folders that are ``older_than_ms``. Plans that still read
    them, and tables that were written there, are lost. Returns the folders removed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(_scratch(spark))
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    own, now, gone = spark.sparkContext.applicationId, time.time() * 1000, []
    for status in files.listStatus(root):
        name = status.getPath().getName()
        asked = name != own if application == "*" else name == (application or own)
        if asked and status.getModificationTime() <= now - older_than_ms:
            files.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where a plan must not run twice (actions may have side effects) and to
    cut lineage. A parquet table keeps column pruning and survives the loss of
    any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
