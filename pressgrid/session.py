"""Session settings the operators rely on, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings (all changeable on a live session).  AQE re-plans joins from
# real sizes, coalesces small shuffle partitions and splits skewed ones; the
# forced form also splits a skewed join when that costs one more exchange.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, app: str = "pressgrid", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a temporary folder; on a cluster a missing setting is an error,
    because a machine-local path would be lost with its executor.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if not getattr(shared_dir, "_local", None):
        shared_dir._local = tempfile.mkdtemp(prefix="pressgrid-")
    return shared_dir._local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder for one run's tables."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _hadoop_path(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def folder_done(spark: SparkSession, path: str) -> bool:
    """Whether a Spark job has finished writing ``path``."""
    files, place = _hadoop_path(spark, f"{path}/_SUCCESS")
    return files.exists(place)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    files, place = _hadoop_path(spark, path)
    return [s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()] if files.exists(place) else []


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder this library wrote, wherever it lies."""
    files, place = _hadoop_path(spark, path)
    files.delete(place, True)
