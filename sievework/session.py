"""Session helpers."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package: its folder joins the module path they are started with. On a
    cluster the package is expected at the same path, installed, or shipped with ``--py-files``."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on one machine, for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the checkpoint folder set on the context. Without
    one a session on a single machine (tests) gets a folder under its warehouse; a cluster is refused, since a folder
    of the driver is no one else's."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/sievework-shared")
        path = spark.sparkContext.getCheckpointDir()
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the Python process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/sievework-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def durable(df: DataFrame, name: str = "part", path: str | None = None) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it back. A lost executor then
    costs the tasks it ran, not the whole history. The table goes when the Python process ends."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written[:] = [x for x in _written if x[1] != path]


@atexit.register
def _tidy() -> None:
    for spark, path in list(_written):
        try:
            remove(spark, path)
        except Exception:  # the session may have ended before the interpreter
            return
