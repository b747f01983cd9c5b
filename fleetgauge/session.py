"""Session helpers. On a cluster the given session is used as it is."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}


def local_session(cpus: int = 8, app: str = "fleetgauge", memory: str = "20g") -> SparkSession:
    """Session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for tables that outlive a task.

    The one the cluster names in ``spark.checkpoint.dir``; only in local mode (tests on one machine),
    where that is unset, a temporary one.
    """
    context = spark.sparkContext
    folder = (spark.conf.get("spark.checkpoint.dir", None)
              or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir())
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
    app = context.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="fleetgauge-")
    return _LOCAL_FOLDERS[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a written table: computed once, lineage cut, readable by any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fleetgauge-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
