"""Session settings and the shared folder every job writes its staged tables to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_FOLDER_SETTING = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **settings: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own through spark-submit."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hourgrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.sources.fileCompressionFactor", "3")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own: there, driver and executors
    are one machine. Anywhere else a missing setting is an error.
    """
    folder = spark.conf.get(SHARED_FOLDER_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {SHARED_FOLDER_SETTING} to a folder all executors can reach")
    application = spark.conf.get("spark.app.id")
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="hourgrid-")
    return _local_folders[application]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one staged table of this application."""
    return f"{shared_folder(spark)}/{spark.conf.get('spark.app.id')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and continue from the written table.

    Used where a result is read several times: the plan below runs once, later stages prune columns
    and row groups, a lost executor re-reads files instead of recomputing, and Spark knows the real
    size when it decides about broadcasts.
    """
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
