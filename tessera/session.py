"""Session helper and tables kept between the stages of one operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, list[str]] = {}


def build_session(name: str = "tessera", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library expects on any cluster."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else a temporary one (tests, one machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder and (own := spark.sparkContext.getCheckpointDir()):
        folder = own
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/tessera-{os.getpid()}"
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended
        pass


def _remove_all(spark: SparkSession, app: str) -> None:
    for path in _folders.pop(app, []):
        if path.startswith("file:"):  # the session may have ended
            shutil.rmtree("/" + path[5:].lstrip("/"), ignore_errors=True)
        else:
            _remove(spark, path)


class Scratch:
    """Tables of one operator's run, written to the shared folder.

    A written table cuts the lineage and survives the loss of executors, which
    a cached or locally checkpointed one doesn't. Tables that the result still
    reads live until the session ends; others can be dropped earlier.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex[:12]}"
        app = spark.sparkContext.applicationId
        if app not in _folders:
            _folders[app] = []
            atexit.register(_remove_all, spark, app)
        _folders[app].append(self.base)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as a table and read it again."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        _remove(self.spark, self.path(name))
