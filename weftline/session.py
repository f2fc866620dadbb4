"""Session settings and the durable cut points used by multi-pass jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every job here relies on (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, whose
    single machine is the cluster, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(configured)
    return configured


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and continue from there.

    Used where two passes must see the very same partitioning, e.g. counts per
    range partition and the rows of that partition. Survives executor loss.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Rounds:
    """Tables handed from round to round, as Parquet in the shared folder.

    The table of a name is deleted as soon as the next one of that name stands,
    so an iterative job holds two rounds at most, compressed, in a session with
    any settings; shuffle files go with the job that wrote a table. What was
    kept under a name last stays until ``close``.
    """

    #: A job's shuffle files are of no use once its table stands; without this they wait for the driver's garbage collector.
    _CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._folder = f"{ensure_checkpoint_dir(spark)}/rounds-{uuid.uuid4().hex}"
        self._made = 0
        self._held: dict[str, str] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` and go on from the written table."""
        self._made += 1
        folder = f"{self._folder}/{name}-{self._made}"
        before = self._spark.conf.get(self._CLEANUP, "false")
        self._spark.conf.set(self._CLEANUP, "true")
        try:
            df.write.parquet(folder)
        finally:
            self._spark.conf.set(self._CLEANUP, before)
        self.drop(name)
        self._held[name] = folder
        return self._spark.read.schema(df.schema).parquet(folder)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self._held:
                remove_folder(self._spark, self._held.pop(name))

    def close(self) -> None:
        """Delete everything; only once no result needs it."""
        self.drop(*list(self._held))
        remove_folder(self._spark, self._folder)
