"""Session set-up and tables written once to the cluster's shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "ruleflow", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the session is given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("RULEFLOW_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="ruleflow-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables of one job below the shared scratch folder, removed together when the job's result is stored.

    ``with Scratch(spark, "job") as scratch`` removes them on leaving; results that are read later must be
    stored outside, with ``materialize``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = scratch_path(spark, name)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as one table of the job and read it back; ``name`` must be new in this job."""
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        remove_path(self.spark, self.path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.remove()


def _located(spark: SparkSession, path: str) -> tuple:
    """A path and the file system it is on."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, files = _located(spark, path)
    return files.exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is on."""
    target, files = _located(spark, path)
    files.delete(target, True)


def rename_path(spark: SparkSession, path: str, target: str) -> None:
    """Move a folder on its own file system; fails if the target exists or the move does."""
    source, files = _located(spark, path)
    end, _ = _located(spark, target)
    if files.exists(end) or not files.rename(source, end):
        raise FileExistsError(target)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage on shared storage, so a lost executor re-reads instead of recomputing, and the
    columnar file keeps column pruning and gives the optimizer a real size for its join choices.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, column: str, buckets: int, name: str) -> DataFrame:
    """``materialize`` in buckets of ``column``: joins, windows and aggregations on it read without an exchange.

    ``df`` should come in as many hash partitions of the column, so that each task writes one file. The
    table is external: dropping it, or ending the session, leaves the files to the scratch folder.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).sortBy(column).option("path", scratch_path(spark, name)).saveAsTable(table)
    return spark.table(table)
