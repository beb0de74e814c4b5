"""Written intermediate tables: they cut lineage and survive lost executors."""

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"

_run_folder: ContextVar[str | None] = ContextVar("run_folder", default=None)


@lru_cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="feedlake-")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only a local session may go without one; it then gets a temporary folder.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    return _local_dir(spark.sparkContext.applicationId)


def new_path(spark: SparkSession, name: str) -> str:
    folder = _run_folder.get() or shared_dir(spark)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession, name: str):
    """What is staged inside lies in one folder, which goes at the end.

    Rows that outlive the run must be read from elsewhere.
    """
    path = new_path(spark, name)
    token = _run_folder.set(path)
    try:
        yield path
    finally:
        _run_folder.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int, rows: int | None = None) -> DataFrame:
    """Broadcast df when its row count proves it small, else leave the plan open.

    Without a known count df is counted, which is cheap for written or fixed tables.
    """
    if rows is None:
        rows = df.count()
    return F.broadcast(df) if rows <= max_rows else df
