"""Session helpers: table reads and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can write to: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a session whose tasks all run in this process (tests)
    gets a temporary folder that goes with the process; on a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="folioframe-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders this process has staged and not dropped yet.
_STAGED: list[str] = []


def new_folder(spark: SparkSession, label: str) -> str:
    folder = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _STAGED.append(folder)
    return folder


def release(spark: SparkSession) -> int:
    """Drop all folders staged so far; call it once results that read them are written. Gives their number."""
    dropped = len(_STAGED)
    while _STAGED:
        drop_folder(spark, _STAGED.pop())
    return dropped


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Unlike ``checkpoint()`` the plan runs a single time; the result survives
    the loss of any executor.
    """
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """``df`` on at least as many tasks as the session has cores: one small file with a single row group is one task otherwise.

    For scans (a plan with a shuffle would be run to count its tasks) before steps whose work per row is far above
    that of moving it. Inputs with more splits than cores stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rename_folder(spark: SparkSession, old: str, new: str) -> None:
    """Single-step publish: the target must not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(old)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    target = spark._jvm.org.apache.hadoop.fs.Path(new)
    if fs.exists(target) or not fs.rename(path, target):
        raise IOError(f"cannot publish {new}")
