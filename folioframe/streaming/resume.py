"""Resumable results as a stream: every batch replaces the stored rows of its keys.

Keys are hashed into a fixed number of buckets, one folder each. A micro-batch
rewrites the buckets its keys fall into, as new versions, and then publishes
one new pointer folder in a rename of the cluster's file system, so a repeated
batch (after a lost driver) gives the same table and readers see whole batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators.rows import last_results, merged_results
from folioframe.plans.staging import drop_folder, rename_folder

BUCKETS = 64


def _versions(spark: SparkSession, folder: str) -> list[str]:
    """Published pointers, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/current-*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(f.getPath().toString() for f in found)


def _pointer(spark: SparkSession, folder: str) -> dict[int, str]:
    """bucket -> folder of its rows, from the newest pointer (at most BUCKETS rows)."""
    versions = _versions(spark, folder)
    if not versions:
        return {}
    return {r["bucket"]: r["path"] for r in spark.read.schema("bucket int, path string").json(versions[-1]).collect()}


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    paths = sorted(set(_pointer(spark, folder).values()))
    return spark.read.parquet(*paths) if paths else None


def upsert(batch: DataFrame, batch_id: int, folder: str, key: str, order: str) -> None:
    """foreachBatch writer: the last row per key of the batch over the stored rows of the buckets it touches."""
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(BUCKETS)).cast("int")
    fresh = last_results(batch, key, order).withColumn("bucket", bucket)
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most BUCKETS
    if not touched:
        return
    pointer = _pointer(spark, folder)
    old = sorted({pointer[b] for b in touched if b in pointer})
    out = fresh
    if old:
        stored = spark.read.parquet(*old).withColumn("bucket", bucket)
        out = merged_results(stored, fresh.select(*stored.columns), key, order)
    version = f"{folder}/data-{batch_id:08d}"
    out.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(version)
    pointer |= {b: f"{version}/bucket={b}" for b in touched}
    published, waiting = f"{folder}/current-{batch_id:08d}", f"{folder}/_waiting-{batch_id:08d}"
    spark.createDataFrame(sorted(pointer.items()), "bucket int, path string").coalesce(1).write.mode("overwrite").json(waiting)
    drop_folder(spark, published)  # a repeated batch
    rename_folder(spark, waiting, published)


def resume_stream(stream: DataFrame, folder: str, checkpoint: str, key: str, order: str):
    """Start a query that keeps ``folder`` up to date until its input is used up."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, batch_id, folder, key, order)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
