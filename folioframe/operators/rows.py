"""Row plumbing: ordinals, positional joins, windows of rows, resumable results, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.plans.staging import stage


def with_ordinal(df: DataFrame, order: list[str], out: str = "ordinal", start: int = 1) -> DataFrame:
    """Number all rows in the order of unique columns, without moving them into one task.

    Rows are range-partitioned and written once, so a row's range stays the
    same in both uses; only the ranges' sizes are summed up.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    base = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return (
        ranged.withColumn("__in", inside)
        .join(F.broadcast(base), "__part")  # as many rows as partitions
        .withColumn(out, F.col("__base") + F.col("__in") + F.lit(start - 1))
        .drop("__part", "__base", "__in")
    )


def positional_join(left: DataFrame, right: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Rows of equal ordinals side by side; the longer input is cut."""
    return left.join(right, ordinal, "inner")


def row_window(df: DataFrame, ordinal: str, offset: int, limit: int | None) -> DataFrame:
    """Rows offset < ordinal <= offset + limit (1-based)."""
    cond = F.col(ordinal) > offset
    return df.filter(cond if limit is None else cond & (F.col(ordinal) <= offset + limit))


def first_successes(df: DataFrame, ok: str, ordinal: str, limit: int) -> DataFrame:
    """The first ``limit`` rows in ordinal order for which ``ok`` holds (skipped rows don't count)."""
    return df.filter(ok).orderBy(ordinal).limit(limit)


def last_results(stored: DataFrame, key: str, order: str) -> DataFrame:
    """Last stored row per integer key."""
    fields = [c for c in stored.columns if c != key]
    best = stored.withColumn(key, F.col(key).try_cast("bigint")).filter(F.col(key).isNotNull())
    best = best.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("__row"))
    return best.select(key, *[F.col("__row")[c].alias(c) for c in fields])


def pending(inputs: DataFrame, stored: DataFrame, key: str, order: str) -> DataFrame:
    """Inputs without a stored result, or whose last one is an error."""
    done = last_results(stored, key, order).filter("error is null").select(key)
    return inputs.join(done, key, "left_anti")


def merged_results(stored: DataFrame, fresh: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the fresh result where there is one, else the last stored one."""
    old = last_results(stored, key, order).join(fresh.select(key), key, "left_anti")
    return old.unionByName(fresh)


def page_sample(pages: DataFrame, by: list[str], order: str, k: int, seed: int = 0) -> DataFrame:
    """k rows per group chosen by hash, the same ones on every run."""
    w = Window.partitionBy(*by).orderBy(F.xxhash64(*by, order, F.lit(seed)), F.col(order))
    return pages.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")

