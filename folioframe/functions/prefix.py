"""Running totals that never put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(
    df: DataFrame,
    group: list[str],
    bucket: Column,
    order: list[Column],
    value: str,
    out: str,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of ``group`` that come before the row.

    ``bucket`` must be monotone in ``order`` and take a bounded number of values
    (the per-bucket sums are joined back by ``group`` + bucket). A hot group is
    thus cut into its buckets; only bucket sums meet in one task. Null group
    values form their own group, null ``value`` counts as 0.
    """
    b, v = "__bucket", F.coalesce(F.col(value), F.lit(0))
    keyed = df.withColumn(b, bucket)
    sums = keyed.groupBy(*group, b).agg(F.sum(v).alias("__sum"))
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col(b).alias("__b"),
        F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"),
    )
    on = F.col(b) == F.col("__b")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inside = Window.partitionBy(*group, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = keyed.withColumn("__in", F.coalesce(F.sum(v).over(inside), F.lit(0))).join(base, on, "left")
    drop = [b, "__b", "__base", "__in", *[f"__g{i}" for i in range(len(group))]]
    return joined.withColumn(out, F.col("__base") + F.col("__in")).drop(*drop)
