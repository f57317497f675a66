"""Ranks of rows without a task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialise


def rank_within(rows: DataFrame, by: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    """Adds ``name``: the place of a row, from 1, within its ``by`` group (all rows without one).

    Rows are dealt over ranges of group and order; what stands before a range is a sum over a row
    per range and group. So neither a single group nor a hot one is bound to one task. ``order``
    should leave no ties.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialise(rows.repartitionByRange(parts, *by, *order).withColumn("rank_part", F.spark_partition_id()), "ranks")
    counts = dealt.groupBy(*by, "rank_part").agg(F.count("*").alias("rank_n"))
    earlier = Window.partitionBy(*by).orderBy("rank_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("rank_before", F.coalesce(F.sum("rank_n").over(earlier), F.lit(0))).drop("rank_n")
    counts = counts.toDF(*(f"rank_by_{i}" for i in range(len(by))), "rank_of", "rank_before")
    same = F.col("rank_part") == F.col("rank_of")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"rank_by_{i}"))
    own = F.row_number().over(Window.partitionBy("rank_part", *by).orderBy(*order))
    ranked = dealt.withColumn(name, own).join(counts, same).withColumn(name, F.col(name) + F.col("rank_before"))
    return ranked.select(*rows.columns, name)


def running_within(rows: DataFrame, by: list[str], order: list[str], value: str, name: str = "running") -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the ``by`` group up to and with this one, without a task per group.

    As in ``rank_within``, what stands before a range is a sum over a row per range and group.
    ``order`` should leave no ties.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialise(rows.repartitionByRange(parts, *by, *order).withColumn("run_part", F.spark_partition_id()), "running")
    sums = dealt.groupBy(*by, "run_part").agg(F.sum(value).alias("run_n"))
    earlier = Window.partitionBy(*by).orderBy("run_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("run_before", F.coalesce(F.sum("run_n").over(earlier), F.lit(0))).drop("run_n")
    sums = sums.toDF(*(f"run_by_{i}" for i in range(len(by))), "run_of", "run_before")
    same = F.col("run_part") == F.col("run_of")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"run_by_{i}"))
    upto = Window.partitionBy("run_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn(name, F.sum(value).over(upto)).join(sums, same).withColumn(name, F.col(name) + F.col("run_before"))
    return out.select(*rows.columns, name)
