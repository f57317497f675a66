"""Paired comparison of two runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab


def last_by_id(run: DataFrame, order: str = "row_idx") -> DataFrame:
    """Last row per trimmed dialog_id; blank ids go."""
    rows = run.withColumn("dialog_id", F.trim(F.col("dialog_id").cast("string"))).where(F.coalesce(F.col("dialog_id"), F.lit("")) != "")
    rest = [c for c in rows.columns if c != "dialog_id"]
    return rows.groupBy("dialog_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("dialog_id", *(F.col(f"r.{c}").alias(c) for c in rest))


def passed(accuracy: Column) -> Column:
    return F.coalesce(accuracy.cast("double"), F.lit(0.0)) >= 1.0


def change_type(a: Column, b: Column) -> Column:
    return F.when(a & b, "same_pass").when(~a & ~b, "same_fail").when(b, "improved").otherwise("regressed")


def paired(run_a: DataFrame, run_b: DataFrame, order: str = "row_idx") -> DataFrame:
    """dialog_id, in_a, in_b, pass_a, pass_b, change, category of the ids of either run, in one full join."""
    a = last_by_id(run_a, order).select("dialog_id", F.lit(True).alias("in_a"), passed(F.col("accuracy")).alias("pass_a"), F.col("category").alias("ca"))
    b = last_by_id(run_b, order).select("dialog_id", F.lit(True).alias("in_b"), passed(F.col("accuracy")).alias("pass_b"), F.col("category").alias("cb"))
    both = a.join(b, "dialog_id", "full").withColumn("in_a", F.coalesce("in_a", F.lit(False))).withColumn("in_b", F.coalesce("in_b", F.lit(False)))
    category = F.coalesce(F.nullif(F.trim("ca"), F.lit("")), F.nullif(F.trim("cb"), F.lit("")), F.lit(vocab.NO_CATEGORY))
    return both.select("dialog_id", "in_a", "in_b", "pass_a", "pass_b", F.when(F.col("in_a") & F.col("in_b"), change_type(F.col("pass_a"), F.col("pass_b"))).alias("change"), category.alias("category"))


def summary(pairs: DataFrame) -> DataFrame:
    both = F.col("in_a") & F.col("in_b")
    rate = lambda c: F.try_divide(F.count_if(both & F.col(c)), F.count_if(both))
    return pairs.agg(F.count_if(both).alias("n_common"), F.count_if(F.col("in_a") & ~F.col("in_b")).alias("only_a"), F.count_if(F.col("in_b") & ~F.col("in_a")).alias("only_b"), rate("pass_a").alias("rate_a"), rate("pass_b").alias("rate_b"), F.count_if(F.col("change") == "improved").alias("improved"), F.count_if(F.col("change") == "regressed").alias("regressed"))


def mcnemar(improved: Column, regressed: Column) -> Column:
    """Exact two-sided binomial test of two counts; null without a change.

    The sum runs in logarithms over at most the smaller count.
    """
    n, k = improved + regressed, F.least(improved, regressed)
    step = lambda acc, i: F.struct((acc["t"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))).alias("t"), (acc["s"] + F.exp(acc["t"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")) - n * math.log(2.0))).alias("s"))
    start = F.struct(F.lit(0.0).alias("t"), F.exp(-n * math.log(2.0)).alias("s"))
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(steps, start, step, lambda acc: acc["s"])
    return F.when(n > 0, F.least(F.lit(1.0), 2 * total))


def with_test(totals: DataFrame) -> DataFrame:
    return totals.withColumn("p_value", mcnemar(F.col("improved"), F.col("regressed")))


def by_category(pairs: DataFrame) -> DataFrame:
    g = pairs.where("in_a and in_b").groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("pass_a")).alias("pass_a"), F.count_if(F.col("pass_b")).alias("pass_b"), F.count_if(F.col("change") == "improved").alias("improved"), F.count_if(F.col("change") == "regressed").alias("regressed"))
    return g.select("*", (F.col("pass_b") - F.col("pass_a")).alias("net"), ((F.col("pass_b") - F.col("pass_a")) / F.col("n")).alias("delta"))
