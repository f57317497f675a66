"""Deterministic samples and splits: rows are ordered by a hash that any SQL engine can repeat."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..shared import materialise
from .ranks import rank_within

MOD = 2**31


def scramble(x: Column) -> Column:
    """31-bit hash of a long by shifts, exclusive or and products that never overflow."""
    x = F.pmod(x, F.lit(MOD))
    x = F.pmod(x.bitwiseXOR(F.shiftright(x, 15)) * 739982445, F.lit(MOD))
    x = F.pmod(x.bitwiseXOR(F.shiftright(x, 12)) * 695872825, F.lit(MOD))
    return x.bitwiseXOR(F.shiftright(x, 15))


def hash_order(seed: int, key: Column) -> Column:
    return scramble(key.cast("long") * 1812433253 + seed)


def random_rows(records: DataFrame, n: int, seed: int = 42, key: str = "row_idx") -> DataFrame:
    """n rows without replacement in order of key; all if there are no more."""
    picked = records.orderBy(hash_order(seed, F.col(key)), key).limit(n)
    return picked.orderBy(key)


def stratified_split(items: DataFrame, stratum: str, ratio: float = 0.2, seed: int = 42, key: str = "item_id") -> DataFrame:
    """Adds split: per stratum rint(n ratio) test rows, at least 1 and at most n - 1 where n >= 2."""
    ratio = max(0.05, min(0.5, ratio))
    s = F.coalesce(F.col(stratum).cast("string"), F.lit("__unlabeled__"))
    rows = items.withColumn("stratum", s)
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("n_stratum"))
    ranked = rank_within(rows.withColumn("at", hash_order(seed, F.col(key))), ["stratum"], ["at", key], "k").drop("at")
    n = F.col("n_stratum")
    test = F.when(n >= 2, F.greatest(F.lit(1.0), F.least((n - 1).cast("double"), F.rint(n * ratio)))).otherwise(F.rint(n * ratio))
    return ranked.join(sizes, "stratum").withColumn("split", F.when(F.col("k") <= test, "test").otherwise("train")).drop("k", "n_stratum")


def split_marginals(items: DataFrame, criteria: list[str]) -> DataFrame:
    """criterion, value, split, n."""
    long = items.select("split", F.explode(F.create_map(*[x for c in criteria for x in (F.lit(c), F.col(c).cast("string"))])).alias("criterion", "value"))
    return long.groupBy("criterion", "value", "split").agg(F.count("*").alias("n"))


def mmr_select(records: DataFrame, limit: int, lambda_: float = 0.6, key: str = "row_idx") -> DataFrame:
    """Per cluster the rows of maximal marginal relevance: key, cluster_id, pick (order of choice).

    The first pick is the row most like the cluster's centre; each further one has the largest
    ``lambda_`` times its likeness to the centre less ``1 - lambda_`` times its likeness to the
    nearest pick; the smallest key wins a tie. A cluster of no more than ``limit`` rows is taken whole,
    in order of key. One round of aggregation per pick serves all clusters, so no cluster is bound to
    one task. Zero vectors are like nothing; rows without an embedding or a cluster are never taken.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from .metrics import dot, unit

    u = F.coalesce(unit(F.col("embedding")), F.transform("embedding", lambda x: F.lit(0.0)))
    rows = materialise(records.where("embedding is not null and cluster_id is not null").select(key, "cluster_id", u.alias("u")), "mmr-rows")
    centre = vector_to_array(Summarizer.mean(F.col("v")))
    per = rows.withColumn("v", array_to_vector("u")).groupBy("cluster_id").agg(F.count("*").alias("n"), centre.alias("centre"))
    placed = rows.join(materialise(per, "mmr-centres"), "cluster_id")
    order = Window.partitionBy("cluster_id").orderBy(key)  # over at most ``limit`` rows
    few = placed.where(F.col("n") <= limit).select(key, "cluster_id", (F.row_number().over(order) - 1).alias("pick"))
    central = F.coalesce(dot(F.col("u"), unit(F.col("centre"))), F.lit(0.0))
    many = placed.where(F.col("n") > limit).select(key, "cluster_id", "u", central.alias("central"))

    picks = []
    for k in range(limit):
        free, score = many, F.col("central")
        if picks:
            taken = reduce(DataFrame.unionByName, picks).groupBy("cluster_id").agg(F.collect_list(F.struct(key, "u")).alias("p"))  # k of them
            free = many.join(taken, "cluster_id").where(~F.array_contains(F.col(f"p.{key}"), F.col(key)))
            near = F.array_max(F.transform("p.u", lambda w: dot(F.col("u"), w)))
            score = lambda_ * F.col("central") - (1 - lambda_) * near
        best = free.groupBy("cluster_id").agg(F.min(F.struct((-score).alias("s"), F.col(key))).alias("best")).select("cluster_id", F.col(f"best.{key}").alias(key))
        picks.append(materialise(rows.join(best, ["cluster_id", key]).select(key, "cluster_id", "u", F.lit(k).alias("pick")), "mmr-picks"))
    return reduce(DataFrame.unionByName, [p.drop("u") for p in picks], few)


def balanced_sample(records: DataFrame, per_cluster: int = 3, per_noise_label: int = 1, include_noise: bool = True, total: int | None = None, seed: int = 42, method: str = "random", key: str = "row_idx", lambda_: float = 0.6) -> DataFrame:
    """Rows per cluster and, for noise, per label; rows without an embedding are never taken."""
    real = records.where("cluster_id >= 0")
    if total:
        groups = real.agg(F.count_distinct("cluster_id").alias("g")).first().g or 1
        per_cluster = min(per_cluster, max(1, total // groups))
    if method == "mmr":
        out = mmr_select(real, per_cluster, lambda_, key).select(key, "cluster_id")
    else:
        rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(hash_order(seed, F.col(key)), key))
        out = real.withColumn("k", rank).where(F.col("k") <= per_cluster).select(key, "cluster_id")
    if include_noise:
        rank = F.row_number().over(Window.partitionBy("cluster_label").orderBy(hash_order(seed, F.col(key)), key))
        noise = records.where(F.col("cluster_id") == vocab.NOISE).withColumn("k", rank).where(F.col("k") <= per_noise_label)
        out = out.unionByName(noise.select(key, "cluster_id"))
    return out


def page(records: DataFrame, order: str, limit: int, offset: int = 0) -> DataFrame:
    return records.orderBy(order).offset(offset).limit(limit)
