"""Percentile bootstrap by counts: how often each level is drawn, without a row per draw.

Values are counted by level first. The counts of a replicate are multinomial, and that is drawn by
halving: of the n draws that fall among some levels, a binomial number falls among the lower half of
them. A binomial number is the quantile, at a uniform number, of its distribution around the mode;
the uniform numbers are digests of (seed, group, replicate, levels), so replicates are independent,
any engine can repeat them, and every task knows its own without asking another.

Levels lie in blocks of at most about ``BLOCK``; the draws of each block come from halving the
blocks the same way. So the work is levels times replicates, in as many tasks as there are blocks
and chunks of replicates, and all groups share one job.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialise
from .ranks import rank_within

BLOCK, CHUNK = 4096, 1000


def binomial_quantile(n: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """The smallest k with P(Binomial(n, p) <= k) >= u, for each n and u.

    The distribution is summed within 12 standard deviations of its mean, beyond which less than
    1e-30 lies, from ratios of neighbouring probabilities.
    """
    out = np.zeros(len(n), np.int64)
    if p >= 1:
        return n.astype(np.int64)
    for each in np.unique(n).tolist():
        own = np.flatnonzero(n == each)
        if not each or p <= 0:
            continue
        spread = 12 * math.sqrt(each * p * (1 - p)) + 12
        low, high = max(0, math.floor(each * p - spread)), min(each, math.ceil(each * p + spread))
        k = np.arange(low, high)
        log = np.concatenate([[0.0], np.cumsum(np.log((each - k) / (k + 1.0)) + math.log(p / (1 - p)))])
        mass = np.cumsum(np.exp(log - log.max()))
        out[own] = low + np.minimum(np.searchsorted(mass / mass[-1], u[own], side="left"), high - low)
    return out


def uniform(name: str, replicates: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """52 bits of a digest for each replicate, in [0, 1)."""
    return np.array([int(hashlib.md5(f"{name}:{b}:{lo}:{hi}".encode()).hexdigest()[:13], 16) for b in replicates.tolist()]) / 2.0**52


def halved(draws: np.ndarray, masses: np.ndarray, name: str, replicates: np.ndarray) -> np.ndarray:
    """(replicate, level): how many of each replicate's ``draws`` fall on each level of the given masses."""
    out = np.zeros((len(draws), len(masses)), np.int64)
    before = np.concatenate([[0], np.cumsum(masses)])
    stack = [(0, len(masses), draws)]
    while stack:
        lo, hi, n = stack.pop()
        if hi - lo == 1:
            out[:, lo] = n
        elif hi > lo:
            mid = (lo + hi) // 2
            k = binomial_quantile(n, float(before[mid] - before[lo]) / float(before[hi] - before[lo]), uniform(name, replicates, lo, hi))
            stack += [(lo, mid, k), (mid, hi, n - k)]
    return out


def _draw(blocks: dict[str, list[int]], replicates: int, seed: int, sums: bool):
    """One block of levels of a group for one chunk of replicates -> its sum of values, or the count of each level."""

    def work(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        group, part, chunk = (k.as_py() for k in key)
        rows = rows.sort_by("place")
        b = np.arange(chunk * CHUNK, min(replicates, (chunk + 1) * CHUNK))
        masses = np.array(blocks[group])
        n = np.full(len(b), masses.sum())
        if len(masses) > 1:
            n = halved(n, masses, f"{seed}:{group}:blocks", b)[:, part]
        k = halved(n, rows["m"].to_numpy(), f"{seed}:{group}:{part}", b)
        if sums:
            return pa.table([pa.array([group] * len(b), pa.string()), pa.array(b), pa.array(k @ rows["value"].to_numpy())], names=["g", "b", "total"])
        i, j = np.nonzero(k)
        return pa.table([pa.array([group] * len(i), pa.string()), pa.array(b[i]), rows["place"].take(pa.array(j)), pa.array(k[i, j])], names=["g", "b", "place", "k"])

    return work


def _drawn(levels: DataFrame, replicates: int, seed: int, sums: bool) -> DataFrame:
    """Draws from levels (g, place, m and, for sums, value), a written table; the order of place is that of the halves."""
    spark = levels.sparkSession
    n = levels.count()
    parts = max(1, min(-(-n // BLOCK), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if parts > 1:
        levels = materialise(levels.repartitionByRange(parts, "g", "place").withColumn("part", F.spark_partition_id()), "level-blocks")
    else:
        levels = levels.withColumn("part", F.lit(0))
    blocks: dict[str, list[int]] = {}
    number: dict[tuple, int] = {}
    for r in levels.groupBy("g", "part").agg(F.sum("m").alias("m")).orderBy("g", "part").collect():  # a row per block and group
        number[r.g, r.part] = len(blocks.setdefault(r.g, []))
        blocks[r.g].append(r.m)
    if parts > 1:
        own = spark.createDataFrame([(g, p, i) for (g, p), i in number.items()], "g string, part int, own int")
        levels = levels.join(F.broadcast(own), ["g", "part"]).drop("part").withColumnRenamed("own", "part")
    chunks = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // CHUNK)))
    schema = "g string, b long, total double" if sums else f"g string, b long, place {levels.schema['place'].dataType.simpleString()}, k long"
    return levels.withColumn("chunk", chunks).groupBy("g", "part", "chunk").applyInArrow(_draw(blocks, replicates, seed, sums), schema)


def resample(values: DataFrame, value: str, replicates: int, seed: int = 42) -> DataFrame:
    """b, value, k: how often each level of ``value`` is drawn in replicate b, levels of null aside."""
    rows = values.where(F.col(value).isNotNull()).select(F.col(value).alias("value"))
    levels = rows.groupBy("value").agg(F.count("*").alias("m"))
    levels = materialise(rank_within(levels.withColumn("g", F.lit("")), [], ["value"], "place"), "levels")
    got = _drawn(levels.drop("value"), replicates, seed, False)
    return got.join(levels.select("place", "value"), "place").select("b", "value", "k")


def bootstrap_mean(values: DataFrame, value: str, replicates: int = 5000, confidence: float = 0.95, seed: int = 42, by: str | None = None) -> DataFrame:
    """by, n, mean, low, high: percentile intervals with linear interpolation, one per group of ``by``.

    Without ``by`` it's one row, with null bounds where there is no value; null groups are left out.
    """
    replicates = max(100, replicates)
    alpha = (1 - confidence) / 2
    group = F.col(by).cast("string") if by else F.lit("")
    rows = values.select(group.alias("g"), F.col(value).cast("double").alias("value")).where("g is not null and value is not null")
    levels = materialise(rows.groupBy("g", F.col("value").alias("place")).agg(F.count("*").alias("m")).withColumn("value", F.col("place")), "levels")
    base = levels.groupBy("g").agg(F.sum("m").alias("n"), (F.sum(F.col("value") * F.col("m")) / F.sum("m")).alias("mean"))
    means = _drawn(levels, replicates, seed, True).groupBy("g", "b").agg(F.sum("total").alias("total"))
    means = means.join(F.broadcast(base.select("g", "n")), "g")  # a row per group
    bounds = means.groupBy("g").agg(F.percentile(F.col("total") / F.col("n"), F.array(F.lit(alpha), F.lit(1 - alpha))).alias("p"))
    out = base.join(F.broadcast(bounds), "g", "left").select("g", "n", "mean", F.try_element_at("p", F.lit(1)).alias("low"), F.try_element_at("p", F.lit(2)).alias("high"))
    if by:
        return out.withColumnRenamed("g", by)
    empty = values.sparkSession.createDataFrame([("",)], "g string").join(out, "g", "left").drop("g")
    return empty.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def bootstrap_by(values: DataFrame, by: str, value: str, groups: list[str], **options) -> DataFrame:
    """One interval per group of a known, short list (criteria), in one job; a group without values has null bounds."""
    found = bootstrap_mean(values.where(F.col(by).isin(groups)), value, by=by, **options)
    asked = values.sparkSession.createDataFrame([(g,) for g in groups], f"`{by}` string")
    return F.broadcast(asked).join(found, by, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).select(by, "n", "mean", "low", "high")


def _resampled_tables(pairs: DataFrame, y1: str, y2: str, replicates: int, seed: int) -> DataFrame:
    cell = pairs.where(F.col(y1).isNotNull() & F.col(y2).isNotNull()).select(F.struct(F.col(y1).alias("y1"), F.col(y2).alias("y2")).alias("cell"))
    return resample(cell, "cell", replicates, seed).select("b", "value.y1", "value.y2", F.col("k").cast("double").alias("n"))


def _by_index(got: DataFrame, metric: Column, replicates: int, confidence: float, least: int) -> DataFrame:
    """valid, low, high by truncated index into the sorted replicates; no bounds for few items or valid replicates."""
    told = got.withColumn("metric", metric).where("metric is not null").agg(F.array_sort(F.collect_list("metric")).alias("s"), F.max("n").alias("n"))
    m, a = F.size("s"), (1 - confidence) / 2
    enough = (F.col("n") >= least) & (m >= max(50, replicates // 10))
    at = lambda i: F.when(enough, F.element_at("s", (i + 1).cast("int")))
    return told.select(m.alias("valid"), at(F.floor(m * a)).alias("low"), at(F.least(m - 1, F.floor(m * (1 - a)))).alias("high"))


def agreement_interval(pairs: DataFrame, y1: str, y2: str, metric: str = "kappa", replicates: int = 1000, confidence: float = 0.95, seed: int = 42, least: int = 5) -> DataFrame:
    """Bounds of a two-rater metric over resampled pairs."""
    from .agreement import two_rater_metrics

    got = two_rater_metrics(_resampled_tables(pairs, y1, y2, replicates, seed), ["b"])
    return _by_index(got, F.col(metric), replicates, confidence, least)


def agreement_intervals(pairs: DataFrame, y1: str, y2: str, positive=1, binary: bool = True, replicates: int = 1000, confidence: float = 0.95, seed: int = 42, least: int = 5) -> DataFrame:
    """metric, valid, low, high for PABAK, kappa and, for binary labels, F1; each has a seed of its own, from ``seed`` upward."""
    from .agreement import binary_counts, binary_scores

    out = None
    for i, metric in enumerate(["pabak", "kappa"] + ["f1"] * binary):
        if metric == "f1":
            tables = _resampled_tables(pairs, y1, y2, replicates, seed + i)
            got = _by_index(binary_scores(binary_counts(tables, positive, ["b"])).withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), F.col("f1"), replicates, confidence, least)
        else:
            got = agreement_interval(pairs, y1, y2, metric, replicates, confidence, seed + i, least)
        got = got.select(F.lit(metric).alias("metric"), "valid", "low", "high")
        out = got if out is None else out.unionByName(got)
    return out
