"""Sizes and settings of clusterings, principal components, centroids and merges of topics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab


def auto_sizes(n: int, min_cluster_size: int = 5, min_samples: int = 1, auto: bool = True) -> tuple[int, int]:
    size = min(min_cluster_size, max(3, n // 10)) if auto else min_cluster_size
    size = max(2, min(size, max(2, n)))
    return size, max(1, min(min_samples, max(1, n - 1)))


def layout_neighbours(requested: int, n: int) -> int:
    """Neighbours of a layout: the requested number, else a fifth of the rows up to 10, within what there is."""
    return max(2, min(requested, n - 1)) if requested > 0 else max(2, min(10, max(2, n // 5), n - 1))


def layout_components(requested: int, size: int, n: int) -> int:
    """Dimensions after reduction: the requested number, else 50, within what vectors and rows allow."""
    return max(2, min(requested, size, n - 1)) if requested > 0 else min(50, size, max(2, n - 1))


def layout_start(start: str, n: int) -> str:
    return start if start in ("spectral", "random") else "random" if n < 50 else "spectral"


def reduced(records: DataFrame, requested: int = 0, key: str = "row_idx") -> DataFrame:
    """``records`` whose embeddings are cut to their principal components, as many as ``layout_components`` says."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = records.where("embedding is not null").select(key, array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    told = records.where("embedding is not null").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("size")).first()
    if told.n < 3:
        return records
    model = PCA(k=layout_components(requested, told.size, told.n), inputCol="v", outputCol="p").fit(rows)
    cut = model.transform(rows).select(F.col(key).alias("cut_key"), vector_to_array("p").alias("cut"))
    joined = records.join(cut, F.col(key) == F.col("cut_key"), "left")
    return joined.withColumn("embedding", F.col("cut")).select(*records.columns)


def layout_2d(records: DataFrame, key: str = "row_idx") -> DataFrame:
    """key, x, y: the two principal components; the covariance comes from one distributed pass."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = records.where("embedding is not null").select(key, array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    few = rows.select(key).orderBy(key).limit(3).collect()
    if len(few) < 3:  # one row stands at the origin, a second one beside it
        return records.sparkSession.createDataFrame([(r[0], float(i), 0.0) for i, r in enumerate(few)], f"{key} {records.schema[key].dataType.simpleString()}, x double, y double")
    model = PCA(k=2, inputCol="v", outputCol="p").fit(rows)
    p = vector_to_array("p")
    return model.transform(rows).select(key, p[0].alias("x"), p[1].alias("y"))


def centroids(records: DataFrame) -> DataFrame:
    """cluster_id, centroid over clusters >= 0."""
    dims = records.where("cluster_id >= 0").select("cluster_id", F.posexplode("embedding").alias("d", "x")).groupBy("cluster_id", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return dims.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("c")).select("cluster_id", F.col("c.m").alias("centroid"))


def reassign_noise(records: DataFrame, key: str = "row_idx") -> DataFrame:
    """key, cluster_id of noise rows by the nearest centroid; there is a row per cluster to compare with."""
    from .metrics import dot, unit

    c = centroids(records).select("cluster_id", unit(F.col("centroid")).alias("c"))
    noise = records.where(F.col("cluster_id") == vocab.NOISE).select(key, unit(F.col("embedding")).alias("u"))
    near = noise.join(F.broadcast(c)).select(key, "cluster_id", dot(F.col("u"), F.col("c")).alias("s"))
    return near.groupBy(key).agg(F.max_by("cluster_id", F.struct("s", -F.col("cluster_id"))).alias("cluster_id"))


def merge_topics(vectors: np.ndarray, sizes: np.ndarray, target: int) -> np.ndarray:
    """Agglomerate topics by cosine until ``target`` remain: new topic of each; the larger one's number stays."""
    owner, v, s = np.arange(len(vectors)), vectors.astype(float).copy(), sizes.astype(float).copy()
    alive = list(range(len(v)))
    while len(alive) > max(1, target):
        u = v[alive] / np.maximum(1e-12, np.linalg.norm(v[alive], axis=1, keepdims=True))
        sims = u @ u.T
        np.fill_diagonal(sims, -np.inf)
        i, j = np.unravel_index(sims.argmax(), sims.shape)
        a, b = sorted((alive[i], alive[j]), key=lambda k: (-s[k], k))
        v[a], s[a] = (v[a] * s[a] + v[b] * s[b]) / (s[a] + s[b]), s[a] + s[b]
        owner[owner == b] = a
        alive.remove(b)
    return owner
