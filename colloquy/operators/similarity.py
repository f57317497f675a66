"""Similarity search over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vector_index
from .metrics import dot, unit


def top_k(corpus: DataFrame, query: list[float], k: int = 10, least: float = 0.0, exclude: int | None = None, key: str = "row_idx", vector: str = "embedding") -> DataFrame:
    """The k nearest by cosine, ties by key; a zero query gives none. Each partition keeps k rows."""
    norm = sum(x * x for x in query) ** 0.5
    if norm == 0:
        return corpus.select(key, F.lit(0.0).alias("similarity")).where("false")
    q = F.lit([float(x) / norm for x in query])
    rows = corpus.select(key, dot(unit(F.col(vector)), q).alias("similarity")).where(F.col("similarity") >= least)
    rows = rows.where(F.col(key) != exclude) if exclude is not None else rows
    return rows.orderBy(F.col("similarity").desc(), key).limit(max(1, k))


def top_k_many(corpus: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, similarity, rank for a stated set of queries (query_id, embedding) against all rows, exactly."""
    return vector_index.search_exact(corpus, queries, k, least, key, vector)


def distance_diagnostics(vectors: DataFrame, order: str = "row_idx", first: int = 100, vector: str = "embedding") -> DataFrame:
    """min, max, mean, std of the cosine distance over ordered pairs of the first vectors."""
    u = vectors.orderBy(order).limit(first).select(F.col(order).alias("i"), unit(F.col(vector)).alias("u")).where("u is not null")
    d = u.join(u.select(F.col("i").alias("j"), F.col("u").alias("w")), F.col("i") != F.col("j")).select((1 - dot(F.col("u"), F.col("w"))).alias("d"))
    return d.agg(F.min("d").alias("min"), F.max("d").alias("max"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"))


def by_dialog_id(records: DataFrame, embeddings: DataFrame, dialog: str = "dialog_id", order: str = "row_idx") -> DataFrame:
    """dialog_id, embedding: records and embeddings matched by place; of a repeated id the last stays.

    Nothing is matched where there aren't as many embeddings as records.
    """
    sizes = records.agg(F.count("*").alias("a")).crossJoin(F.broadcast(embeddings.agg(F.count("*").alias("b")))).where("a = b").select("a")
    rows = records.select(order, F.col(dialog).alias("dialog_id")).join(embeddings.select(order, "embedding"), order)
    last = rows.groupBy("dialog_id").agg(F.max_by(F.struct("embedding"), order).alias("e")).select("dialog_id", "e.embedding")
    return last.join(F.broadcast(sizes)).drop("a")


def for_records(records: DataFrame, source: DataFrame, embeddings: DataFrame, dialog: str = "dialog_id", order: str = "row_idx") -> DataFrame:
    """``records`` with the embedding that the source has for their dialog; null for unknown ones."""
    known = by_dialog_id(source, embeddings, dialog, order).withColumnRenamed("dialog_id", dialog)
    return records.join(known, dialog, "left")


def search(records: DataFrame, row: int, k: int = 10, least: float = 0.0, key: str = "row_idx", vector: str = "embedding") -> DataFrame:
    """``top_k`` with a corpus row as the query, which isn't found itself; a row without a vector finds nothing."""
    found = records.where((F.col(key) == row) & F.col(vector).isNotNull()).select(vector).first()
    return top_k(records, list(found[0]) if found else [], k, least, row, key, vector)
