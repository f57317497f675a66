"""Neighbour search over vectors: an inverted file of coarse cells, searched block by block.

Rows belong to the cell of their nearest centroid. An index is a folder with two Parquet tables,
written once: ``cells`` (cell, centroid, number of rows, how many cells to visit) and ``rows``, in ranges of cells (cell,
key, int8 code of the residual to the centroid, scale, embedding). A batch of queries visits its
nearest cells: rows and visitors of a cell meet in blocks of at most ``BLOCK`` each, so a cell that
a third of all rows shares is as many tasks as it has blocks, and only codes are moved; the best by
code are compared by their full vectors.

Centroids are fitted on a bounded sample (``SAMPLE`` rows); every row is indexed. How many cells a
query has to visit depends on how far neighbours scatter, so it is measured when the index is written:
the exact neighbours of at most ``TRIALS`` rows among all, and as many cells as hold ``WANTED`` of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import materialise
from .metrics import dot, unit

SAMPLE, MOST_CELLS, ROWS_PER_CELL, BLOCK, PROBE = 20_000, 4096, 1000, 4096, 8
TRIALS, TRIAL_K, WANTED = 512, 10, 0.95


def as_matrix(column: pa.Array) -> np.ndarray:
    """A list column of vectors of one length as float64 rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def from_bytes(column: pa.Array) -> np.ndarray:
    """A binary column of float64 vectors of one length as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows over their norms; zero rows stay."""
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def centroids(vectors: DataFrame, rows: int, key: str, vector: str = "embedding", rows_per_cell: int = ROWS_PER_CELL, sample: int = SAMPLE, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of about ``rows / rows_per_cell`` cells (at most ``MOST_CELLS``), by k-means on at most ``sample`` rows.

    ``rows`` is the number of rows of ``vectors``, which have no null vector. The sample is a slice of
    a hash of the key, so a rerun gives the same cells.
    """
    cells = max(1, min(MOST_CELLS, math.ceil(rows / rows_per_cell)))
    share = min(1.0, 1.5 * sample / max(1, rows))
    chosen = vectors.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) if share < 1 else vectors
    found = chosen.select(vector).limit(sample if cells > 1 else 1).toArrow()
    if not found.num_rows:
        return np.zeros((1, 0))
    x = unit_rows(as_matrix(found.column(0)))
    if cells == 1:
        return np.zeros((1, x.shape[1]))
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(np.bincount(own, minlength=len(c))[:, None] > 0, unit_rows(sums), c)
    return c


def _nearest_cells(x: np.ndarray, c: np.ndarray, nearest: int) -> np.ndarray:
    """The ``nearest`` cells of each row, the nearest one first."""
    s = x @ c.T
    if nearest == 1:
        return s.argmax(axis=1)[:, None]
    found = np.argpartition(-s, nearest - 1, axis=1)[:, :nearest] if nearest < len(c) else np.broadcast_to(np.arange(len(c)), s.shape)
    return np.take_along_axis(found, np.argsort(-np.take_along_axis(s, found, axis=1), axis=1, kind="stable"), axis=1)


def placed(vectors: DataFrame, c: np.ndarray, nearest: int, key: str, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """key, the ``keep`` columns, cells array<int> (the ``nearest`` ones), data (the unit vector as float64 bytes)."""
    keep = keep or []
    rows = vectors.select(key, *keep, vector)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(key, *keep).schema)

    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit_rows(as_matrix(batch.column(batch.num_columns - 1)))
            near = _nearest_cells(x, c, min(nearest, len(c)))
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel().astype(np.int32)))
            data = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.record_batch([*batch.columns[:-1], cells, data], names=[*batch.schema.names[:-1], "cells", "data"])

    return rows.mapInArrow(task, f"{fields}, cells array<int>, data binary")


def meeting(residents: DataFrame, visitors: DataFrame, block: int = BLOCK) -> DataFrame:
    """cell, blocks, chunks: into how many parts the rows and the visitors of each cell are cut; a row per cell."""
    rows = residents.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    visits = visitors.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
    return materialise(rows.join(visits, "cell"), "meeting")


def meet(residents: DataFrame, visitors: DataFrame, cells: DataFrame, resident_key: str, visitor_key: str, work, schema: str) -> DataFrame:
    """``work(key, residents, visitors)`` for every block of rows and chunk of visitors of a cell.

    ``cells`` is ``meeting`` of both: at most ``MOST_CELLS`` rows, so it's broadcast. Cells without
    visitors aren't moved.
    """
    bound = F.broadcast(cells)
    part = lambda k, n: F.pmod(F.xxhash64(k), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = residents.join(bound, "cell").withColumn("block", part(resident_key, "blocks")).withColumn("chunk", every("chunks")).drop("blocks", "chunks")
    right = visitors.join(bound, "cell").withColumn("chunk", part(visitor_key, "chunks")).withColumn("block", every("blocks")).drop("blocks", "chunks")
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # both may come from one table
    group = ["cell", "block", "chunk"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(work, schema)


def first_of_rows(cost: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``most`` smallest finite costs of each row, by column among equals."""
    most = min(most, cost.shape[1])
    # the smallest of ``most`` groups bound ``most`` of the costs, and there are far fewer groups than costs
    width = max(1, cost.shape[1] // (4 * most))
    low = np.fmin.reduceat(cost, np.arange(0, cost.shape[1], width), axis=1)
    bound = np.nan_to_num(np.partition(low, most - 1, axis=1)[:, most - 1 : most], nan=np.inf, posinf=np.inf, neginf=-np.inf)
    i, j = np.divmod(np.flatnonzero(cost <= bound), cost.shape[1])
    at = cost[i, j]
    on = np.isfinite(at)
    i, j = i[on], j[on]
    order = np.lexsort((j, at[on], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, np.arange(len(cost)))[i]
    return i[place < most], j[place < most]


def _by_similarity(most: int, c: np.ndarray | None):
    """The ``most`` most similar rows of a block for each visitor; ``c`` are the centroids that codes refer to, or None for full vectors."""

    def work(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            left = left.sort_by("key")
            if c is None:
                rows = from_bytes(left["data"])
            else:
                code = np.frombuffer(b"".join(left["data"].to_pylist()), np.int8).reshape(left.num_rows, -1)
                rows = c[key[0].as_py()] + code * left["scale"].to_numpy()[:, None]
            asked, own, ids = from_bytes(right["data"]), right["query_id"], left["key"]
            bound = right["bound"].fill_null(-np.inf).to_numpy() if "bound" in right.column_names else None
            for a in range(0, right.num_rows, 512):
                part = own.slice(a, 512)
                s = np.round(asked[a : a + 512] @ rows.T, 9)
                s[np.asarray(part.to_numpy())[:, None] == np.asarray(ids.to_numpy())[None, :]] = -np.inf  # a row doesn't find itself
                if bound is not None:  # what can't be among the best isn't sent on
                    s[s < bound[a : a + 512, None]] = -np.inf
                i, j = first_of_rows(-s, most)
                out[0] += part.take(pa.array(i)).to_pylist()
                out[1] += ids.take(pa.array(j)).to_pylist()
                out[2] += s[i, j].tolist()
        return pa.table([pa.array(out[0], right["query_id"].type), pa.array(out[1], left["key"].type), pa.array(out[2], pa.float64())], names=["query_id", "key", "s"])

    return work


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _best(rows: DataFrame, score: Column, key: str, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(score.desc(), key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def _ranked(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, least: float, key: str, vector: str) -> DataFrame:
    """query_id, key, similarity, rank by the cosine of the full vectors."""
    q = queries.select("query_id", unit(F.col("embedding")).alias("q"))
    c = vectors.select(F.col(key).alias("key"), unit(F.col(vector)).alias("u"))
    sims = candidates.select("query_id", "key").join(c, "key").join(q, "query_id").select("query_id", F.col("key").alias(key), dot(F.col("u"), F.col("q")).alias("similarity"))
    return _best(sims.where(F.col("similarity") >= least), F.col("similarity"), key, k)


def _usable(rows: DataFrame, vector: str) -> DataFrame:
    return rows.where(unit(F.col(vector)).isNotNull())


def write_index(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", rows_per_cell: int = ROWS_PER_CELL, sample: int = SAMPLE, seed: int = 7) -> None:
    """Index every row of ``vectors`` with a vector other than null and zero below ``path``."""
    spark = vectors.sparkSession
    rows = _usable(vectors.select(F.col(key).alias("key"), F.col(vector).alias("embedding")), "embedding")
    c = centroids(rows, rows.count(), "key", rows_per_cell=rows_per_cell, sample=sample, seed=seed)

    def coded(batches):
        for batch in batches:
            x = from_bytes(batch.column("data"))
            cell = batch.column("cells").flatten().to_numpy()
            rest = x - c[cell] if len(x) else x
            scale = np.abs(rest).max(axis=1, initial=1e-12) / 127
            code = np.round(rest / scale[:, None]).astype(np.int8)
            yield pa.record_batch([batch.column("key"), pa.array(cell), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(scale), batch.column("embedding")], names=["key", "cell", "data", "scale", "embedding"])

    near = placed(rows.withColumn("full", F.col("embedding")), c, 1, "key", "full", ["embedding"])
    codes = near.mapInArrow(coded, f"key {_type(rows, 'key')}, cell int, data binary, scale double, embedding {_type(rows, 'embedding')}")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    codes.repartitionByRange(parts, "cell", F.xxhash64("key")).sortWithinPartitions("cell").write.parquet(f"{path}/rows")
    counts = {r.cell: r.n for r in spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row per cell
    probe = _cells_to_visit(spark.read.parquet(f"{path}/rows"), c, sum(counts.values()))
    table = [(i, v.tolist(), counts.get(i, 0), probe) for i, v in enumerate(c)]
    spark.createDataFrame(table, "cell int, centroid array<double>, n long, probe int").coalesce(1).write.parquet(f"{path}/cells")


def _cells_to_visit(rows: DataFrame, c: np.ndarray, count: int) -> int:
    """How many of its nearest cells a query visits to meet ``WANTED`` of its ``TRIAL_K`` neighbours, at least ``PROBE``."""
    if len(c) <= PROBE:
        return len(c)
    share = min(1.0, 1.5 * TRIALS / count)
    chosen = rows.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) if share < 1 else rows
    x = unit_rows(as_matrix(chosen.select("embedding").limit(TRIALS).toArrow().column(0)))

    def task(batches):
        s, cell = np.full((len(x), 1), -np.inf), np.zeros((len(x), 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.hstack([s, x @ unit_rows(as_matrix(batch.column(1))).T])
            cell = np.hstack([cell, np.broadcast_to(batch.column(0).to_numpy(), (len(x), batch.num_rows))])
            best = np.argpartition(-s, min(TRIAL_K, s.shape[1] - 1), axis=1)[:, : TRIAL_K + 1]  # the row itself is one of them
            s, cell = np.take_along_axis(s, best, 1), np.take_along_axis(cell, best, 1)
        own = np.repeat(np.arange(len(x)), s.shape[1])
        yield pa.record_batch([pa.array(own), pa.array(cell.ravel().astype(np.int32)), pa.array(s.ravel())], names=["trial", "cell", "s"])

    found = rows.select("cell", "embedding").mapInArrow(task, "trial long, cell int, s double").where(F.col("s") > F.lit(float("-inf")))
    order = Window.partitionBy("trial").orderBy(F.desc("s"), "cell")
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r").between(2, TRIAL_K + 1)).toArrow()  # TRIALS times TRIAL_K rows
    if not best.num_rows:
        return PROBE
    near = _nearest_cells(x, c, len(c)).argsort(axis=1)  # the place of each cell in the order of visits
    places = np.sort(near[best["trial"].to_numpy(), best["cell"].to_numpy()])
    return max(PROBE, int(places[math.ceil(WANTED * len(places)) - 1]) + 1)


def _candidates(residents: DataFrame, visits: DataFrame, cells: DataFrame, most: int, c: np.ndarray | None) -> DataFrame:
    """query_id, key, s: the ``most`` best of all blocks that a query visits; ``cells`` has the cell of every row."""
    schema = f"query_id {_type(visits, 'query_id')}, key {_type(residents, 'key')}, s double"
    found = meet(residents, visits, meeting(cells, visits), "key", "query_id", _by_similarity(most, c), schema)
    return materialise(_best(found, F.col("s"), "key", most).drop("rank"), "candidates")


def _visited(residents: DataFrame, asked: DataFrame, c: np.ndarray, k: int, probe: int, upto: int, codes: bool = False) -> DataFrame:
    """Candidates of the ``upto`` nearest cells: the ``probe`` nearest first, then the others for what beats the best of those.

    ``residents`` (cell, key, data; with ``codes`` also scale) is a written table.
    """
    visits = materialise(placed(asked, c, upto, "query_id"), "visits")
    cells, base = residents.select("cell"), c if codes else None
    near = _candidates(residents, visits.select("query_id", F.explode(F.slice("cells", 1, probe)).alias("cell"), "data"), cells, k, base)
    if min(len(c), upto) <= probe:
        return near
    bound = near.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("s")).alias("bound"))
    far = visits.join(bound, "query_id", "left").select("query_id", F.explode(F.slice("cells", probe + 1, upto)).alias("cell"), "data", "bound")
    return materialise(_best(near.unionByName(_candidates(residents, far, cells, k, base)), F.col("s"), "key", k), "candidates")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probe: int | None = 0, refine: int = 4, least: float = 0.0, key: str = "vec_id") -> DataFrame:
    """query_id, key, similarity, rank: the ``k`` most similar rows for each row of ``queries`` (query_id, embedding).

    ``probe`` cells are visited, with 0 as many as the index measured, and ``refine`` times ``k`` rows
    compared by their full vectors; with None every cell is visited by full vectors, so the result is exact. A row doesn't find the query
    of its own id. Equal similarities go by key; queries with null or zero vectors find nothing.
    """
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # at most MOST_CELLS
    c = np.array([r.centroid for r in cells])
    rows = spark.read.parquet(f"{path}/rows")
    if not c.size:
        return spark.createDataFrame([], f"query_id {_type(queries, 'query_id')}, {key} {_type(rows, 'key')}, similarity double, rank int")
    asked = _usable(queries.select("query_id", "embedding"), "embedding")
    if probe is not None:
        upto = probe or cells[0].probe
        best = _visited(rows.select("cell", "key", "data", "scale"), asked, c, k * refine, min(upto, PROBE), upto, codes=True)
    else:
        full = placed(rows.select("key", "cell", "embedding"), np.zeros((1, c.shape[1])), 1, "key", keep=["cell"]).drop("cells")
        best = _visited(materialise(full, "full-vectors"), asked, c, k, PROBE, len(c))
    return _ranked(best, rows.withColumnRenamed("key", key), asked, k, least, key, "embedding")


def search_exact(vectors: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.0, key: str = "vec_id", vector: str = "embedding", rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """``search_index`` in its exact mode without an index: every query against every row, in blocks of matrix products."""
    spark = vectors.sparkSession
    rows = _usable(vectors.select(F.col(key).alias("key"), F.col(vector).alias("embedding")), "embedding")
    asked = _usable(queries.select("query_id", "embedding"), "embedding")
    c = centroids(rows, rows.count(), "key", rows_per_cell=rows_per_cell)
    if not c.size:
        return spark.createDataFrame([], f"query_id {_type(queries, 'query_id')}, {key} {_type(rows, 'key')}, similarity double, rank int")
    residents = materialise(placed(rows, c, 1, "key").select("key", F.get("cells", F.lit(0)).alias("cell"), "data"), "full-vectors")
    best = _visited(residents, asked, c, k, PROBE, len(c))
    return _ranked(best, rows.withColumnRenamed("key", key), asked, k, least, key, "embedding")
