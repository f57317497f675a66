"""Layout and reduction of vectors by their neighbour graph.

The graph of nearest neighbours (``density.neighbour_graph``) gets fuzzy weights: a neighbour counts
by how much farther it is than the nearest one, on a scale of each row's own. Its leading
eigenvectors, by subspace iteration over rows of edges, are the start. Then blocks of rows that are
near one another are moved in tasks of their own: neighbours attract, wherever they are, and rows of
a bounded sample of all repel. After some epochs the blocks learn the new places of the others.

Equal vectors get one place.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialise
from .cluster import layout_neighbours, layout_start
from .density import neighbour_graph

#: All pulls and pushes of an epoch are added up, so its rate is small.
BLOCK_ROWS, SAMPLE, SWEEPS, ROUNDS, EPOCHS, NEGATIVES, RATE = 2048, 2000, 16, 6, 40, 5, 0.05


def curve(min_dist: float, spread: float) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^2b), fitted by least squares to 1 up to ``min_dist`` and exp(-(d - min_dist) / spread) beyond."""
    d = np.linspace(1e-3, 3 * spread, 300)
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    x = np.array([0.0, 0.0])  # logarithms of a and b

    def off(x):
        return 1 / (1 + np.exp(x[0]) * d ** (2 * np.exp(x[1]))) - want

    damp = 1e-2
    for _ in range(200):
        r = off(x)
        jac = np.stack([(off(x + e) - r) / 1e-6 for e in np.eye(2) * 1e-6], axis=1)
        step = np.linalg.solve(jac.T @ jac + damp * np.eye(2), -jac.T @ r)
        better = (off(x + step) ** 2).sum() < (r**2).sum()
        x, damp = (x + step, damp / 3) if better else (x, damp * 4)
        if np.abs(step).max() < 1e-10:
            break
    return float(np.exp(x[0])), float(np.exp(x[1]))


def _by_key(rows: DataFrame) -> DataFrame:
    """A side with a row per vector, to be joined by shuffling: broadcasts go through the driver, and a layout has dozens of joins."""
    return rows.hint("merge")


def _fuzzy(batches):
    """Task: i, near (its neighbours by distance) -> i, j, w; the weights of a row sum to the logarithm of their number."""
    for batch in batches:
        i, j, w = [], [], []
        for own, near in zip(batch.column("i").to_pylist(), batch.column("near").to_pylist()):
            d = np.array([x["d"] for x in near])
            apart, want = np.maximum(0, d - d[0]), math.log2(max(2, len(d)))
            low, high = 0.0, np.inf
            scale = 1.0
            for _ in range(64):
                total = np.exp(-apart / scale).sum()
                if abs(total - want) < 1e-6:
                    break
                low, high = (low, scale) if total > want else (scale, high)
                scale = (low + high) / 2 if high < np.inf else scale * 2
            scale = max(scale, 1e-3 * d.mean(), 1e-12)
            i += [own] * len(d)
            j += [x["j"] for x in near]
            w += np.exp(-apart / scale).tolist()
        yield pa.record_batch([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(w, pa.float64())], names=["i", "j", "w"])


def fuzzy_graph(edges: DataFrame) -> DataFrame:
    """(i, j, w) in both directions of neighbour edges (i, j, d): the fuzzy union a + b - a b of what each end gives the other."""
    lists = edges.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("d", "j"))).alias("near"))  # as many as neighbours
    told = lists.mapInArrow(_fuzzy, "i long, j long, w double")
    pair = told.groupBy(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).agg(F.sum("w").alias("s"), F.when(F.count("*") > 1, F.max("w") * F.min("w")).otherwise(0.0).alias("both"))
    w = (F.col("s") - F.col("both")).alias("w")
    return materialise(pair.select(F.explode(F.array(F.struct(F.col("u").alias("i"), F.col("v").alias("j")), F.struct(F.col("v").alias("i"), F.col("u").alias("j")))).alias("e"), w).select("e.i", "e.j", "w"), "fuzzy")


def graph_reduced(records: DataFrame, components: int, key: str = "row_idx", **options) -> DataFrame:
    """``records`` whose embeddings are their places in a layout of ``components`` dimensions."""
    names = [f"place_{c}" for c in range(components)]
    places = graph_layout(records, dims=components, key=key, names=names, **options).withColumnRenamed(key, "placed_key")
    joined = records.join(places, F.col(key) == F.col("placed_key"), "left")
    cut = F.when(F.col("placed_key").isNotNull(), F.array(*names))
    return joined.withColumn("embedding", cut).select(*records.columns)


def _noise(seed: int, c: int):
    return F.xxhash64(F.col("id"), F.lit(seed), F.lit(c)) / F.lit(2.0**63)


def eigenvectors(graph: DataFrame, dims: int, sweeps: int = SWEEPS, seed: int = 7) -> DataFrame:
    """(id, x0, x1, ...): leading eigenvectors of the normalised graph behind the first, which only tells degrees.

    Subspace iteration: a sweep is one join of edge rows with the vectors; what the driver sees is a
    matrix of a few numbers.
    """
    q = dims + 3
    names = [f"x{c}" for c in range(q)]
    degree = materialise(graph.groupBy(F.col("i").alias("id")).agg(F.sum("w").alias("degree")), "degrees")
    scaled = graph.join(_by_key(degree.toDF("i", "di")), "i").join(_by_key(degree.toDF("j", "dj")), "j").select("i", "j", (F.col("w") / F.sqrt(F.col("di") * F.col("dj"))).alias("w"))
    scaled = materialise(scaled, "scaled-edges")
    # the first start is the first eigenvector itself
    now = materialise(degree.select("id", F.sqrt("degree").alias("x0"), *(_noise(seed, c).alias(names[c]) for c in range(1, q))), "vectors")

    def product(x: DataFrame) -> DataFrame:
        return scaled.join(_by_key(x.withColumnRenamed("id", "j")), "j").groupBy(F.col("i").alias("id")).agg(*(F.sum(F.col("w") * F.col(n)).alias(n) for n in names))

    def inner(x: DataFrame, y: list[str]) -> np.ndarray:
        row = x.agg(*(F.sum(F.col(a) * F.col(b)) for a in names for b in y)).first()
        return np.array(row, dtype=float).reshape(q, len(y))

    def turned(x: DataFrame, m: np.ndarray) -> DataFrame:
        return x.select("id", *(sum((F.col(a) * F.lit(float(v)) for a, v in zip(names, m[:, c])), F.lit(0.0)).alias(names[c]) for c in range(m.shape[1])))

    for _ in range(sweeps):
        moved = product(now).join(_by_key(now.toDF("id", *(f"old_{n}" for n in names))), "id")
        # half way to the identity, so that large negative eigenvalues don't lead
        moved = materialise(moved.select("id", *(((F.col(n) + F.col(f"old_{n}")) / 2).alias(n) for n in names)), "vectors")
        gram = inner(moved, names)
        now = turned(moved, np.linalg.inv(np.linalg.cholesky(gram + 1e-12 * np.trace(gram) * np.eye(q))).T)
    now = materialise(now, "vectors")
    images = product(now).toDF("id", *(f"a_{n}" for n in names))
    h = inner(now.join(_by_key(images), "id"), [f"a_{n}" for n in names])
    values, turn = np.linalg.eigh((h + h.T) / 2)
    return materialise(turned(now, turn[:, np.argsort(-values)[1 : dims + 1]]), "eigenvectors")


def _moved(a: float, b: float, dims: int, epochs: int, first: float, last: float, sample: np.ndarray, seed: int):
    """One block: rows (i, j, w, place of i, place of j) -> new places of the rows i."""

    def work(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rng = np.random.default_rng([seed, key[0].as_py() & 0xFFFF, key[1].as_py()])
        rows = rows.sort_by([("i", "ascending"), ("j", "ascending")])
        i, j, w = (rows[c].to_numpy() for c in ("i", "j", "w"))
        ids, at = np.unique(i, return_index=True)
        own, other = (np.stack([rows[f"{s}{c}"].to_numpy() for c in range(dims)], axis=1) for s in ("p", "q"))
        x, ends = own[at].copy(), other.copy()
        row = np.searchsorted(ids, i)
        to = np.searchsorted(ids, j)
        inside = (to < len(ids)) & (ids[np.minimum(to, len(ids) - 1)] == j)
        share = w / w.max()
        for e in range(epochs):
            rate = first + (last - first) * e / max(1, epochs)
            # an edge pulls as often as its weight says; a row that pulled is pushed by a few of the sample
            on = np.flatnonzero(rng.random(len(w)) < share)
            ends[inside] = x[to[inside]]
            d = x[row[on]] - ends[on]
            square = (d * d).sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                pull = np.where(square > 0, -2 * a * b * square ** (b - 1) / (1 + a * square**b), 0.0)
            step = np.zeros_like(x)
            np.add.at(step, row[on], np.clip(pull[:, None] * d, -4, 4))
            for _ in range(NEGATIVES):
                d = x[row[on]] - sample[rng.integers(0, len(sample), len(on))]
                square = (d * d).sum(axis=1)
                push = 2 * b / ((0.001 + square) * (1 + a * square**b))
                np.add.at(step, row[on], np.clip(push[:, None] * d, -4, 4))
            x += rate * np.clip(step, -16, 16)
        return pa.table([pa.array(ids), *(pa.array(x[:, c]) for c in range(dims))], names=["id", *(f"x{c}" for c in range(dims))])

    return work


def graph_layout(
    records: DataFrame, neighbours: int = 0, dims: int = 2, min_dist: float = 0.1, spread: float = 1.0, start: str = "auto",
    rounds: int = ROUNDS, epochs: int = EPOCHS, seed: int = 42, key: str = "row_idx", names: list[str] | None = None,
) -> DataFrame:
    """key and ``dims`` columns (x, y for two): places in which rows that are near stay near.

    ``neighbours`` 0 takes ``cluster.layout_neighbours``; ``start`` is spectral, random or, as auto,
    spectral from 50 rows on. One row stands at the origin, two stand side by side. Rows without an
    embedding aren't returned. A rerun over the same table gives the same places.
    """
    names = names or (["x", "y"] if dims == 2 else [f"x{c}" for c in range(dims)])
    spark = records.sparkSession
    rows = records.where("embedding is not null")
    n = rows.select("embedding").distinct().limit(3).count()
    if n < 3:
        few = rows.select("embedding").distinct().withColumn("at", (F.row_number().over(Window.orderBy("embedding")) - 1).cast("double"))  # two rows at most
        return rows.join(few, "embedding").select(key, F.col("at").alias(names[0]), *(F.lit(0.0).alias(c) for c in names[1:]))
    total = rows.count()
    graph = neighbour_graph(records, layout_neighbours(neighbours, total), key=key)
    fuzzy = fuzzy_graph(graph.edges)
    xs = [f"x{c}" for c in range(dims)]
    if layout_start(start, total) == "spectral":
        vectors = eigenvectors(fuzzy, dims, seed=seed)
        most = vectors.agg(*(F.max(F.abs(c)) for c in xs)).first()
        places = vectors.select("id", *((F.col(c) * (10 / max(m, 1e-300)) + 1e-4 * _noise(seed, i)).alias(c) for i, (c, m) in enumerate(zip(xs, most))))
    else:
        places = graph.points.select("id", *((10 * _noise(seed, i)).alias(c) for i, c in enumerate(xs)))
    places = materialise(places, "places")
    cells = graph.places.select("id", F.get("cells", F.lit(0)).alias("cell"))
    parts = materialise(cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts")), "layout-cells")  # a row per cell
    blocks = cells.join(F.broadcast(parts), "cell").select(F.col("id").alias("i"), "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    edges = materialise(fuzzy.join(_by_key(blocks), "i"), "layout-edges")
    a, b = curve(min_dist, spread)
    count = graph.points.count()
    for r in range(rounds):
        share = min(1.0, 1.5 * SAMPLE / count)
        chosen = places.where(F.pmod(F.xxhash64("id", F.lit(seed + r)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) if share < 1 else places
        sample = chosen.select(*xs).limit(SAMPLE).toArrow()
        sample = np.stack([sample[c].to_numpy() for c in xs], axis=1)
        ends = edges.join(_by_key(places.toDF("i", *(f"p{c}" for c in range(dims)))), "i").join(_by_key(places.toDF("j", *(f"q{c}" for c in range(dims)))), "j")
        move = _moved(a, b, dims, epochs, RATE * (1 - r / rounds), RATE * (1 - (r + 1) / rounds), sample, seed + r)
        places = materialise(ends.groupBy("cell", "part").applyInArrow(move, ", ".join(["id long", *(f"{c} double" for c in xs)])), "places")
    found = graph.points.join(_by_key(places), "id").select("embedding", *(F.col(c).alias(f"at_{c}") for c in xs))
    return rows.join(_by_key(found), "embedding").select(key, *(F.col(f"at_{c}").alias(n) for c, n in zip(xs, names)))
