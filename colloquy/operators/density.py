"""Density clustering of any number of vectors, and the neighbour graph that it and the layout share.

The published hierarchical density algorithm: core distances, minimum spanning tree of mutual
reachability, condensed tree, excess-of-mass or leaf selection. Equal vectors are one vertex, so a
group of copies that a third of all rows share costs one comparison. Neighbours come from cells of
centroids (``vector_index``), the tree and its merges from rounds of joins (``forest``); nothing
groups the table.

With as many neighbours as vectors the graph is complete and the clusters are those of the exact
algorithm. Otherwise the tree is that of the graph of ``neighbours`` nearest neighbours, whose
components are joined by the shortest edges between their border rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..shared import materialise
from . import forest
from .ranks import rank_within
from .vector_index import BLOCK, centroids, first_of_rows, from_bytes, meet, meeting, placed

NEIGHBOURS, PROBE, ROWS_PER_CELL = 16, 8, 1000
#: Of each component ``BORDER`` rows look for edges to others, ``PER_CELL`` for each of the nearest cells.
BORDER, PER_CELL, NEAR_CELLS, EDGES = 64, 4, 4, 4
#: Visitors that are compared at a time: their distances stay in a core's cache.
SLICE = 64
MOST_LAMBDA = 1e12
_NEAR = "i long, near array<struct<d:double,j:bigint>>"


@dataclass
class NeighbourGraph:
    """points: id, first (smallest key), m (rows with this vector), embedding; places: id, m, cells, data; edges: i, j, d, rank."""

    points: DataFrame
    places: DataFrame
    edges: DataFrame
    centroids: np.ndarray


def _nearest(most: int):
    """The ``most`` nearest other rows of a block for each visitor (id), in one row: i, near (d, j)."""

    def work(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        visitors, ends, near = [np.empty(0, np.int64)], [np.zeros(1, np.int64)], [(np.empty(0), np.empty(0, np.int64))]
        if left.num_rows and right.num_rows:
            left = left.sort_by("id")
            rows, asked = from_bytes(left["data"]), from_bytes(right["data"])
            ids, own = left["id"].to_numpy(), right["id"].to_numpy()
            square = (rows * rows).sum(axis=1)
            at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            at = np.where(ids[at] == own, at, -1)  # where a visitor meets itself
            for a in range(0, len(own), SLICE):
                x, self_at = asked[a : a + SLICE], at[a : a + SLICE]
                cost = x @ rows.T
                cost *= -2
                cost += (x * x).sum(axis=1)[:, None] + square
                met = np.flatnonzero(self_at >= 0)
                cost[met, self_at[met]] = np.inf
                i, j = first_of_rows(cost, most)
                d = x[i] - rows[j]
                near.append((np.sqrt((d * d).sum(axis=1)), ids[j]))
                found, counts = np.unique(i, return_counts=True)
                visitors.append(own[a + found])
                ends.append(ends[-1][-1] + counts.cumsum())
        d, j = (pa.array(np.concatenate(c)) for c in zip(*near))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([e for e in ends if len(e)]).astype(np.int32)), pa.StructArray.from_arrays([d, j], names=["d", "j"]))
        return pa.table([pa.array(np.concatenate(visitors)), lists], names=["i", "near"])

    return work


def neighbour_graph(records: DataFrame, neighbours: int = NEIGHBOURS, probe: int = PROBE, rows_per_cell: int = ROWS_PER_CELL, key: str = "row_idx") -> NeighbourGraph:
    """The ``neighbours`` nearest different vectors of every vector of ``records`` (key, embedding), among its ``probe`` nearest cells."""
    rows = records.where("embedding is not null").select(F.col(key).cast("long").alias("key"), "embedding")
    points = rows.groupBy("embedding").agg(F.min("key").alias("first"), F.count("*").alias("m"))
    points = materialise(points.select((F.monotonically_increasing_id() * 2).alias("id"), "first", "m", "embedding"), "points")
    n = points.count()
    c = centroids(points, n, "first", rows_per_cell=rows_per_cell)
    places = materialise(placed(points, c, probe, "id", keep=["m"]) if n else points.select("id", "m", F.array().cast("array<int>").alias("cells"), F.lit(b"").alias("data")), "places")
    residents = places.select("id", F.get("cells", F.lit(0)).alias("cell"), "data")
    visits = places.select("id", F.explode("cells").alias("cell"), "data")
    found = meet(residents, visits, meeting(residents, visits, BLOCK), "id", "id", _nearest(neighbours), _NEAR)
    # a row per visitor and block travels, not one per neighbour
    best = found.groupBy("i").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, neighbours).alias("near"))
    edges = materialise(best.select("i", F.posexplode("near").alias("place", "e")).select("i", "e.j", "e.d", (F.col("place") + 1).alias("rank")), "neighbours")
    return NeighbourGraph(points, places, edges, c)


def core_distances(graph: NeighbourGraph, min_samples: int) -> DataFrame:
    """(id, core): the distance within which a point has ``min_samples`` rows, itself and its copies among them."""
    points = graph.points.select("id", "m")
    if min_samples <= 1:
        return points.select("id", F.lit(0.0).alias("core"))
    lists = graph.edges.join(points.select(F.col("id").alias("j"), "m"), "j").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("d", "j", "m"))).alias("near"))
    zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("d"))
    own = F.struct(F.col("m").alias("seen"), F.lit(0.0).alias("d"))
    step = lambda s, x: F.when(s["seen"] >= min_samples, s).otherwise(F.struct((s["seen"] + x["m"]).alias("seen"), x["d"].alias("d")))
    near = F.coalesce("near", F.array().cast("array<struct<d:double,j:bigint,m:bigint>>"))
    return materialise(points.join(lists.withColumnRenamed("i", "id"), "id", "left").select("id", F.aggregate(near, F.coalesce(own, zero), step)["d"].alias("core")), "cores")


def _border(c: np.ndarray, low: np.ndarray, high: np.ndarray, most: int):
    """Task: rows of components -> id, comp, the nearest cells that hold rows of another component, and how near."""

    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            s, comp = from_bytes(batch.column("data")) @ c.T, batch.column("comp").to_numpy()
            s[(low[None, :] == comp[:, None]) & (high[None, :] == comp[:, None])] = -np.inf
            i, j = first_of_rows(-s, most)
            at = pa.array(i)
            yield pa.record_batch([batch.column("id").take(at), batch.column("comp").take(at), pa.array(j.astype(np.int32)), pa.array(s[i, j]), batch.column("data").take(at)], names=["id", "comp", "cell", "s", "data"])

    return task


def _foreign(most: int = 1):
    """The nearest row of another component, by mutual reachability, for each visitor of a block."""

    def work(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if left.num_rows and right.num_rows:
            left = left.sort_by("id")
            rows, asked = from_bytes(left["data"]), from_bytes(right["data"])
            d = (asked * asked).sum(axis=1)[:, None] + (rows * rows).sum(axis=1) - 2 * (asked @ rows.T)
            reach = np.maximum(np.sqrt(np.maximum(d, 0)), np.maximum(right["core"].to_numpy()[:, None], left["core"].to_numpy()))
            reach[right["comp"].to_numpy()[:, None] == left["comp"].to_numpy()[None, :]] = np.inf
            i, j = first_of_rows(reach, most)
            out = [right["comp"].to_numpy()[i], right["id"].to_numpy()[i], left["id"].to_numpy()[j], reach[i, j]]
        return pa.table([pa.array(c) for c in out], names=["comp", "i", "j", "w"])

    return work


def _between(graph: NeighbourGraph, cores: DataFrame):
    """Edges between the components of a graph of neighbours, as ``forest.spanning_tree`` asks for them.

    Every component but the largest sends its border rows: those nearest to cells with rows of
    others. Such a cell has one, so every component gets an edge.
    """

    def more(labels: DataFrame) -> DataFrame:
        largest = labels.groupBy("comp").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "comp").first().comp
        rows = graph.places.select("id", F.get("cells", F.lit(0)).alias("cell"), "data").join(labels, "id").join(cores, "id")
        held = {r.cell: (r.lo, r.hi) for r in rows.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).collect()}  # a row per cell
        # a cell without rows is no one's goal: it counts as the component's own
        low, high = (np.array([held.get(k, (None, None))[side] if k in held else -1 for k in range(len(graph.centroids))]) for side in (0, 1))
        empty = np.array([k not in held for k in range(len(graph.centroids))])
        c = np.where(empty[:, None], np.nan, graph.centroids) if empty.any() else graph.centroids
        borders = rows.where(F.col("comp") != largest).select("id", "comp", "data").mapInArrow(_border(c, low, high, NEAR_CELLS), "id long, comp long, cell int, s double, data binary")
        by_cell, by_comp = Window.partitionBy("comp", "cell").orderBy(F.col("s").desc(), "id"), Window.partitionBy("comp").orderBy(F.col("s").desc(), "id", "cell")
        visits = borders.withColumn("k", F.row_number().over(by_cell)).where(F.col("k") <= PER_CELL).withColumn("k", F.row_number().over(by_comp)).where(F.col("k") <= BORDER)
        visits = materialise(visits.select("id", "comp", "cell", "data").join(cores, "id"), "borders")
        residents = rows.select("cell", "id", "comp", "core", "data")
        found = meet(residents, visits, meeting(residents, visits, BLOCK), "id", "id", _foreign(), "comp long, i long, j long, w double")
        best = found.withColumn("k", F.row_number().over(Window.partitionBy("comp").orderBy("w", "i", "j"))).where(F.col("k") <= EDGES)
        return materialise(best.select("w", F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")), "between")

    return more


def reachability_tree(graph: NeighbourGraph, min_samples: int, in_task: int = forest.IN_TASK) -> tuple[DataFrame, DataFrame]:
    """The spanning tree (w, u, v) of mutual reachability, and its vertices (id, weight).

    A vector of several rows is two vertices, one row and its copies, at its core distance.
    """
    cores = core_distances(graph, min_samples)
    edges, w = graph.edges, F.col("d")
    if min_samples > 1:  # else every core distance is zero
        w = F.greatest("d", "core_i", "core_j")
        edges = edges.join(cores.toDF("i", "core_i"), "i").join(cores.toDF("j", "core_j"), "j")
    # a pair that stands there both ways is one edge to the first round of the tree
    edges = edges.select(w.alias("w"), F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"))
    tree = forest.spanning_tree(edges, graph.points, _between(graph, cores), in_task)
    several = graph.points.where("m > 1")
    copies = several.join(cores, "id").select(F.col("core").alias("w"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    vertices = graph.points.select("id", F.lit(1).cast("long").alias("weight")).unionByName(several.select((F.col("id") + 1).alias("id"), (F.col("m") - 1).alias("weight")))
    return materialise(tree.unionByName(copies), "reach-tree"), vertices


def _key(*parts) -> Column:
    return F.struct(*(F.lit(p).alias(n) if isinstance(p, int) else p.alias(n) for p, n in zip(parts, ("level", "comp", "part"))))


def condensed(tree: DataFrame, vertices: DataFrame, min_cluster_size: int, in_task: int = forest.IN_TASK) -> tuple[DataFrame, DataFrame]:
    """Clusters (key, parent, birth, stability) of the condensed tree, and the cluster that each vertex falls out of (id, key).

    Along a chain of merges, from its top, a cluster goes on until an edge both of whose sides have
    ``min_cluster_size`` rows; so a cluster is a chain and the number of such edges above.
    """
    chains, leaves = forest.merge_tree(tree, in_task)
    rows = forest.merge_sizes(chains, leaves, vertices)
    size, small, mcs = F.col("below") + F.col("hang"), F.least("below", "hang"), min_cluster_size
    part = lambda c: F.when(F.col(c) < mcs, F.col(c)).otherwise(0)
    rows = rows.withColumns({"big": size >= mcs, "split": small >= mcs, "rate": F.when(F.col("w") * MOST_LAMBDA > 1, 1 / F.col("w")).otherwise(F.lit(MOST_LAMBDA))})
    rows = rows.withColumns({"leaving": F.when(F.col("split"), size).otherwise(part("below") + part("hang")), "one": F.col("split").cast("long")})
    rows = forest.running_within(rows, ["level", "comp"], ["r"], "one", "splits")
    # a row per chain: how many splits it has and its lowest edge of the least size
    heads = rows.groupBy("level", "comp").agg(F.max("splits").alias("all"), F.first("p", True).alias("p"), F.min(F.when(F.col("big"), F.col("r"))).alias("low"))
    heads = materialise(heads, "heads")
    rows = materialise(rows.join(heads.select("level", "comp", "all"), ["level", "comp"]).withColumn("above", F.col("all") - F.col("splits")).drop("all", "one", "splits"), "merges")
    over = rows.select(F.col("r").alias("p"), F.struct("level", "comp").alias("up"), F.col("above").alias("p_above"), F.col("split").alias("p_split"), F.col("big").alias("p_big"), F.col("rate").alias("p_rate"))
    told = materialise(heads.join(over, "p", "left").withColumn("id", F.struct("level", "comp")), "chains-over")
    own = F.when(F.col("p").isNull() | F.col("p_split"), _key(F.col("level"), F.col("comp"), F.lit(0).cast("long"))).when(F.col("p_above") >= 1, _key(F.col("up.level"), F.col("up.comp"), F.col("p_above")))
    of_chain = forest.resolved(told.select("id", "up", own.alias("val")))
    lowest = forest.resolved(told.select("id", "up", F.coalesce("low", F.when(F.col("p_big"), F.col("p"))).alias("val")))

    chain_of = of_chain.select("id.level", "id.comp", F.col("val").alias("first_key"))
    clustered = rows.where("big").join(chain_of, ["level", "comp"]).withColumn("key", F.when(F.col("above") >= 1, _key(F.col("level"), F.col("comp"), F.col("above"))).otherwise(F.col("first_key")))
    clustered = materialise(clustered.drop("first_key"), "clustered-merges")
    along = clustered.where("split and not lowest").select(_key(F.col("level"), F.col("comp"), F.col("above") + 1).alias("key"), F.col("rate").alias("birth"), F.col("key").alias("parent"))
    at_low = clustered.where("split").select(F.col("r").alias("p"), F.col("key").alias("parent"))
    hanging = told.where("p_split").join(at_low, "p").select(_key(F.col("level"), F.col("comp"), F.lit(0).cast("long")).alias("key"), F.col("p_rate").alias("birth"), "parent")
    root = told.where("p is null").select(_key(F.col("level"), F.col("comp"), F.lit(0).cast("long")).alias("key"), F.lit(0.0).alias("birth"), F.lit(None).cast(along.schema["parent"].dataType).alias("parent"))
    # a hanging side below the least size is no cluster
    sums = clustered.groupBy("key").agg(F.sum(F.col("leaving") * F.col("rate")).alias("mass"), F.sum("leaving").alias("rows"))
    clusters = along.unionByName(hanging).unionByName(root).join(sums, "key").select("key", "parent", "birth", (F.col("mass") - F.col("birth") * F.col("rows")).alias("stability"))

    parents = rows.select("r", "big", F.struct("level", "comp").alias("id"))
    falls = leaves.join(parents.withColumnRenamed("id", "chain"), "r").join(lowest.withColumnRenamed("id", "chain"), "chain")
    falls = falls.select("id", F.when(F.col("big"), F.col("r")).otherwise(F.col("val")).alias("r"))
    return materialise(clusters, "clusters"), falls.join(clustered.select("r", "key"), "r").select("id", "key")


def _choose_all(method: str):
    """Task: the clusters -> (id, chosen): of each the topmost selected cluster around it, or none."""

    def task(batches):
        rows = {}
        for batch in batches:
            rows.update((i, (p, s, b, k)) for i, p, s, b, k in zip(*(batch.column(c).to_pylist() for c in ("id", "parent", "stability", "below", "kids"))))
        children = {}
        for i, (p, *_) in rows.items():
            children.setdefault(p, []).append(i)
        order = [i for i in rows if rows[i][0] not in rows]
        for i in order:
            order += children.get(i, [])
        value, chosen = {}, {}
        for i in reversed(order):
            p, s, below, kids = rows[i]
            below += sum(value[c] for c in children.get(i, []))
            leaf = not kids and i not in children
            taken = p is not None and (leaf if method == "leaf" else leaf or below <= s)
            value[i], chosen[i] = (s if taken else below), taken
        yield pa.record_batch([pa.array(order, pa.string()), pa.array([chosen[i] for i in order], pa.bool_())], names=["id", "chosen"])

    return task


def select_clusters(clusters: DataFrame, method: str = "eom", in_task: int = forest.IN_TASK) -> DataFrame:
    """(key, label): the topmost selected cluster around each cluster, itself included; null where none is.

    ``eom`` selects where a cluster's stability is at least the sum over what is selected below,
    ``leaf`` the clusters without clusters below; the root is never selected. More than ``in_task``
    clusters are settled from the leaves up, a generation a round.
    """
    name = lambda c: F.to_json(c)
    left = clusters.select(name("key").alias("id"), name("parent").alias("parent"), "stability")
    nodes = materialise(left, "cluster-nodes")
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("open"))
    left = materialise(nodes.join(kids, "id", "left").fillna(0, ["open"]).withColumns({"below": F.lit(0.0), "kids": F.col("open") > 0}), "cluster-open")
    found = None
    while left.count() > in_task:
        ready = left.where("open = 0")
        taken = F.col("parent").isNotNull() & (~F.col("kids") if method == "leaf" else ~F.col("kids") | (F.col("below") <= F.col("stability")))
        ready = materialise(ready.withColumn("chosen", taken).withColumn("value", F.when(F.col("chosen"), F.col("stability")).otherwise(F.col("below"))), "cluster-ready")
        told = ready.select("id", "chosen")
        found = told if found is None else found.unionByName(told)
        sent = ready.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.sum("value").alias("more"), F.count("*").alias("gone"))
        left = left.where("open > 0").join(sent, "id", "left").fillna(0, ["more", "gone"])
        left = materialise(left.withColumns({"below": F.col("below") + F.col("more"), "open": F.col("open") - F.col("gone")}).drop("more", "gone"), "cluster-open")
    if not left.isEmpty():
        told = left.coalesce(1).mapInArrow(_choose_all(method), "id string, chosen boolean")
        found = told if found is None else found.unionByName(told)
    if found is None:
        return clusters.select("key", F.lit(None).cast("string").alias("label"))
    # the topmost one: the last that is met on the way up
    table = materialise(nodes.join(found, "id").select("id", F.col("parent").alias("up"), F.when(F.col("chosen"), F.col("id")).alias("label")), "cluster-chosen")
    while not table.where("up is not null").isEmpty():
        ahead = table.select(F.col("id").alias("up"), F.col("up").alias("up_up"), F.col("label").alias("up_label"))
        table = materialise(table.join(ahead, "up", "left").select("id", F.col("up_up").alias("up"), F.coalesce("up_label", "label").alias("label")), "cluster-chosen")
    return clusters.select("key", name("key").alias("id")).join(table.select("id", "label"), "id").select("key", "label")


def density_clusters(
    records: DataFrame, min_cluster_size: int = 5, min_samples: int = 1, method: str = "eom", auto: bool = True, key: str = "row_idx",
    neighbours: int = NEIGHBOURS, probe: int = PROBE, rows_per_cell: int = ROWS_PER_CELL, in_task: int = forest.IN_TASK,
) -> DataFrame:
    """``records`` with cluster_id: -1 noise, -2 for rows without an embedding; a single row is cluster 0.

    Clusters are numbered by their first row. Distances are those of unit vectors; a zero vector
    stays one. ``in_task`` bounds what a single task may finish, for any number of rows.
    """
    from .cluster import auto_sizes

    n = records.where("embedding is not null").count()
    size, samples = auto_sizes(n, min_cluster_size, min_samples, auto)
    rows = records.drop("cluster_id")
    if n < 2:
        return rows.withColumn("cluster_id", F.when(F.col("embedding").isNotNull(), 0).otherwise(vocab.NO_EMBEDDING))
    graph = neighbour_graph(records, max(neighbours, samples), probe, rows_per_cell, key)
    tree, vertices = reachability_tree(graph, samples, in_task)
    clusters, falls = condensed(tree, vertices, size, in_task)
    labels = select_clusters(clusters, method, in_task)
    points = graph.points.join(falls, "id").join(labels, "key").select("id", "first", "label")
    numbers = rank_within(points.where("label is not null").groupBy("label").agg(F.min("first").alias("first")), [], ["first"], "place")
    points = materialise(points.join(numbers.select("label", (F.col("place") - 1).cast("int").alias("number")), "label", "left").select("id", "number"), "point-labels")
    found = graph.points.join(points, "id").select("embedding", F.coalesce("number", F.lit(vocab.NOISE)).alias("cluster_id"))
    return rows.join(found, "embedding", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(vocab.NO_EMBEDDING))).select(*rows.columns, "cluster_id")
