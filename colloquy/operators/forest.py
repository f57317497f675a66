"""Minimum spanning trees and their merge trees as rounds of joins.

Edges are (w, u, v) with u < v; their order (w, u, v) is total, so the tree is unique. In a round
every component takes its lightest edge out and joins the component at its other end, which at least
halves the number of components. What is left of at most ``IN_TASK`` rows is finished in one task;
that is a fixed bound, whatever the data.

The merge tree (single linkage) of a spanning tree comes from the same rounds on the tree alone. An
edge that joined two components stands, in the merge tree, right below the lightest edge out of the
first later component around it whose lightest edge out is heavier. The edges below one such edge on
one side form a chain in order of weight. Chains nest no deeper than there are rounds, so paths of
chains number all vertices such that every subtree is an interval, and sizes are differences.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise
from .ranks import rank_within, running_within

IN_TASK = 10_000


def _find(root: dict, i: int) -> int:
    while root.get(i, i) != i:
        root[i] = root.get(root[i], root[i])
        i = root[i]
    return i


def _follow_all(batches):
    """Task: all pointers (id, to) -> (id, root)."""
    to = {}
    for batch in batches:
        to.update((i, j) for i, j in zip(batch.column("id").to_pylist(), batch.column("to").to_pylist()) if j is not None)
        to.update((i, i) for i, j in zip(batch.column("id").to_pylist(), batch.column("to").to_pylist()) if j is None)
    ids = list(to)
    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([_find(to, i) for i in ids], pa.int64())], names=["id", "root"])


def _jump(now: DataFrame) -> DataFrame:
    """Pointers (id, root) to the roots of their roots, and whether that moved them."""
    ahead = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
    return now.join(ahead, "root").select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))


def follow(pointers: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(id, root) of pointers (id, to) without cycles; a root points to null. Beyond ``in_task`` rows by pointer doubling, twice a round."""
    if pointers.count() <= in_task:
        return materialise(pointers.coalesce(1).mapInArrow(_follow_all, "id long, root long"), "roots")
    now = materialise(pointers.select("id", F.coalesce("to", "id").alias("root")), "roots")
    while True:
        now = materialise(_jump(_jump(now.select("id", "root")).select("id", "root")), "roots")
        if now.where("moved").isEmpty():
            return now.drop("moved")


def _lightest(edges: DataFrame) -> DataFrame:
    """comp, e, to: the lightest edge out of every component of edges (e, a, b)."""
    both = edges.select(F.col("a").alias("comp"), "e", F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("comp"), "e", F.col("a").alias("to")))
    return both.groupBy("comp").agg(F.min(F.struct("e", "to")).alias("m")).select("comp", "m.e", "m.to")


def _merged(lightest: DataFrame, in_task: int) -> DataFrame:
    """(id, root): components joined over their lightest edges. Two that chose the same edge are each other's: the smaller is the root."""
    other = lightest.select(F.col("comp").alias("to"), F.col("to").alias("back"))
    return follow(lightest.join(other, "to").select(F.col("comp").alias("id"), F.when((F.col("back") != F.col("comp")) | (F.col("comp") > F.col("to")), F.col("to")).alias("to")), in_task)


def _relabelled(edges: DataFrame, roots: DataFrame) -> DataFrame:
    a, b = roots.toDF("a", "root_a"), roots.toDF("b", "root_b")
    out = edges.join(a, "a", "left").join(b, "b", "left")
    return out.select("e", F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))


def _kruskal(batches):
    """Task: edges (w, u, v, a, b) -> the forest's edges, and the root of every component that moved."""
    rows = sorted(r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("w", "u", "v", "a", "b"))))
    root, out = {}, []
    for w, u, v, a, b in rows:
        x, y = _find(root, a), _find(root, b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((w, u, v, None, None))
    out += [(None, None, None, i, _find(root, i)) for i in list(root)]
    cols = list(zip(*out)) or [()] * 5
    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.float64(), *[pa.int64()] * 4])], names=["w", "u", "v", "id", "root"])


def spanning_tree(edges: DataFrame, vertices: DataFrame, more=None, in_task: int = IN_TASK) -> DataFrame:
    """(w, u, v) of the minimum spanning tree of the connected graph (w, u, v) over ``vertices`` (id).

    Where the graph isn't connected, ``more(labels)`` is asked for edges between its components,
    given as (id, comp), until it is; without it the result is a forest.
    """
    labels = materialise(vertices.select("id", F.col("id").alias("comp")), "labels")
    found = []
    left = edges.select(F.struct("w", "u", "v").alias("e"), F.col("u").alias("a"), F.col("v").alias("b"))
    while True:
        # of edges between the same two components only the lightest can be in the tree
        pairs = left.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("e").alias("e"))
        left = materialise(pairs, "open-edges")
        n = left.count()
        if n == 0:
            if more is None or labels.select("comp").distinct().count() <= 1:
                break
            new = more(labels).select(F.struct("w", "u", "v").alias("e"), F.col("u").alias("a"), F.col("v").alias("b"))
            left = _relabelled(new, labels.toDF("id", "root"))
            continue
        if n <= in_task:
            told = materialise(left.select("e.*", "a", "b").coalesce(1).mapInArrow(_kruskal, "w double, u long, v long, id long, root long"), "kruskal")
            chosen, roots = told.where("w is not null").select("w", "u", "v"), told.where("id is not null").select("id", "root")
        else:
            lightest = materialise(_lightest(left), "lightest")
            chosen, roots = lightest.select("e").distinct().select("e.*"), _merged(lightest, in_task)
        found.append(chosen)
        labels = materialise(labels.join(roots.toDF("comp", "root"), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")), "labels")
        left = _relabelled(left, roots)
    out = found[0] if found else edges.where("false").select("w", "u", "v")
    for f in found[1:]:
        out = out.unionByName(f)
    return materialise(out, "tree")


def components(edges: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(id, comp) for the ends of edges (u, v), u < v: the smallest id that is reachable. The rounds are logarithmic in the size."""
    left = edges.select(F.struct("u", "v").alias("e"), F.col("u").alias("a"), F.col("v").alias("b"))
    labels = materialise(edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("comp", F.col("id")), "labels")
    while True:
        pairs = left.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("e").alias("e"))
        left = materialise(pairs, "open-edges")
        n = left.count()
        if n == 0:
            return labels
        if n <= in_task:
            told = left.select(F.lit(0.0).alias("w"), "e.*", "a", "b").coalesce(1).mapInArrow(_kruskal, "w double, u long, v long, id long, root long")
            roots = materialise(told.where("id is not null").select("id", "root"), "roots")
        else:
            roots = _merged(materialise(_lightest(left), "lightest"), in_task)
        labels = materialise(labels.join(roots.toDF("comp", "root"), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")), "labels")
        left = _relabelled(left, roots)


def merge_tree(tree: DataFrame, in_task: int = IN_TASK) -> tuple[DataFrame, DataFrame]:
    """Chains of the merge tree of a spanning tree (w, u, v).

    The first table has a row per edge: r (its place in the order of weight), w, level and comp
    (its chain), p (the edge right above the chain, null for the root chain). The second has a row
    per vertex: id, r (the lightest edge at it, its parent).
    """
    ranked = materialise(rank_within(tree, [], ["w", "u", "v"], "r").select(F.col("r").cast("long").alias("r"), "w", "u", "v"), "ranked-edges")
    edges = ranked.select(F.col("r").alias("e"), F.col("u").alias("a"), F.col("v").alias("b"))
    level, pending, settled, leaves = 0, None, [], None
    while True:
        lightest = materialise(_lightest(edges), "lightest")
        over = lightest.isEmpty()
        if pending is not None:
            # settled: what is lighter than the lightest edge out of the component around it
            near = lightest.select("comp", F.col("e").alias("p"))
            told = materialise(pending.join(near, "comp", "left"), "pending")
            done = F.col("p").isNull() | (F.col("p") > F.col("r"))
            settled.append(told.where(done).select("r", F.lit(level).alias("level"), "comp", "p"))
            pending = told.where(~done).select("r", "comp")
        if over:
            break
        leaves = lightest.select(F.col("comp").alias("id"), F.col("e").alias("r")) if leaves is None else leaves
        roots = _merged(lightest, in_task)
        moved = materialise(_relabelled(edges, roots), "moved")
        joined = moved.where("a = b").select(F.col("e").alias("r"), F.col("a").alias("comp"))
        if pending is not None:
            joined = joined.unionByName(pending.join(roots.toDF("comp", "root"), "comp").select("r", F.col("root").alias("comp")))
        edges, pending, level = moved.where("a <> b"), joined, level + 1
    chains = settled[0]
    for s in settled[1:]:
        chains = chains.unionByName(s)
    return materialise(chains.join(ranked.select("r", "w"), "r").select("r", "w", "level", "comp", "p"), "chains"), leaves


def resolved(nodes: DataFrame) -> DataFrame:
    """(id, val) of nodes (id, up, val): without a value of its own a node has that of ``up``; pointer doubling."""
    table = materialise(nodes, "nodes")
    while True:
        if table.where("val is null and up is not null").isEmpty():
            return table.select("id", "val")
        ahead = table.select(F.col("id").alias("up"), F.col("up").alias("up_up"), F.col("val").alias("up_val"))
        moved = table.join(ahead, "up", "left").select("id", F.when(F.col("val").isNull(), F.col("up_up")).otherwise(F.col("up")).alias("up"), F.coalesce("val", "up_val").alias("val"))
        table = materialise(moved, "nodes")


def chain_paths(chains: DataFrame) -> DataFrame:
    """(level, comp, path): from the root down the edges above a chain, each with the comp of the chain below it."""
    heads = chains.select("level", "comp", "p").distinct()
    of = chains.select(F.col("r").alias("p"), F.struct("level", "comp").alias("up"))
    table = heads.join(of, "p", "left").select(F.struct("level", "comp").alias("id"), "up", F.when(F.col("p").isNull(), F.array().cast("array<long>")).otherwise(F.array("p", "comp")).alias("path"))
    table = materialise(table, "paths")
    while not table.where("up is not null").isEmpty():
        ahead = table.select(F.col("id").alias("up"), F.col("up").alias("up_up"), F.col("path").alias("up_path"))
        table = materialise(table.join(ahead, "up", "left").select("id", F.col("up_up").alias("up"), F.concat(F.coalesce("up_path", F.array().cast("array<long>")), "path").alias("path")), "paths")
    return table.select("id.level", "id.comp", "path")


def merge_sizes(chains: DataFrame, leaves: DataFrame, weights: DataFrame) -> DataFrame:
    """``chains`` with below and hang, the weights of the two sides of an edge; at the lowest edge of a chain both hang and
    ``below`` is the larger. ``weights`` is (id, weight) of the vertices."""
    at = chains.select("r", "level", "comp").join(chain_paths(chains), ["level", "comp"]).select("r", F.concat("path", F.array("r")).alias("path"))
    vertices = weights.join(leaves, "id").join(at, "r").select("id", "r", "weight", "path")
    placed = running_within(vertices, [], ["path", "id"], "weight", "upto")
    # all vertices that hang at an edge of a chain, directly or deeper, are an interval; edges stand at even places of a path
    edges = F.filter("path", lambda x, i: i % 2 == 0)
    spans = placed.select(F.explode(edges).alias("r"), (F.col("upto") - F.col("weight")).alias("lo"), F.col("upto").alias("hi")).groupBy("r").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rows = materialise(chains.join(spans, "r"), "spans")
    starts = rows.groupBy("level", "comp").agg(F.min("lo").alias("start"), F.max("hi").alias("end"), F.min("r").alias("lowest"))
    inner = rows.where("p is not null").select("level", "comp", "p").distinct().join(starts, ["level", "comp"]).select(F.col("p").alias("r"), (F.col("end") - F.col("start")).alias("part"))
    parts = inner.unionByName(vertices.select("r", F.col("weight").alias("part"))).groupBy("r").agg(F.max("part").alias("largest"))
    rows = rows.join(starts, ["level", "comp"]).join(parts, "r")
    lowest = F.col("r") == F.col("lowest")
    below = F.when(lowest, F.col("largest")).otherwise(F.col("lo") - F.col("start"))
    hang = F.when(lowest, F.col("hi") - F.col("lo") - F.col("largest")).otherwise(F.col("hi") - F.col("lo"))
    return materialise(rows.select("r", "w", "level", "comp", "p", below.alias("below"), hang.alias("hang"), lowest.alias("lowest")), "merge-sizes")
