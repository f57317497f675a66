"""De-duplication of dialog records."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..shared import materialise
from . import forest
from .metrics import dot, unit
from .ranks import running_within
from .vector_index import as_matrix
from .vector_index import unit_rows as scaled

#: Links that one task settles.
GROUP_LINKS = 200_000
#: Hash tables that more bits may call for.
MOST_TABLES = 128
#: Vectors that are hashed at a time.
SLICE = 512
#: Rows of a block at most; blocks that a smaller table is cut into, for the cores, and rows that such a block has at least.
BLOCK, BLOCKS, LEAST = 65_536, 8, 512
#: Rows, and earlier rows, that one matrix product compares.
TILE = 2048, 1024


def exact(records: DataFrame, text: str, order: str = "row_idx") -> DataFrame:
    """Adds kept_idx and dup: the first row of each text stays; blank texts are never duplicates.

    The first row is an aggregate with map-side combination, joined back, so that a text that a
    third of all rows share needs no task of its own.
    """
    own = strip(F.coalesce(F.col(text), F.lit("")))
    key = F.when(own != "", F.unhex(F.sha2(own, 256)))  # a digest travels, not the text
    first = records.where(own != "").groupBy(key.alias("dedup_key")).agg(F.min(order).alias("kept_idx"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    out = records.withColumn("dedup_key", key).join(first, "dedup_key", "left").drop("dedup_key")
    return out.withColumn("kept_idx", F.coalesce("kept_idx", order)).withColumn("dup", F.col("kept_idx") != F.col(order))


def semantic_pairs(vectors: DataFrame, threshold: float, key: str = "row_idx", vector: str = "embedding", tables: int = 24, bits: int = 8, seed: int = 7) -> DataFrame:
    """Candidate pairs (i < j) with cosine >= threshold by signed random projections, checked exactly.

    ``tables`` times ``bits`` planes: more bits for more rows, so that buckets of unlike rows stay
    small, and more tables for more bits and lower thresholds, so that at the threshold a pair shares
    no table with probability below 1e-5. Where that takes more tables than a table has buckets,
    comparing all pairs is less work, and ``exact_pairs`` does it.
    """
    unit_rows = materialise(vectors.select(F.col(key).alias("i"), unit(F.col(vector)).alias("u")).where("u is not null"), "unit-vectors")
    told = unit_rows.agg(F.count("*").alias("rows"), F.max(F.size("u")).alias("n")).first()
    if not told.rows:
        return vectors.sparkSession.createDataFrame([], "i long, j long, sim double")
    bits = max(bits, min(24, math.ceil(math.log2(told.rows / 64 + 1))))

    def tables_for(b: int) -> float:
        agree = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** b
        return math.inf if agree < 1e-9 else 1 if agree == 1 else math.ceil(math.log(1e-5) / math.log1p(-agree))

    # rows of one topic share buckets of few bits by the thousand: as many bits as MOST_TABLES tables make up for
    bits = max([bits] + [b for b in range(bits, min(24, math.ceil(math.log2(told.rows + 1)) + 8) + 1) if tables_for(b) <= MOST_TABLES])
    needed = tables_for(bits)
    if needed > 1 << bits:
        return exact_pairs(vectors, threshold, key, vector)
    tables = max(tables, needed)
    planes = np.random.default_rng(seed).standard_normal((tables * bits, told.n))

    powers, starts = (1 << np.arange(bits)).astype(np.float32), np.arange(tables, dtype=np.int64) << bits  # sums stay below 2^24

    def keys(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                signs = as_matrix(part.column(1)) @ planes.T > 0
                codes = (signs.reshape(-1, bits).astype(np.float32) @ powers).astype(np.int64).reshape(-1, tables) + starts
                own = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), tables)))
                yield pa.record_batch([own, pa.array(codes.ravel())], names=["i", "k"])

    hashed = unit_rows.mapInArrow(keys, f"i {unit_rows.schema['i'].dataType.simpleString()}, k long")
    # most rows are alone in most of their buckets; only the others meet
    met = hashed.withColumn("n", F.count("*").over(Window.partitionBy("k"))).where("n > 1").select("k", "i")
    met = materialise(met, "met")
    pairs = met.join(met.select("k", F.col("i").alias("j")), "k").where("i < j").select("i", "j").distinct()
    both = pairs.join(unit_rows, "i").join(unit_rows.select(F.col("i").alias("j"), F.col("u").alias("w")), "j")

    def alike(batches):
        for batch in batches:
            if batch.num_rows:
                sim = np.einsum("ij,ij->i", as_matrix(batch.column(2)), as_matrix(batch.column(3)))
                on = pa.array(sim >= threshold)
                yield pa.record_batch([batch.column(0).filter(on), batch.column(1).filter(on), pa.array(sim).filter(on)], names=["i", "j", "sim"])

    kind = unit_rows.schema["i"].dataType.simpleString()
    return both.select("i", "j", "u", "w").mapInArrow(alike, f"i {kind}, j {kind}, sim double")


def exact_pairs(vectors: DataFrame, threshold: float, key: str = "row_idx", vector: str = "embedding") -> DataFrame:
    """All pairs (i < j) with cosine >= threshold, for samples that a dialog clustering takes."""
    u = vectors.select(F.col(key).alias("i"), unit(F.col(vector)).alias("u")).where("u is not null")
    w = u.select(F.col("i").alias("j"), F.col("u").alias("w"))
    return u.join(w, F.col("i") < F.col("j")).select("i", "j", dot(F.col("u"), F.col("w")).alias("sim")).where(F.col("sim") >= threshold)


def _in_order(key: tuple[pa.Scalar, ...], links: pa.Table) -> pa.Table:
    """The rows of some links that go, each with the first kept row that it is linked to."""
    links = links.sort_by([("j", "ascending"), ("i", "ascending")])
    gone: dict[int, tuple[int, float]] = {}
    for i, j, sim in zip(*(links[c].to_pylist() for c in ("i", "j", "sim"))):
        if j not in gone and i not in gone:
            gone[j] = (i, sim)
    columns = [pa.array(list(gone), pa.int64()), pa.array([k for k, _ in gone.values()], pa.int64()), pa.array([s for _, s in gone.values()], pa.float64())]
    return pa.table(columns, names=["j", "kept_idx", "sim"])


def greedy_keep(nodes: DataFrame, pairs: DataFrame, key: str = "row_idx", most: int = GROUP_LINKS) -> DataFrame:
    """Drop j if it is linked to a kept i < j, in row order; returns key, kept_idx, similarity of what goes.

    Components of links don't affect one another: each of at most ``most`` links is settled by a task
    of its own. A larger one settles its first ``most`` links in row order, which decide all rows
    before the next link; what they drop, and what their kept rows drop further on, leaves the
    component, whose rest falls apart into components again. Rows without an earlier open partner
    are kept, and drop theirs, in every round, so a row of more links than ``most`` doesn't stop it.
    """
    spark = nodes.sparkSession
    schema = "j long, kept_idx long, sim double"
    gone, open_ = spark.createDataFrame([], schema), None
    links = materialise(pairs.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "sim"), "open-pairs")
    while not links.isEmpty():
        comps = forest.components(links.select(F.col("i").alias("u"), F.col("j").alias("v")))
        links = materialise(links.join(comps.withColumnRenamed("id", "i"), "i"), "open-pairs")
        sizes = materialise(links.groupBy("comp").agg((F.count("*") > most).alias("large")), "components")
        told = links.join(sizes, "comp")
        gone = gone.unionByName(materialise(told.where("not large").groupBy("comp").applyInArrow(_in_order, schema), "gone"))
        large = told.where("large")
        if sizes.where("large").isEmpty():
            break
        firm = large.join(large.select(F.col("j").alias("i")).distinct(), "i", "left_anti")
        ordered = running_within(large.select("comp", "i", "j", "sim").withColumn("one", F.lit(1).cast("long")), ["comp"], ["j", "i"], "one", "upto")
        cut = ordered.where(F.col("upto") > most).groupBy("comp").agg(F.min("j").alias("cut"))
        ordered = materialise(ordered.join(cut, "comp").drop("one", "upto"), "ordered-pairs")
        inner = materialise(ordered.where("j < cut").groupBy("comp").applyInArrow(_in_order, schema), "gone")
        # rows before the cut are decided: those that stay drop what they are linked to behind it
        kept = ordered.where("i < cut and j >= cut").join(inner.select(F.col("j").alias("i")), "i", "left_anti")
        behind = kept.unionByName(firm.join(cut, "comp").where("j >= cut").select(*kept.columns))
        lost = materialise(behind.select("j").distinct(), "lost")
        gone, open_ = gone.unionByName(inner), lost if open_ is None else open_.unionByName(lost)
        rest = ordered.where("i >= cut").join(lost.select("j"), "j", "left_anti").join(lost.select(F.col("j").alias("i")), "i", "left_anti")
        links = materialise(rest.select("i", "j", "sim"), "open-pairs")
    if open_ is not None:  # whose first kept partner may have been decided later than they were
        out = gone.select(F.col("j").alias("i")).unionByName(open_.select(F.col("j").alias("i")))
        first = pairs.join(open_, "j").join(out, "i", "left_anti").groupBy("j").agg(F.min(F.struct("i", "sim")).alias("k"))
        gone = gone.unionByName(first.select("j", F.col("k.i").alias("kept_idx"), F.col("k.sim").alias("sim")))
    return gone.select(F.col("j").alias(key), "kept_idx", F.col("sim").alias("similarity"))


def _first_earlier(threshold: float, tile: tuple[int, int]):
    """Task: rows (a, b, block, i, v) of two blocks -> (j, i, sim), each row of block b with the first earlier row alike in block a.

    Earlier rows come tile by tile, and a row that has found its own leaves, so a group of near
    copies costs what its rows cost. Products are of 4-byte floats, with room for their error; what
    they find is confirmed by 8-byte ones.
    """

    def work(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        a, b = (k.as_py() for k in key)
        rows = rows.sort_by("i")
        block, ids, u = rows.column("block").to_numpy(), rows.column("i").to_numpy(), scaled(as_matrix(rows.column("v")))
        parts = [(block == at) & u.any(axis=1) for at in (a, b)]  # zero vectors are like none
        (before, x), (after, y) = ((ids[part], u[part]) for part in parts)
        x4, y4 = x.astype(np.float32), y.astype(np.float32)
        low = np.float32(threshold - (u.shape[1] + 4) * 2.0**-22)
        found = []
        for q in range(0, len(y), tile[0]):
            left = np.arange(q, min(q + tile[0], len(y)))
            for c in range(0, q + tile[0] if a == b else len(x), tile[1]):
                hit = y4[left] @ x4[c : c + tile[1]].T >= low
                if a == b:  # both in order: only what stands before
                    hit &= np.arange(c, c + hit.shape[1]) < left[:, None]
                done = np.zeros(len(left), bool)
                maybe = np.flatnonzero(hit.any(axis=1))
                while len(maybe):
                    at = hit[maybe].argmax(axis=1)
                    sim = np.einsum("ij,ij->i", y[left[maybe]], x[c + at])
                    on = sim >= threshold
                    found.append((after[left[maybe[on]]], before[c + at[on]], sim[on]))
                    done[maybe[on]] = True
                    hit[maybe[~on], at[~on]] = False
                    maybe = maybe[~on][hit[maybe[~on]].any(axis=1)]
                left = left[~done]
                if not len(left):
                    break
        columns = [np.concatenate([f[n] for f in found]) if found else [] for n in range(3)]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["j", "i", "sim"])

    return work


def first_earlier(vectors: DataFrame, threshold: float, key: str = "row_idx", vector: str = "embedding", block: int = BLOCK, tile: tuple[int, int] = TILE) -> DataFrame:
    """j, i, sim: every row with a cosine of at least ``threshold`` to earlier rows, and the first of those. Keys are distinct.

    Exact: every two blocks of rows, cut in row order, meet in a task of their own, which returns a
    row of the later block at most once. So work is quadratic in the rows, and what is sent is rows
    times blocks; no pairs are made, however many rows are alike.
    """
    rows = vectors.select(F.col(key).cast("long").alias("i"), F.col(vector).alias("v")).where("v is not null")
    n = rows.count()
    blocks = max(math.ceil(n / block), min(BLOCKS, math.ceil(n / LEAST)), 1)
    cuts = rows.agg(F.percentile_approx("i", [b / blocks for b in range(1, blocks)], 100 * blocks).alias("cuts")).first().cuts if blocks > 1 else []
    own = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("i"))) if cuts else F.lit(0)
    sent = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "i", "v")
    found = sent.groupBy("a", "b").applyInArrow(_first_earlier(threshold, tile), "j long, i long, sim double")
    return found.groupBy("j").agg(F.min(F.struct("i", "sim")).alias("k")).select("j", "k.i", "k.sim")


def _by_first_rows(vectors: DataFrame, key: str, vector: str, gone_of) -> DataFrame:
    """key, kept_idx, similarity of the rows that go; ``gone_of`` tells them of the first rows of all vectors, and copies go with theirs or to it."""
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v"))
    measured = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) > 0  # what has a unit vector
    firsts = materialise(rows.where(measured).groupBy("v").agg(F.min("k").alias("row_idx"), F.count("*").alias("m")).withColumnRenamed("v", "embedding"), "first-rows")
    gone = materialise(gone_of(firsts), "semantic-gone")
    several = firsts.where("m > 1").select(F.col("row_idx").alias("first"), F.col("embedding").alias("v"))
    copies = rows.join(several, "v").where("k <> first").join(gone.withColumnRenamed("row_idx", "first"), "first", "left")
    copies = copies.select(F.col("k").alias("row_idx"), F.coalesce("kept_idx", "first").alias("kept_idx"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
    return gone.unionByName(copies).withColumnRenamed("row_idx", key)


def semantic(vectors: DataFrame, threshold: float, key: str = "row_idx", vector: str = "embedding", most: int = GROUP_LINKS) -> DataFrame:
    """key, kept_idx, similarity of the rows that go: cosine of at least ``threshold`` to an earlier row that stays.

    Equal vectors are compared once, by their first row: its copies go with it to the row that it
    goes to, or to itself. So a vector that a third of all rows share makes no pairs.
    """
    return _by_first_rows(vectors, key, vector, lambda firsts: greedy_keep(firsts.select("row_idx"), semantic_pairs(firsts, threshold), most=most))


def first_alike(vectors: DataFrame, threshold: float, key: str = "row_idx", vector: str = "embedding") -> DataFrame:
    """key, kept_idx, similarity of every row with a cosine of at least ``threshold`` to any earlier row: the first such row.

    Unlike in ``semantic``, that row may have an earlier one alike itself. Equal vectors are compared once.
    """
    return _by_first_rows(vectors, key, vector, lambda firsts: first_earlier(firsts, threshold).toDF("row_idx", "kept_idx", "similarity"))


def by_conversation(cases: DataFrame, order: str = "row_idx") -> DataFrame:
    """One case per conversation key: longest history, latest time, last seen; keyless rows stay.

    ``cases`` has conv_key, hist_len, ts (text). dialog_id becomes the trace id, else the key.
    """
    keyed = cases.where(F.coalesce(F.col("conv_key"), F.lit("")) != "")
    # only what decides goes into the aggregation; ``order`` tells the rows of a conversation apart
    place = F.struct("hist_len", F.coalesce("ts", F.lit("")).alias("ts"), F.col(order).alias("o"))
    best = keyed.select("conv_key", place.alias("place")).groupBy("conv_key").agg(F.max("place").alias("best"))
    best = best.select(F.col("conv_key").alias("best_key"), F.col("best.o").alias("best_o"))
    rows = keyed.join(best, (F.col("conv_key") == F.col("best_key")) & F.col(order).eqNullSafe(F.col("best_o")), "left_semi")
    rows = rows.withColumn("dialog_id", F.coalesce(F.nullif("trace_id", F.lit("")), "conv_key")) if "trace_id" in cases.columns else rows
    return rows.unionByName(cases.where(F.coalesce(F.col("conv_key"), F.lit("")) == ""), allowMissingColumns=True)
