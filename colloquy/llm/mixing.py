"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected copies, target over size. In the order of
document sizes their prefix sums are cut by a grid of integers that one random offset moves: a
document is emitted once per integer crossed. As neighbours in that order are about equally long,
the words taken differ from the target by about one document.

Ranks come from range partitions of (source, size, id) and the counts of the partitions before, so
a source with a third of all rows spreads over as many tasks as its rows fill.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, checked_broadcast, column_of, materialise, partitions, pick, positional

WEIGHTS, MOST = (5, 2, 1), 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """source, source_size, target: ``share`` of all words divided by weight, no target above ``most`` times its source.

    Sources take ``weights`` in turn by code point, null last. What a full source can't take goes to
    the others by weight until none is above; that is one level for all that aren't full, found by
    going through the sources by the level at which each is full. There is a row per source.
    """
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")).cast("long")
    table = materialise(table.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")), "mix-sources")
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(share) if share != 1.0 else F.sum("source_size").over(everything)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    levels = table.withColumn("left", total - F.coalesce(F.sum("cap").over(upto), F.lit(0))).withColumn("of", F.sum("weight").over(onward)).withColumn("at", F.row_number().over(by_level))
    levels = levels.withColumn("fits", F.col("left") * F.col("weight") <= F.col("cap") * F.col("of"))
    first = F.min(F.when(F.col("fits"), F.struct("at", "left", "of"))).over(everything)
    levels = levels.withColumn("first", first)
    level = (F.col("first.left") * F.col("weight")).cast("double") / F.col("first.of").cast("double")
    target = F.when(F.col("first").isNull() | (F.col("at") < F.col("first.at")), F.col("cap").cast("double")).otherwise(level)
    return levels.select("source", "source_size", target.alias("target"))


def mix_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST, seed: int = 42) -> DataFrame:
    """Per row: doc_id, tie, size (words), source, source_size, target, copies, taken.

    Null sources form one source, the last. Null and empty texts have no words; they count as
    documents and take nothing. Ids may be null or repeat: rows are ranked by size, id and a hash of
    the text, so a rerun gives the same copies. No document gets more than ``most`` copies. An empty
    table gives no rows.
    """
    src = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"), source=(source_col, "string"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sized = materialise(src.select("doc_id", "source", F.xxhash64("text").alias("tie"), size.alias("size")), "mix-sized")
    order = [F.col("source").asc_nulls_last(), "size", "doc_id", "tie"]
    targets = materialise(source_targets(sized, weights, most), "mix-targets")
    dealt = materialise(sized.repartitionByRange(4 * partitions(docs.sparkSession), *order).withColumn("part", F.spark_partition_id()), "mix-dealt")
    # rows of the source in the partitions before: a row per partition and source
    counts = dealt.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("source", "part", before.alias("before")).join(checked_broadcast(targets.withColumnRenamed("source", "t_source")), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    counts = materialise(counts, "mix-counts").withColumnsRenamed({"source": "c_source", "part": "c_part"})
    rank = F.row_number().over(Window.partitionBy("part", "source").orderBy("size", "doc_id", "tie"))
    rows = dealt.withColumn("rank", rank).join(checked_broadcast(counts), (F.col("part") == F.col("c_part")) & F.col("source").eqNullSafe(F.col("c_source")))
    offset = F.lit(random.Random(seed).random())
    k = F.col("rank") + F.col("before")

    def crossed(upto):
        return F.floor((upto * F.col("target")) / F.col("source_size") + offset)

    copies = F.when(F.col("source_size") > 0, F.least(crossed(k) - crossed(k - 1), F.lit(most).cast("long"))).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("copies", copies).select("doc_id", "tie", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns.

    A row is known by its id, text and source. Only rows that repeat all three are numbered to share
    out the copies of their group; of the others each has one row of the plan.
    """
    inner, names = positional(docs)
    plan = materialise(mix_copies(docs, id_col, text_col, source_col, **options).select("doc_id", "tie", "source", "copies"), "mix-plan")
    key = ["doc_id", "tie", "source"]
    other = {"doc_id": "r_id", "tie": "r_tie", "source": "r_source", "turn": "r_turn"}
    left = inner.select("*", F.col(column_of(names, id_col)).cast("long").alias("doc_id"), F.xxhash64(F.col(column_of(names, text_col)).cast("string")).alias("tie"), F.col(column_of(names, source_col)).cast("string").alias("source"))
    same = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("tie") == F.col("r_tie")) & F.col("source").eqNullSafe(F.col("r_source"))
    repeated = materialise(plan.groupBy(*key).count().where("count > 1").select(*key).withColumnsRenamed(other), "mix-repeats")
    if repeated.isEmpty():
        out = left.join(plan.where("copies > 0").withColumnsRenamed(other), same)
    else:
        repeated = checked_broadcast(repeated)
        single = left.join(repeated, same, "left_anti").join(plan.join(repeated, same, "left_anti").where("copies > 0").withColumnsRenamed(other), same)
        group = Window.partitionBy(*key)
        told = [f.name for f in inner.schema if "map<" not in f.dataType.simpleString()]
        several = left.join(repeated, same, "left_semi").withColumn("turn", F.row_number().over(group.orderBy(F.xxhash64(*told))))
        turns = plan.join(repeated, same, "left_semi").withColumn("turn", F.row_number().over(group.orderBy("copies"))).where("copies > 0")
        out = single.select(*inner.columns, "copies").unionByName(several.join(turns.withColumnsRenamed(other), same & (F.col("turn") == F.col("r_turn"))).select(*inner.columns, "copies"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*inner.columns).toDF(*docs.columns)
