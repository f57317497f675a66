"""Contexts and generation forms of test cases; ``context`` is map<string,string>."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import goals_text
from ..functions.values import positive_int

STOP_KEYS = ("stop_block_id", "dm_stop_block_id")


def common_context(cases: DataFrame) -> DataFrame:
    """key, value of the context entries that all cases share."""
    total = cases.agg(F.count("*").alias("total"))
    keys = cases.select(F.explode("context").alias("key", "value")).groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("value").alias("kinds"), F.min("value").alias("value"))
    return keys.crossJoin(F.broadcast(total)).where("n = total and kinds = 1").select("key", "value")


def context_summary(cases: DataFrame, order: str = "row_idx", examples: int = 3) -> DataFrame:
    """key, examples: the first distinct values of every context key, by key."""
    seen = cases.select(F.col(order).alias("o"), F.explode("context").alias("key", "value")).groupBy("key", "value").agg(F.min("o").alias("o"))
    ranked = seen.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("o", "value"))).where(F.col("k") <= examples)
    return ranked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("e")).select("key", F.col("e.value").alias("examples"))


def form_rows(cases: DataFrame, order: str = "row_idx", with_stop: bool = False) -> DataFrame:
    """text, context, n (1 to 500) of equal goals and residual contexts, in order of appearance."""
    shared = [r.key for r in common_context(cases).select("key").collect()]  # keys of one record
    rest = F.map_filter("context", lambda k, v: ~k.isin(shared + list(STOP_KEYS))) if shared else F.map_filter("context", lambda k, v: ~k.isin(list(STOP_KEYS)))
    canonical = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(rest))))
    stop = positive_int(*(F.try_element_at("context", F.lit(k)) for k in STOP_KEYS)) if with_stop else F.lit(0)
    rows = cases.select(goals_text(F.col("goals"), " | ").alias("text"), canonical.alias("context"), stop.alias("stop_id"), F.col(order).alias("o"))
    g = rows.groupBy("text", "context", "stop_id").agg(F.greatest(F.lit(1), F.least(F.lit(500), F.count("*").cast("int"))).alias("n"), F.min("o").alias("o"))
    return g.orderBy("o")


def persona(*candidates):
    """First usable text that isn't the prompt's own placeholder."""
    from ..functions.text import non_blank

    ok = [F.when(~F.regexp_replace(non_blank(c), r"\s+", "").isin("{user_prompt}", "｛user_prompt｝"), non_blank(c)) for c in candidates]
    return F.coalesce(*ok, F.lit(""))
