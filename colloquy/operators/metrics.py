"""Sample metrics, distributions and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from .ranks import rank_within


def normalized_entropy(counts: DataFrame, n: str = "n") -> DataFrame:
    """-sum(p ln p) / ln k over positive counts; 0 for at most one category."""
    pos = counts.where(F.col(n) > 0).select(F.col(n).cast("double").alias("n"))
    agg = pos.agg(F.sum("n").alias("t"), F.count("*").alias("k"), F.sum(F.col("n") * F.log("n")).alias("s"))
    h = (F.log("t") - F.col("s") / F.col("t")) / F.log(F.col("k").cast("double"))
    return agg.select(F.when(F.col("k") <= 1, F.lit(0.0)).otherwise(h).alias("entropy"))


def gini(counts: DataFrame, n: str = "n") -> DataFrame:
    """sum((2i - k - 1) v_i) / (k sum v), v ascending and positive.

    Equal counts share one row first, so what is ordered is the number of different counts.
    """
    levels = counts.where(F.col(n) > 0).groupBy(F.col(n).cast("double").alias("v")).agg(F.count("*").cast("double").alias("m"))
    below = F.sum("m").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    ranked = levels.withColumn("b", F.coalesce(below, F.lit(0.0)))
    # ranks b+1..b+m of a level sum to m b + m (m + 1) / 2
    agg = ranked.agg(F.sum(F.col("v") * (2 * (F.col("m") * F.col("b") + F.col("m") * (F.col("m") + 1) / 2))).alias("s"), F.sum(F.col("v") * F.col("m")).alias("t"), F.sum("m").alias("k"))
    g = (F.col("s") - (F.col("k") + 1) * F.col("t")) / (F.col("k") * F.col("t"))
    return agg.select(F.coalesce(F.try_divide(g, F.lit(1.0)), F.lit(0.0)).alias("gini"))


def max_min_ratio(counts: DataFrame, n: str = "n") -> DataFrame:
    pos = counts.where(F.col(n) > 0)
    return pos.agg(F.when(F.count("*") >= 2, F.max(n) / F.min(n)).alias("max_min"))


def unit(vector: Column) -> Column:
    """Vector over its norm; null for a null or zero vector."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mean_pairwise_cosine(vectors: DataFrame, by: list[str] | None = None, vector: str = "embedding") -> DataFrame:
    """Mean cosine over all pairs, exact in one pass: (|sum u|^2 - n) / (n (n - 1)); null below two vectors."""
    by = by or []
    units = vectors.select(*by, F.posexplode(unit(F.col(vector))).alias("d", "x"))
    dims = units.groupBy(*by, "d").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    out = dims.groupBy(*by) if by else dims.groupBy()
    n = F.max("n").cast("double")
    return out.agg(F.max("n").alias("n"), F.when(F.max("n") >= 2, (F.sum(F.col("s") * F.col("s")) - n) / (n * (n - 1))).alias("mean_cosine"))


def counts_of(records: DataFrame, column: str) -> DataFrame:
    return records.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))


def sample_metrics(records: DataFrame, goal: str = "goal", turns: str = "turns", cluster: str = "cluster_id") -> DataFrame:
    """One row: dialogs, turns, mean turns, and number, entropy, Gini and max/min of goals and of clusters >= 0."""
    base = records.agg(F.count("*").alias("n_dialogs"), F.coalesce(F.sum(turns), F.lit(0)).alias("n_turns"), F.avg(turns).alias("mean_turns"))
    out = base
    for name, counts in (("goals", counts_of(records, goal)), ("clusters", counts_of(records.where(F.col(cluster) >= 0), cluster))):
        parts = counts.agg(F.count("*").alias(f"n_{name}"))
        for f, c in ((normalized_entropy, "entropy"), (gini, "gini"), (max_min_ratio, "max_min")):
            parts = parts.crossJoin(F.broadcast(f(counts).withColumnRenamed(c, f"{name}_{c}")))  # rows of one row
        out = out.crossJoin(F.broadcast(parts))
    return out


def coverage(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Share of the baseline's categories that the current sample has, in percent; null without any."""
    a, b = (counts_of(x, column).where("n > 0").select("category") for x in (baseline, current))
    hit = a.join(b.withColumn("hit", F.lit(1)), "category", "left")
    return hit.agg(F.try_divide(100.0 * F.count("hit"), F.count("*")).alias("coverage_pct"))


def compare_samples(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """metric, baseline, current, delta of the numeric sample metrics, and goal and cluster coverage."""
    def long(records: DataFrame, name: str) -> DataFrame:
        row = sample_metrics(records)
        return row.select(F.explode(F.create_map(*[x for c in row.columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("metric", name))

    both = long(baseline, "baseline").join(long(current, "current"), "metric", "full").withColumn("delta", F.col("current") - F.col("baseline"))
    for c in ("goal", "cluster_id"):
        row = coverage(baseline, current, c).select(F.lit(f"{c}_coverage_pct").alias("metric"), F.lit(None).cast("double").alias("baseline"), F.col("coverage_pct").alias("current"), F.lit(None).cast("double").alias("delta"))
        both = both.unionByName(row)
    lower_is_better = F.col("metric").rlike("gini|max_min|cosine")
    trend = F.when(F.col("delta").isNull() | (F.col("delta") == 0), "=").when((F.col("delta") > 0) != lower_is_better, "better").otherwise("worse")
    return both.withColumn("trend", trend)


def cluster_quality(records: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    sizes = records.groupBy(F.coalesce(F.col(cluster), F.lit(vocab.NO_EMBEDDING)).alias("c")).agg(F.count("*").alias("n"))
    real = F.when(F.col("c") >= 0, F.col("n"))
    total = F.sum("n")
    noise = F.coalesce(F.sum(F.when(F.col("c") == vocab.NOISE, F.col("n"))), F.lit(0))
    return sizes.agg(F.count(real).alias("n_clusters"), noise.alias("n_noise"), F.round(F.try_divide(100.0 * noise, total), 1).alias("noise_pct"), F.round(F.avg(real), 1).alias("avg_size"), F.count_if(real == 1).alias("singletons"), F.count_if(real <= 2).alias("small"))


def cluster_sizes(records: DataFrame, cluster: str = "cluster_id", label: str = "cluster_label", order: str = "row_idx") -> DataFrame:
    """Count, share and the first record's label per cluster."""
    sizes = records.groupBy(F.coalesce(F.col(cluster), F.lit(vocab.NO_EMBEDDING)).alias("cluster_id")).agg(F.count("*").alias("n"), F.min_by(label, order).alias("label"))
    total = records.agg(F.count("*").alias("total"))
    return sizes.crossJoin(F.broadcast(total)).select("cluster_id", "n", "label", (100.0 * F.col("n") / F.col("total")).alias("share_pct"))


def cluster_summary(records: DataFrame, text: str, cluster: str = "cluster_id", order: str = "row_idx", examples: int = 3) -> DataFrame:
    """Per cluster: count, distinct texts and the first distinct examples."""
    per_text = records.groupBy(F.col(cluster).alias("cluster_id"), F.col(text).alias("t")).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    counts = per_text.groupBy("cluster_id").agg(F.sum("n").alias("n"), F.count("*").alias("distinct_texts"))
    return counts.join(_first(per_text, "cluster_id", ["o", "t"], "t", examples), "cluster_id").withColumnRenamed("first", "examples")


def _first(rows: DataFrame, by: str, order: list[str], value: str, most: int) -> DataFrame:
    """by, first: the values of the first rows of a group; each task keeps ``most`` rows of a group."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    best = rows.select(by, *dict.fromkeys([*order, value])).withColumn("k", rank).where(F.col("k") <= most)
    return best.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("k", value))).alias("e")).select(by, F.col(f"e.{value}").alias("first"))


def stats_report(records: DataFrame, label: str, source: str) -> DataFrame:
    """Counts by label, by source and by both in one pass."""
    rows = records.select(F.col(label).alias("label"), F.substring(F.coalesce(F.col(source), F.lit("")), 1, 80).alias("source"))
    sets = rows.groupingSets([["label"], ["source"], ["label", "source"]], "label", "source")
    return sets.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def mode_value(records: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """Most frequent value per group; the first seen on ties."""
    counts = records.groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(by).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def failure_groups(failures: DataFrame, field: str, id_col: str, order: str, examples: int = 5, width: int = 120) -> DataFrame:
    """Groups of failures by a field: rank, value, count, share and the first ids."""
    value = F.coalesce(F.nullif(F.trim(F.col(field).cast("string")), F.lit("")), F.lit(vocab.EMPTY))
    rows = failures.select(value.alias("value"), F.substring(F.col(id_col).cast("string"), 1, 12).alias("id"), F.col(order).alias("o"))
    groups = rows.groupBy("value").agg(F.count("*").alias("n")).join(_first(rows, "value", ["o"], "id", examples), "value")
    total = failures.agg(F.count("*").alias("total"))
    ranked = rank_within(groups.withColumn("low", F.lower("value")), [], [F.col("n").desc(), "low", "value"])
    cut = F.when(F.length("value") > width, F.concat(F.substring("value", 1, width - 1), F.lit("…"))).otherwise(F.col("value"))
    return ranked.crossJoin(F.broadcast(total)).select(F.col("rank").cast("int").alias("rank"), cut.alias("value"), "n", (100.0 * F.col("n") / F.col("total")).alias("share_pct"), F.array_join("first", ",").alias("ids"))


def fingerprint(rows: DataFrame, field: str, turn: int, id_col: str, text_col: str, order: str) -> DataFrame:
    """16 hex digits that change with the field, the number, order, ids or texts of the rows.

    A tree of digests: rows are hashed on their own, then the hashes of 1024 neighbours in ``order``
    (a whole number) together, and so on three levels up; no row gathers more than its own branch.
    """
    one = F.sha2(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))), 256)
    level = rows.select(F.col(order).cast("long").alias("o"), one.alias("h"), F.lit(1).cast("long").alias("n"))
    for _ in range(3):
        level = level.groupBy(F.shiftright("o", 10).alias("o")).agg(_joined_hash(), F.sum("n").alias("n"))
    top = level.groupBy().agg(_joined_hash(), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return top.select(F.substring(F.sha2(F.concat(F.lit(f"{field}|{turn}|"), F.col("n").cast("string"), F.lit("|"), "h"), 256), 1, 16).alias("fingerprint"))


def _joined_hash() -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), "|"), 256).alias("h")


def length_stats(records: DataFrame, turns: str = "turns") -> DataFrame:
    t = F.col(turns)
    return records.agg(F.count("*").alias("n"), F.sum(t).alias("total"), F.min(t).alias("min"), F.avg(t).alias("mean"), F.median(t).alias("median"), F.max(t).alias("max"))


def by_turns(records: DataFrame, low: int = 0, high: int = 0, turns: str = "turns") -> DataFrame:
    """Records of low to high turns; 0 leaves a side open."""
    keep = F.lit(True)
    keep = keep & (F.col(turns) >= low) if low > 0 else keep
    return records.where(keep & (F.col(turns) <= high) if high > 0 else keep)


def doc_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Whether texts are too repetitive or too short for topics."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    s = docs.agg(F.count("*").alias("n"), F.count_if(t != "").alias("n_non_empty"), F.count_distinct(F.when(t != "", t)).alias("n_unique"), F.avg(F.when(t != "", F.length(t))).alias("mean_len"))
    return s.select("*", (F.col("n_unique") < F.greatest(F.lit(3), F.floor(F.col("n_non_empty") / 8))).alias("repetitive"), (F.coalesce("mean_len", F.lit(0.0)) < 35).alias("short"))
