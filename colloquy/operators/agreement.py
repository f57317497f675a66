"""Agreement of two or more raters.

All two-rater metrics come from one confusion table (a row per pair of labels, so its size is that
of the label vocabulary), which can be grouped by criterion, rater pair or replicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(pairs: DataFrame, y1: str, y2: str, by: list[str] | None = None) -> DataFrame:
    """by..., y1, y2, n over the rows where both labels are present."""
    return pairs.where(F.col(y1).isNotNull() & F.col(y2).isNotNull()).groupBy(*(by or []), F.col(y1).alias("y1"), F.col(y2).alias("y2")).agg(F.count("*").cast("double").alias("n"))


def _joined(left: DataFrame, right: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    return left.join(right, by, how) if by else left.crossJoin(F.broadcast(right))


def two_rater_metrics(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by..., n, exact, pabak, kappa, alpha_nominal of a confusion table.

    kappa is null below two items and, if chance alone explains all, 1 for full agreement, else 0.
    """
    by = by or []
    t = table.groupBy(*by) if by else table.groupBy()
    totals = t.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("y1") == F.col("y2"), F.col("n")).otherwise(0.0)).alias("same"))
    rows = table.groupBy(*by, F.col("y1").alias("label")).agg(F.sum("n").alias("r"))
    cols = table.groupBy(*by, F.col("y2").alias("label")).agg(F.sum("n").alias("c"))
    both = rows.join(cols, [*by, "label"], "full")
    r, c = F.coalesce("r", F.lit(0.0)), F.coalesce("c", F.lit(0.0))
    sums = (both.groupBy(*by) if by else both.groupBy()).agg(F.sum(r * c).alias("rc"), F.sum((r + c) * (r + c)).alias("m2"))
    s = _joined(totals, sums, by)
    po, pe = F.col("same") / F.col("total"), F.col("rc") / (F.col("total") * F.col("total"))
    kappa = F.when(F.col("total") < 2, F.lit(None)).when(pe >= 1, F.when(po >= 1, 1.0).otherwise(0.0)).otherwise(F.try_divide(po - pe, 1 - pe))
    # coincidences: 2n values, off-diagonal 2 (n - same)
    v = 2 * F.col("total")
    alpha = F.when(F.col("total") >= 2, F.coalesce(1 - F.try_divide((v - 1) * 2 * (F.col("total") - F.col("same")), v * v - F.col("m2")), F.lit(None).cast("double")))
    return s.select(*by, F.col("total").cast("long").alias("n"), F.try_divide(F.col("same"), F.col("total")).alias("exact"), (2 * F.try_divide(F.col("same"), F.col("total")) - 1).alias("pabak"), kappa.alias("kappa"), alpha.alias("alpha_nominal"))


def binary_counts(table: DataFrame, positive, by: list[str] | None = None) -> DataFrame:
    """by..., tp, fp, fn, tn; y1 is the truth and y2 the prediction."""
    t, p = F.col("y1") == F.lit(positive), F.col("y2") == F.lit(positive)
    g = table.groupBy(*by) if by else table.groupBy()
    cell = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0.0))
    return g.agg(cell(t & p).alias("tp"), cell(~t & p).alias("fp"), cell(t & ~p).alias("fn"), cell(~t & ~p).alias("tn"))


def binary_scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and mcc.

    A class that neither side has leaves precision, recall and f1 null; one that only one side has
    makes them 0 where they are undefined. A zero denominator leaves mcc null.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    none = (tp + fp + fn) == 0
    part = lambda d: F.when(none, F.lit(None)).otherwise(F.coalesce(F.try_divide(tp, d), F.lit(0.0)))
    mcc = F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return counts.select("*", part(tp + fp).alias("precision"), part(tp + fn).alias("recall"), F.when(none, F.lit(None)).otherwise(F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))).alias("f1"), mcc.alias("mcc"))


def per_class(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by..., label with tp, fp, fn, tn of one versus the rest."""
    by = by or []
    rows = table.groupBy(*by, F.col("y1").alias("label")).agg(F.sum("n").alias("r"))
    cols = table.groupBy(*by, F.col("y2").alias("label")).agg(F.sum("n").alias("c"))
    diag = table.where("y1 = y2").select(*by, F.col("y1").alias("label"), F.col("n").alias("tp"))
    total = (table.groupBy(*by) if by else table.groupBy()).agg(F.sum("n").alias("total"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    all_ = _joined(rows.join(cols, [*by, "label"], "full").join(diag, [*by, "label"], "left"), total, by)
    return all_.select(*by, "label", z("tp").alias("tp"), (z("c") - z("tp")).alias("fp"), (z("r") - z("tp")).alias("fn"), (F.col("total") - z("r") - z("c") + z("tp")).alias("tn"))


def macro_scores(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Unweighted class means: precision and recall with 0 where undefined, f1 and mcc over classes that have one."""
    by = by or []
    s = binary_scores(per_class(table, by))
    g = s.groupBy(*by) if by else s.groupBy()
    return g.agg(F.avg(F.coalesce("precision", F.lit(0.0))).alias("macro_precision"), F.avg(F.coalesce("recall", F.lit(0.0))).alias("macro_recall"), F.avg("f1").alias("macro_f1"), F.avg("mcc").alias("mean_mcc"))


def confusion_matrix(table: DataFrame, labels: list) -> DataFrame:
    """Row per label of y1, column per label of y2, in the given order."""
    order = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(i))])
    return table.groupBy("y1").pivot("y2", labels).agg(F.sum("n")).fillna(0.0).orderBy(F.element_at(order, F.col("y1")))


def label_order(label: Column) -> Column:
    """Sort key: known words (false before true), numbers, other texts."""
    t = F.lower(label.cast("string"))
    known = F.array_position(F.array(*map(F.lit, ["0", "false", "нет", "no", "1", "true", "да", "yes"])), t).cast("double")
    return F.struct(F.when(known > 0, 0).when(t.try_cast("double").isNotNull(), 1).otherwise(2).alias("a"), F.coalesce(F.nullif(known, F.lit(0.0)), t.try_cast("double"), F.lit(0.0)).alias("b"), t.alias("c"))


def ordinal_metrics(pairs: DataFrame, y1: str, y2: str) -> DataFrame:
    """within_one, pearson and spearman (average ranks), from the confusion table of integer labels."""
    t = confusion(pairs, y1, y2)
    x, y, n = F.col("y1").cast("double"), F.col("y2").cast("double"), F.col("n")

    def ranks(c: str, name: str) -> DataFrame:
        m = t.groupBy(c).agg(F.sum("n").alias("m"))
        below = F.coalesce(F.sum("m").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        return m.select(c, (below + (F.col("m") + 1) / 2).alias(name))

    def corr(a: Column, b: Column) -> Column:
        w, sa, sb = F.sum(n), F.sum(n * a), F.sum(n * b)
        return F.try_divide(w * F.sum(n * a * b) - sa * sb, F.sqrt((w * F.sum(n * a * a) - sa * sa) * (w * F.sum(n * b * b) - sb * sb)))

    full = t.join(F.broadcast(ranks("y1", "ra")), "y1").join(F.broadcast(ranks("y2", "rb")), "y2")  # a row per label
    return full.agg(F.sum(n).cast("long").alias("n"), F.try_divide(F.sum(F.when(F.abs(x - y) <= 1, n).otherwise(0.0)), F.sum(n)).alias("within_one"), corr(x, y).alias("pearson"), corr(F.col("ra"), F.col("rb")).alias("spearman"))


def krippendorff(ratings: DataFrame, mode: str = "nominal", item: str = "item_id", label: str = "label") -> DataFrame:
    """alpha of any number of raters with missing ratings; null without two ratings of an item or variation.

    ``ratings`` has a row per item and rater. Items with one rating don't count.
    """
    cells = ratings.where(F.col(label).isNotNull()).groupBy(F.col(item).alias("u"), F.col(label).cast("double" if mode == "ordinal" else "string").alias("v")).agg(F.count("*").cast("double").alias("k"))
    units = cells.withColumn("m", F.sum("k").over(Window.partitionBy("u"))).where("m >= 2")
    a, b = units.select("u", F.col("v").alias("c"), F.col("k").alias("ck"), "m"), units.select("u", F.col("v").alias("d"), F.col("k").alias("dk"))
    pair = F.when(F.col("c") == F.col("d"), F.col("ck") * (F.col("ck") - 1)).otherwise(F.col("ck") * F.col("dk")) / (F.col("m") - 1)
    o = a.join(b, "u").groupBy("c", "d").agg(F.sum(pair).alias("o"))
    marg = o.groupBy("c").agg(F.sum("o").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    marg = marg.withColumn("mid", below + F.col("n") / 2)
    left, right = F.broadcast(marg.select("c", F.col("n").alias("nc"), F.col("mid").alias("mc"))), F.broadcast(marg.select(F.col("c").alias("d"), F.col("n").alias("nd"), F.col("mid").alias("md")))  # a row per label
    gap = (F.col("mc") - F.col("md")) * (F.col("mc") - F.col("md")) if mode == "ordinal" else F.when(F.col("c") == F.col("d"), 0.0).otherwise(1.0)
    seen = o.join(left, "c").join(right, "d").agg(F.sum(F.col("o") * gap).alias("do"), F.sum("o").alias("total"))
    chance = left.crossJoin(right).agg(F.sum(F.col("nc") * F.col("nd") * gap).alias("de"))
    return seen.crossJoin(F.broadcast(chance)).select((1 - F.try_divide((F.col("total") - 1) * F.col("do"), F.col("de"))).alias("alpha"))


def rater_pairs(ratings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by..., rater_a, rater_b and their metrics; an equi-join on the item, so pairs of ratings of one item only."""
    by = by or []
    a = ratings.select(*by, "item_id", F.col("rater").alias("rater_a"), F.col("label").alias("la"))
    b = ratings.select(*by, "item_id", F.col("rater").alias("rater_b"), F.col("label").alias("lb"))
    both = a.join(b, [*by, "item_id"]).where("rater_a < rater_b")
    keys = [*by, "rater_a", "rater_b"]
    return two_rater_metrics(confusion(both, "la", "lb", keys), keys)


def overlap(ratings: DataFrame) -> DataFrame:
    """Items with at least two ratings, and with those of all raters."""
    raters = ratings.agg(F.count_distinct("rater").alias("raters"))
    per = ratings.where("label is not null").groupBy("item_id").agg(F.count_distinct("rater").alias("k"))
    return per.crossJoin(F.broadcast(raters)).agg(F.count_if(F.col("k") >= 2).alias("n_compared"), F.count_if(F.col("k") == F.col("raters")).alias("n_full"))


def disagreements(ratings: DataFrame) -> DataFrame:
    """Items whose raters differ, with the labels by rater."""
    g = ratings.where("label is not null").groupBy("item_id").agg(F.count_distinct("label").alias("k"), F.array_sort(F.collect_list(F.struct("rater", "label"))).alias("labels"))
    return g.where("k > 1").drop("k")


def criteria_summary(metrics: DataFrame) -> DataFrame:
    """Unweighted means and minima over criteria, all of which are computed."""
    return metrics.agg(F.count("*").alias("n_criteria"), F.avg("exact").alias("exact"), F.avg("pabak").alias("pabak"), F.avg("kappa").alias("kappa"), F.min("kappa").alias("min_kappa"), F.min("pabak").alias("min_pabak"))


def best_variant(metrics: DataFrame, primary: str = "min_kappa", variant: str = "variant") -> DataFrame:
    """The best variant by the primary metric, then pabak, then f1; a missing metric counts as -2."""
    miss = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(-2.0))
    return metrics.agg(F.max_by(variant, F.struct(miss(primary), miss("pabak"), miss("f1"))).alias(variant))


def quality_label(pabak: Column) -> Column:
    return F.when(pabak.isNull(), "—").when(pabak >= 0.8, "high").when(pabak >= 0.6, "acceptable").otherwise("low")


def sample_size(population: Column, z: float = 1.96, p: float = 0.5, margin: float = 0.05) -> Column:
    """Cochran's size with finite-population correction, rounded up and within 1 and the population."""
    n = z * z * p * (1 - p) / (margin * margin)
    size = F.ceil(F.lit(n) / (1 + (F.lit(n) - 1) / population)).cast("long")
    return F.when(population <= 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.least(size, population.cast("long"))))
