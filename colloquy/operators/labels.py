"""Labels of raters and of a judge on items: what is valid, by whom, and how it is spread.

Items have ``item_id`` and ``human_labels``, a map of raters to labels; a label of several criteria is
a JSON object. A valid label is a text: 1 or 0, a whole number, a category, or ``c1=1, c2=0``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.values import binary_label, categorical_label, merge_maps, multi_label, ordinal_label


@dataclass(frozen=True)
class LabelSchema:
    """How labels of a pool are read: binary, ordinal, categorical or binary_multi."""

    mode: str = "binary"
    criteria: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    low: int = 1
    high: int = 5
    field: str = "result"


def by_criterion(label: Column, schema: LabelSchema) -> Column:
    """map<string,int> of a label of several criteria; null unless each has a value."""
    return multi_label(F.from_json(label, "map<string,string>"), list(schema.criteria))


def valid(label: Column, schema: LabelSchema) -> Column:
    """The label's text form, null where the schema doesn't allow it."""
    if schema.mode == "binary_multi":
        m = by_criterion(label, schema)
        parts = [F.concat(F.lit(f"{c}="), F.element_at(m, F.lit(c)).cast("string")) for c in schema.criteria]
        return F.when(m.isNotNull(), F.concat_ws(", ", *parts))
    if schema.mode == "ordinal":
        return ordinal_label(label, schema.low, schema.high).cast("string")
    if schema.mode == "categorical":
        return categorical_label(label, list(schema.categories))
    return binary_label(label).cast("int").cast("string")


def label_of(rater: str, schema: LabelSchema, labels: str = "human_labels") -> Column:
    """A rater's valid label."""
    return valid(F.try_element_at(labels, F.lit(rater)), schema)


def _all_valid(raters: list[str] | None, schema: LabelSchema, labels: str) -> Column:
    """Valid labels of the raters (of all without a list), in order of the raters."""
    entries = F.array_sort(F.map_entries(labels))
    entries = F.filter(entries, lambda e: e["key"].isin(raters)) if raters else entries
    return F.transform(entries, lambda e: valid(e["value"], schema))


def annotated_by(rater: str, schema: LabelSchema, labels: str = "human_labels") -> Column:
    """Whether the rater, or any rater for a blank name, has a valid label."""
    if rater.strip():
        return label_of(rater, schema, labels).isNotNull()
    return annotated(schema, None, labels)


def annotated(schema: LabelSchema, raters: list[str] | None = None, labels: str = "human_labels") -> Column:
    return F.coalesce(F.exists(_all_valid(raters, schema, labels), lambda x: x.isNotNull()), F.lit(False))


def consensus(schema: LabelSchema, raters: list[str], labels: str = "human_labels") -> Column:
    """At least two raters, all of them with valid labels, and all labels equal."""
    found = _all_valid(raters, schema, labels)
    same = F.size(F.array_distinct(found)) == 1
    return F.lit(len(raters) >= 2) & F.coalesce((F.size(found) == len(raters)) & ~F.exists(found, lambda x: x.isNull()) & same, F.lit(False))


def scored(schema: LabelSchema, label: str = "llm_label") -> Column:
    return valid(F.col(label), schema).isNotNull()


def first_valid(schema: LabelSchema, labels: str = "human_labels") -> Column:
    """The valid label of the first rater by name who has one."""
    return F.try_element_at(F.filter(_all_valid(None, schema, labels), lambda x: x.isNotNull()), F.lit(1))


def set_labels(items: DataFrame, updates: DataFrame) -> DataFrame:
    """Items whose raters' labels and notes are replaced by ``updates`` (item_id, rater, label, note).

    Updates without a rater's name do nothing; of several for one rater the last by label stays.
    """
    from ..functions import vocab

    told = updates.select("item_id", strip(F.coalesce("rater", F.lit(""))).alias("rater"), "label", F.coalesce("note", F.lit("")).alias("note")).where("rater <> ''")
    told = told.groupBy("item_id", "rater").agg(F.max(F.struct("label", "note")).alias("v")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("rater", "v.label"))).alias("new_labels"), F.map_from_entries(F.collect_list(F.struct("rater", "v.note"))).alias("new_notes"))
    rows = items.join(told, "item_id", "left")
    for column, new in (("human_labels", "new_labels"), ("human_notes", "new_notes")):
        old = F.coalesce(F.col(column), F.create_map().cast("map<string,string>"))
        rows = rows.withColumn(column, F.when(F.col(new).isNull(), F.col(column)).otherwise(merge_maps(old, F.col(new))))
    return rows.drop("new_labels", "new_notes", *(c for c in vocab.LEGACY_LABELS if c in items.columns))


def annotation_totals(items: DataFrame, schema: LabelSchema, label: str) -> DataFrame:
    """total, annotated, unannotated by a label column."""
    ok = valid(F.col(label), schema).isNotNull()
    return items.agg(F.count("*").alias("total"), F.count_if(ok).alias("annotated"), F.count_if(~ok).alias("unannotated"))


def label_counts(items: DataFrame, schema: LabelSchema, label: str, by: list[str] | None = None) -> DataFrame:
    """by..., criterion (null for a single label), value, n over valid labels."""
    by = by or []
    if schema.mode == "binary_multi":
        rows = items.select(*by, F.explode(by_criterion(F.col(label), schema)).alias("criterion", "value")).withColumn("value", F.col("value").cast("string"))
    else:
        rows = items.select(*by, F.lit(None).cast("string").alias("criterion"), valid(F.col(label), schema).alias("value")).where("value is not null")
    return rows.groupBy(*by, "criterion", "value").agg(F.count("*").alias("n"))


def infer_schema(items: DataFrame, labels: str = "human_labels") -> LabelSchema | None:
    """The schema of the most common set of keys among labels that are objects; None without any."""
    keys = F.map_keys(F.from_json("label", "map<string,string>"))
    sets = items.select(F.explode(F.map_values(labels)).alias("label")).select(F.array_sort(keys).alias("keys")).where(F.size("keys") > 0)
    best = sets.groupBy("keys").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keys").first()
    if best is None:
        return None
    return LabelSchema("binary_multi", tuple(best["keys"])) if len(best["keys"]) > 1 else LabelSchema("binary", field=best["keys"][0])


def stratum(label: Column, schema: LabelSchema) -> Column:
    """The stratum of an item: its criteria and values, or field and value; null without a valid label."""
    v = valid(label, schema)
    return v if schema.mode == "binary_multi" else F.concat(F.lit(f"{schema.field}="), v)


# --- splits of a pool


def split_of(c: Column) -> Column:
    """train or test, null for anything else."""
    return F.when(c.isin("train", "test"), c)


def of_split(items: DataFrame, split: str, column: str = "split") -> DataFrame:
    return items.where(split_of(F.col(column)) == split)


def split_counts(items: DataFrame, column: str = "split") -> DataFrame:
    """split (train, test, unset), n."""
    return items.groupBy(F.coalesce(split_of(F.col(column)), F.lit("unset")).alias("split")).agg(F.count("*").alias("n"))


def has_split(items: DataFrame, column: str = "split") -> DataFrame:
    return items.agg(F.coalesce(F.bool_or(split_of(F.col(column)).isNotNull()), F.lit(False)).alias("has_split"))


def clear_splits(items: DataFrame, column: str = "split") -> DataFrame:
    return items.drop(column)


# --- a judge's answers against the raters


def paired_labels(items: DataFrame, schema: LabelSchema, human: str = "human_label", judge: str = "llm_label") -> DataFrame:
    """item_id, y1, y2 of the items where both labels are valid."""
    return items.select("item_id", valid(F.col(human), schema).alias("y1"), valid(F.col(judge), schema).alias("y2")).where("y1 is not null and y2 is not null")


def run_errors(items: DataFrame, schema: LabelSchema, missing: str = "Не удалось получить метку от LLM") -> DataFrame:
    """item_id, goals, error of annotated items that a judge's batch left without a valid label."""
    said = F.nullif(strip(F.coalesce("llm_error", F.lit(""))), F.lit(""))
    error = F.coalesce(said, F.when(~scored(schema), F.lit(missing)))
    goals = strip(F.coalesce("goals", F.lit("")))
    cut = F.when(F.length(goals) > 160, F.concat(F.substring(goals, 1, 157), F.lit("…"))).otherwise(goals)
    known = valid(F.col("human_label"), schema).isNotNull() | annotated(schema)
    return items.where(known).select("item_id", F.coalesce(F.nullif(cut, F.lit("")), F.lit("—")).alias("goals"), error.alias("error")).where("error is not null")


def calibration_items(cases: DataFrame) -> DataFrame:
    """item_id, human_label, human_note: the only rater's label and note; of several raters neither."""
    only = F.size("human_labels") == 1
    name = F.element_at(F.map_keys("human_labels"), 1)
    return cases.select("item_id", F.when(only, F.try_element_at("human_labels", name)).alias("human_label"), F.when(only, F.coalesce(F.try_element_at("human_notes", name), F.lit(""))).otherwise(F.lit("")).alias("human_note"))
