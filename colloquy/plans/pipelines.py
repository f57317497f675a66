"""The three main plans: clustering a sample, evaluating existing dialogs, comparing judges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import cluster_text, for_embedding, goals_text, template, transcript, validate_field
from ..operators import agreement, cluster, dedup, density, layout, metrics, scoring, topics
from ..shared import materialise
from .providers import Embedder, Judge, ask, embed


@dataclass
class ClusteringResult:
    records: DataFrame
    keywords: DataFrame
    quality: DataFrame
    summary: DataFrame
    removed: DataFrame


def cluster_sample(records: DataFrame, embedder: Embedder, field: str = "dialog", threshold: float | None = 0.95, min_cluster_size: int = 5, min_samples: int = 1, outliers: bool = False, components: int | None = None, reduction: str = "pca", coordinates: bool = False, vocabulary: str = "clusters") -> ClusteringResult:
    """Dedup, text, embeddings, density clusters, keywords and labels of a dialog sample (row_idx, history).

    ``components`` cuts the embeddings before clustering, to principal components or, with
    ``reduction`` graph, to a layout of the neighbour graph; ``coordinates`` adds x and y of a
    two-dimensional layout of the whole embeddings. The keywords come from the vocabulary of the
    clusters' texts or, with ``vocabulary`` topics, from that of topics as documents.
    """
    field = validate_field(field)
    text = cluster_text(F.col("history"), field) if field in vocab.HISTORY_FIELDS else F.col(field)
    rows = materialise(records.withColumn("text", text), "texts")  # each text is made once, and compared once
    marked = materialise(dedup.exact(rows, "text"), "marked")
    exact = marked.where("dup").select("row_idx", "kept_idx", F.lit("exact").alias("reason"), F.lit(1.0).alias("similarity"))
    rows = marked.where("not dup").drop("dup", "kept_idx").withColumn("model_text", for_embedding(F.col("text"), field))
    rows = materialise(embed(rows, "model_text", embedder), "embedded")  # the provider is asked once
    removed = exact
    if threshold is not None:
        gone = dedup.semantic(rows.where("text <> ''"), threshold)
        removed = removed.unionByName(gone.select("row_idx", "kept_idx", F.lit("semantic").alias("reason"), "similarity"))
        rows = rows.join(gone.select("row_idx"), "row_idx", "left_anti")
    places = layout.graph_layout(rows) if coordinates else None
    if components is not None:
        rows = layout.graph_reduced(rows, cluster.layout_components(components, components, rows.count())) if reduction == "graph" else cluster.reduced(rows, components)
    rows = materialise(density.density_clusters(rows, min_cluster_size, min_samples), "clustered")
    if outliers:
        near = cluster.reassign_noise(rows).withColumnRenamed("cluster_id", "near")
        rows = rows.join(near, "row_idx", "left").withColumn("cluster_id", F.coalesce("near", "cluster_id")).drop("near")
    words = topics.topic_keywords(rows, "text") if vocabulary == "topics" else topics.keywords(rows, "text")
    names = topics.labels(words)
    rows = rows.join(F.broadcast(names), "cluster_id", "left")  # a row per cluster
    label = F.when(F.col("cluster_id") == vocab.NOISE, F.lit(vocab.NOISE_LABEL)).otherwise(F.coalesce("label", F.lit(vocab.NO_KEYWORDS)))
    rows = rows.withColumn("cluster_label", label).drop("label", "model_text")
    rows = rows.join(places, "row_idx", "left") if coordinates else rows
    return ClusteringResult(rows, words, metrics.cluster_quality(rows), metrics.cluster_summary(rows, "text"), removed)


def with_output(cases: DataFrame, results: DataFrame, key: str = "dialog_id", mode: str = "", scenario: str = "") -> DataFrame:
    """Cases with what a run found: the run's columns win, and a scenario of the run replaces the case's.

    ``results`` has ``key`` and the run's columns; a ``new_dialog_id`` that isn't blank becomes the id.
    """
    found = results.withColumnRenamed(key, "of_case")
    own = [c for c in cases.columns if c not in results.columns or c == key]
    rows = cases.select(*own).join(found, F.col(key) == F.col("of_case")).drop("of_case")
    if "new_dialog_id" in results.columns:
        rows = rows.withColumn(key, F.coalesce(F.nullif(F.trim("new_dialog_id"), F.lit("")), key)).drop("new_dialog_id")
    rows = rows.withColumn("mode", F.lit(mode)) if mode else rows
    return rows.withColumn("scenario_id", F.lit(scenario.strip())) if scenario.strip() else rows


def existing_result(cases: DataFrame) -> DataFrame:
    """dialog_id, predicted (the last assistant's content), turns of dialogs that need no new reply."""
    last = scoring.last_turn(F.col("history"))
    return cases.select("dialog_id", F.coalesce(last["content"].cast("string"), F.lit("")).alias("predicted"), F.size("history").alias("turns"))


def failed_result(cases: DataFrame, error: str, fields: str = "result") -> DataFrame:
    """Rows of cases that raised: accuracy 0, no turns, no passed criterion, and the error's type and text."""
    kind, _, said = error.partition(": ")
    zero = F.create_map(*[x for f in scoring.scoring_fields(fields) for x in (F.lit(f), F.lit(0.0))])
    return cases.select("dialog_id", F.lit(0.0).alias("accuracy"), F.lit(0).alias("turns"), zero.alias("criterion_accuracy"), F.lit(kind).alias("error_type"), F.lit(said).alias("error"))


PROMPT = "Цели: {goals}\n\nДиалог:\n{history}\n\nОтветьте JSON."


def evaluate_existing(cases: DataFrame, judge: Judge, fields: str = "result,reason", prompt: str = PROMPT) -> DataFrame:
    """Judge dialogs that exist already: criterion scores, accuracy and result per case (goals, history)."""
    values = F.create_map(F.lit("goals"), goals_text(F.col("goals")), F.lit("history"), transcript(F.col("history")))
    asked = ask(cases.withColumn("prompt", template(prompt, values)), "prompt", judge)
    scored = scoring.judge_result(asked, "answer", fields)
    return scoring.force_fail(scored, F.col("error").isNotNull(), fields)


def compare_judges(items: DataFrame, judges: dict[str, Judge], prompt: str, label: str = "human", primary: str = "kappa") -> tuple[DataFrame, DataFrame]:
    """(metrics per variant, the best variant) of judges against the human label (a word or number)."""
    from ..functions.values import binary_label

    asked = None
    for name, judge in judges.items():
        rows = ask(items.where(F.col(label).isNotNull()), prompt, judge).withColumn("variant", F.lit(name))
        asked = rows if asked is None else asked.unionByName(rows)
    pairs = scoring.judge_result(asked, "answer", "result").select("variant", binary_label(F.col(label)).cast("int").alias("human"), F.col("result").cast("int").alias("llm"))
    table = agreement.confusion(pairs, "human", "llm", ["variant"])
    scores = agreement.binary_scores(agreement.binary_counts(table, 1, ["variant"]))
    found = agreement.two_rater_metrics(table, ["variant"]).join(scores, "variant")
    return found, agreement.best_variant(found, primary)
