"""Class-level TF-IDF keywords and labels of clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import keep_terms, meaningful_term
from ..shared import materialise, spread
from .metrics import doc_stats


def tokens(records: DataFrame, text: str, cluster: str = "cluster_id", stop_words: bool = True, max_df: float = 0.95) -> DataFrame:
    """cluster_id, term, n of lower-case tokens; terms in more than ``max_df`` of the texts go."""
    return limited(term_counts(records, text, cluster), stop_words, max_df)


def term_counts(records: DataFrame, text: str, cluster: str = "cluster_id") -> DataFrame:
    """cluster_id, term, n, df, n_docs of all tokens in one pass over the texts."""
    docs = records.where((F.col(cluster) >= 0) & (F.trim(F.coalesce(F.col(text), F.lit(""))) != ""))
    words = F.array_sort(F.split(F.lower(F.col(text)), vocab.BETWEEN_TOKENS))
    # in the order of the words a text's first one of each term is known by its neighbour, so one
    # aggregation with map-side combination gives both numbers and no row travels by document
    rows = spread(docs.select(cluster, text)).select(F.col(cluster).alias("cluster_id"), words.alias("term"))
    rows = rows.select("cluster_id", F.explode(F.arrays_zip("term", F.concat(F.array(F.lit("")), "term").alias("before"))).alias("w")).select("cluster_id", "w.*")
    rows = rows.where(F.col("term").rlike(vocab.TOKEN))
    counts = rows.groupBy("cluster_id", "term").agg(F.count("*").alias("n"), F.count_if(F.col("term") != F.col("before")).alias("df"))
    return counts.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n_docs"))))


def limited(counts: DataFrame, stop_words: bool = True, max_df: float = 0.95) -> DataFrame:
    """Without stop words and terms in more than ``max_df`` of the texts."""
    if stop_words:
        counts = counts.where(~F.col("term").isin(sorted(set(vocab.STOP_WORDS + vocab.JUNK_TERMS))))
    if max_df < 1:
        common = counts.groupBy("term").agg(F.sum("df").alias("d"), F.max("n_docs").alias("t")).where(F.col("d") > max_df * F.col("t")).select("term")
        counts = counts.join(common, "term", "left_anti")
    return counts.select("cluster_id", "term", "n")


def class_tfidf(counts: DataFrame, bm25: bool = True) -> DataFrame:
    """cluster_id, term, score: sqrt(tf) ln(1 + (A - f + 0.5) / (f + 0.5)), or tf ln(A / f + 1).

    tf is the share of the class's tokens, f the term's count over classes, A the whole part of the
    mean number of tokens per class. Only positive scores stay.
    """
    classes = counts.groupBy("cluster_id").agg(F.sum("n").alias("size"))
    mean = classes.agg(F.floor(F.avg("size")).cast("double").alias("a"))
    terms = counts.groupBy("term").agg(F.sum("n").cast("double").alias("f"))
    rows = counts.join(terms, "term").join(F.broadcast(classes), "cluster_id").crossJoin(F.broadcast(mean))
    tf = F.col("n") / F.col("size")
    idf = F.log(1 + (F.col("a") - F.col("f") + 0.5) / (F.col("f") + 0.5)) if bm25 else F.log(F.col("a") / F.col("f") + 1)
    ok = ((F.col("a") - F.col("f") + 0.5) / (F.col("f") + 0.5) > -1) if bm25 else F.lit(True)
    score = F.when(ok, (F.sqrt(tf) if bm25 else tf) * idf)
    return rows.select("cluster_id", "term", score.alias("score")).where(F.col("score") > 0)


def keywords(records: DataFrame, text: str, top: int = 10, pool: int = 200, cluster: str = "cluster_id") -> DataFrame:
    """cluster_id, words array<struct<term, score>>: the best meaningful terms of each cluster.

    A vocabulary that stop words or very common terms leave empty is built again without that rule.
    The ``pool`` best meaningful terms are looked at, and more where they leave a cluster short of ``top``.
    """
    every = materialise(term_counts(records, text, cluster), "terms")  # a row per cluster and term
    for stop_words, max_df in ((True, 0.95), (True, 1.0), (False, 1.0)):
        counts = limited(every, stop_words, max_df)
        if not counts.isEmpty():
            break
    return best_words(counts, top, pool)


def best_words(counts: DataFrame, top: int = 10, pool: int = 200) -> DataFrame:
    """cluster_id, words of a vocabulary (cluster_id, term, n)."""
    scored = class_tfidf(counts)
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.col("good").desc(), F.col("score").desc(), "term"))
    ranked = scored.withColumn("good", meaningful_term(F.col("term"))).withColumn("k", rank)
    ranked = materialise(ranked, "ranked-terms")
    while True:
        best = ranked.where(F.col("k") <= pool).groupBy("cluster_id").agg(F.collect_list(F.struct("term", "score")).alias("w"), (F.bool_and("good") & (F.count("*") == pool)).alias("more"))
        words = best.select("cluster_id", keep_terms(F.col("w"), top).alias("words"), "more")
        if words.where(F.col("more") & (F.size("words") < top)).isEmpty():
            return words.drop("more")
        pool *= 8


@dataclass(frozen=True)
class Setting:
    """How a topic vocabulary is cut: kind of terms, whether stop words go, and bounds on the number of topics with a term."""

    terms: str
    stop_words: bool
    min_df: int
    max_df: float


def least_topics(n_docs: int) -> int:
    """Topics that a term must stand in at first: two, of few documents one."""
    return 1 if n_docs < 100 else 2


def ladder(n_docs: int, permissive: bool) -> list[Setting]:
    """Settings from the strictest on; texts that are alike or short start with those that cut no common terms."""
    steps = [Setting("tokens", True, least_topics(n_docs), 0.95), Setting("tokens", False, 1, 0.95), Setting("tokens", False, 1, 1.0), Setting("words", False, 1, 1.0), Setting("grams", False, 1, 1.0)]
    return sorted(steps, key=lambda s: s.max_df < 1) if permissive else steps


def terms_of(text: Column, kind: str) -> Column:
    """Lower-case terms of a text: tokens as for keywords, any words of two characters or more, or character n-grams."""
    if kind == "grams":
        return char_ngrams(text)
    return F.filter(F.split(F.lower(text), vocab.BETWEEN_TOKENS), lambda w: w.rlike(vocab.TOKEN) if kind == "tokens" else F.length(w) > 1)


def topic_vocabulary(records: DataFrame, text: str, cluster: str = "cluster_id") -> tuple[DataFrame, Setting]:
    """(cluster_id, term, n), and the first setting of the ladder that leaves a term.

    Each topic, noise too, counts as one document. A kind of terms is counted once, with map-side
    combination, and only if the ladder comes to it. Texts without any term raise.
    """
    rows = records.select(F.col(cluster).alias("cluster_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    told = doc_stats(rows).crossJoin(rows.agg(F.count_distinct("cluster_id").alias("topics"))).first()
    counted: dict[str, DataFrame] = {}
    for s in ladder(told.n, bool(told.repetitive or told.short or told.n_unique < 5)):
        if s.max_df * told.topics < s.min_df:
            continue
        if s.terms not in counted:
            words = spread(rows).select("cluster_id", F.explode(terms_of(F.col("text"), s.terms)).alias("term"))
            counted[s.terms] = materialise(words.groupBy("cluster_id", "term").agg(F.count("*").alias("n")), "topic-terms")
        counts = counted[s.terms]
        if s.stop_words:
            counts = counts.where(~F.col("term").isin(sorted(set(vocab.STOP_WORDS + vocab.JUNK_TERMS))))
        if s.min_df > 1 or s.max_df < 1:
            in_topics = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df").between(s.min_df, s.max_df * told.topics))
            counts = counts.join(in_topics.select("term"), "term")
        if not counts.isEmpty():
            return counts.select("cluster_id", "term", "n"), s
    raise ValueError(f"no vocabulary in {told.n} texts, {told.n_non_empty} with content, {told.n_unique} different")


def topic_keywords(records: DataFrame, text: str, top: int = 10, pool: int = 200, cluster: str = "cluster_id") -> DataFrame:
    """cluster_id, words of every topic but noise, whose terms count in the vocabulary and the weights."""
    counts, _ = topic_vocabulary(records, text, cluster)
    return best_words(counts, top, pool).where(F.col("cluster_id") != vocab.NOISE)


def labels(words: DataFrame, top: int = 4, sep: str = ".") -> DataFrame:
    """cluster_id, label of the first words; noise and clusters without words have fixed labels."""
    joined = F.array_join(F.slice(F.col("words.term"), 1, top), sep)
    label = F.when(F.col("cluster_id") == vocab.NOISE, F.lit(vocab.NOISE_LABEL)).otherwise(F.coalesce(F.nullif(joined, F.lit("")), F.lit(vocab.NO_KEYWORDS)))
    return words.select("cluster_id", label.alias("label"))


def topic_labels(words: DataFrame, top: int = 5) -> DataFrame:
    joined = F.array_join(F.slice(F.col("words.term"), 1, top), ", ")
    return words.select("cluster_id", F.coalesce(F.nullif(joined, F.lit("")), F.concat(F.lit("Тема "), F.col("cluster_id").cast("string"))).alias("label"))


def merge_words(primary: DataFrame, other: DataFrame) -> DataFrame:
    """The primary words, filled from the other where they are empty."""
    o = other.withColumnRenamed("words", "more")
    both = primary.join(o, "cluster_id", "full")
    return both.select("cluster_id", F.when(F.size("words") > 0, F.col("words")).otherwise(F.col("more")).alias("words"))


def char_ngrams(text, low: int = 3, high: int = 5):
    """Character n-grams within word bounds, for vocabularies that have no words."""
    padded = F.transform(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(n: int) -> Column:
        none = F.array().cast("array<string>")
        return F.flatten(F.transform(padded, lambda w: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))).otherwise(none)))

    return F.flatten(F.array(*map(grams, range(low, high + 1))))
