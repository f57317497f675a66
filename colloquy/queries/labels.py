"""Raters' labels, splits, agreement details, samples and embeddings by dialog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import agreement, bootstrap, cluster, labels, metrics, sampling, similarity, topics
from ..operators.labels import LabelSchema
from ..sources import exports, jsonl
from .base import draws_sql, query, rounded, table

BINARY = LabelSchema("binary", field="quality")
PAIR = LabelSchema("binary_multi", criteria=("clean", "good"))


def _items(spark, sf_dir) -> DataFrame:
    """Items with up to three raters: ann says words, bob says numbers or nonsense, and every seventh has only a legacy label."""
    lab, i = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), "quality", "toxic"), F.col("item_id")
    ann = F.when(F.col("quality") == 1, "Да").otherwise("нет")
    bob = F.when(i % 5 == 0, "maybe").otherwise((1 - F.col("toxic")).cast("string"))
    both = F.create_map(F.lit("ann"), ann, F.lit("bob"), bob, F.lit(" "), F.lit("1"))
    named = F.when(i % 7 == 0, F.create_map().cast("map<string,string>")).when(i % 3 == 0, F.map_filter(both, lambda k, v: k == "ann")).otherwise(both)
    return lab.select("*", named.alias("human_labels"), F.when(i % 7 == 0, F.col("quality").cast("string")).alias("gold_label"))


_ITEMS = """(SELECT doc_id AS item_id, quality, toxic, CASE WHEN doc_id % 7 <> 0 THEN quality END AS ann, CASE WHEN doc_id % 7 <> 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN 1 - toxic END AS bob, doc_id % 7 <> 0 AND doc_id % 3 <> 0 AS bob_spoke, CASE WHEN doc_id % 7 = 0 THEN quality END AS old FROM labels)"""


@query(f"SELECT item_id, CASE WHEN old IS NOT NULL THEN '(без имени)' WHEN bob_spoke THEN 'ann,bob' ELSE 'ann' END AS raters, coalesce(ann, old)::VARCHAR AS first, ann::VARCHAR AS ann, coalesce(bob IS NOT NULL AND ann = bob, false) AS agreed, ann IS NOT NULL OR bob IS NOT NULL OR old IS NOT NULL AS annotated, bob IS NOT NULL AS by_bob FROM {_ITEMS}")
def item_labels(spark, sf_dir):
    """Labels merged with the legacy field, one rater's label, the first valid one, and who has annotated."""
    rows = jsonl.merged_labels(_items(spark, sf_dir), vocab.LEGACY_LABELS)
    raters = F.array_join(F.array_sort(F.map_keys("human_labels")), ",")
    return rows.select("item_id", raters.alias("raters"), labels.first_valid(BINARY).alias("first"), labels.label_of("ann", BINARY).alias("ann"), labels.consensus(BINARY, ["ann", "bob"]).alias("agreed"), labels.annotated_by(" ", BINARY).alias("annotated"), labels.annotated_by("bob", BINARY).alias("by_bob"))


@query(f"SELECT 'ann' AS rater, count(ann) AS n, count(*) FILTER (WHERE bob IS NOT NULL AND ann = bob) AS agreed FROM {_ITEMS} UNION ALL SELECT 'bob', count(bob), count(*) FILTER (WHERE bob IS NOT NULL AND ann = bob) FROM {_ITEMS}")
def annotation_counts(spark, sf_dir):
    rows = _items(spark, sf_dir)
    agreed = F.count_if(labels.consensus(BINARY, ["ann", "bob"]))
    counts = rows.agg(*(F.count_if(labels.annotated_by(r, BINARY)).alias(r) for r in ("ann", "bob")), agreed.alias("agreed"))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rater"), F.col(r).alias("n")) for r in ("ann", "bob")))).alias("r"), "agreed").select("r.rater", "r.n", "agreed")


@query(f"SELECT 'ann' AS rater UNION ALL SELECT 'bob' UNION ALL SELECT '(без имени)' FROM (SELECT DISTINCT 1 FROM {_ITEMS} WHERE old IS NOT NULL)")
def annotator_names(spark, sf_dir):
    return jsonl.annotators(jsonl.merged_labels(_items(spark, sf_dir), vocab.LEGACY_LABELS))




def _several(spark, sf_dir) -> DataFrame:
    """Labels of two criteria as JSON objects; every fourth item has none and every ninth lacks a criterion."""
    i = F.col("item_id")
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), "quality", "toxic")
    full = F.concat(F.lit('{"good": '), F.col("quality").cast("string"), F.lit(', "clean": "'), F.when(F.col("toxic") == 0, "yes").otherwise("no"), F.lit('"}'))
    return lab.withColumn("label", F.when(i % 4 == 0, F.lit(None)).when(i % 9 == 0, '{"good": 1}').otherwise(full))


_SEVERAL = "(SELECT doc_id AS item_id, quality AS good, 1 - toxic AS clean, doc_id % 4 <> 0 AND doc_id % 9 <> 0 AS ok FROM labels)"


@query(f"SELECT criterion, value::VARCHAR AS value, count(*) AS n FROM (SELECT 'good' AS criterion, good AS value FROM {_SEVERAL} WHERE ok UNION ALL SELECT 'clean', clean FROM {_SEVERAL} WHERE ok) GROUP BY 1, 2")
def label_statistics(spark, sf_dir):
    return labels.label_counts(_several(spark, sf_dir), PAIR, "label")


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS annotated, count(*) FILTER (WHERE NOT ok) AS unannotated FROM {_SEVERAL}")
def annotation_totals(spark, sf_dir):
    return labels.annotation_totals(_several(spark, sf_dir), PAIR, "label")


@query("SELECT 'binary_multi' AS mode, 'clean,good' AS criteria FROM (SELECT count(*) FROM labels)")
def inferred_schema(spark, sf_dir):
    rows = _several(spark, sf_dir).select("item_id", F.create_map(F.lit("ann"), F.col("label"), F.lit("bob"), F.lit("1")).alias("human_labels"))
    found = labels.infer_schema(rows)
    return spark.createDataFrame([(found.mode, ",".join(found.criteria))], "mode string, criteria string")


@query(f"SELECT item_id, CASE WHEN ok THEN 'clean=' || clean || ', good=' || good END AS stratum FROM {_SEVERAL}")
def label_strata(spark, sf_dir):
    return _several(spark, sf_dir).select("item_id", labels.stratum(F.col("label"), PAIR).alias("stratum"))


@query("SELECT o_orderkey, CASE WHEN substr(o_orderpriority, 1, 1)::INT <= 4 THEN substr(o_orderpriority, 1, 1) END AS ordinal, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END AS category FROM orders")
def label_modes(spark, sf_dir):
    p = F.col("o_orderpriority")
    score = F.concat(F.substring(p, 1, 1), F.lit(".7"))
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.valid(score, LabelSchema("ordinal", high=4)).alias("ordinal"), labels.valid(F.lower(p), LabelSchema("categorical", categories=("1-URGENT", "2-HIGH"))).alias("category"))


@query("SELECT doc_id AS item_id, CASE WHEN doc_id % 2 = 0 THEN 'ann=no,bob=1' ELSE 'ann=yes' END AS labels, CASE WHEN doc_id % 2 = 0 THEN 'ann=changed,bob=' ELSE '' END AS notes FROM labels")
def changed_labels(spark, sf_dir):
    """Labels and notes set for raters; a blank name does nothing and legacy fields go."""
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.create_map(F.lit("ann"), F.lit("yes")).alias("human_labels"), F.lit(None).cast("map<string,string>").alias("human_notes"), F.lit("x").alias("gold_label"))
    i = F.col("item_id")
    update = lambda *v: F.struct(*(F.lit(x).cast("string").alias(c) for c, x in zip(("rater", "label", "note"), v)))
    told = F.array(update("ann ", "no", "changed"), update("bob", "1", None), update(" ", "0", "lost"))
    updates = lab.where(i % 2 == 0).select("item_id", F.explode(told).alias("u")).select("item_id", "u.*")
    out = labels.set_labels(lab, updates)
    assert "gold_label" not in out.columns
    shown = lambda c: F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","), F.lit(""))
    return out.select("item_id", shown("human_labels").alias("labels"), shown("human_notes").alias("notes"))


def _split(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id") % 4
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), "quality", "toxic", F.when(i == 0, "test").when(i == 1, "train").when(i == 2, "other").alias("split"))


@query("SELECT CASE doc_id % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'unset' END AS split, count(*) AS n, true AS has_split, count(*) FILTER (WHERE doc_id % 4 = 0) AS test_items FROM labels GROUP BY 1")
def pool_splits(spark, sf_dir):
    rows = _split(spark, sf_dir)
    assert labels.clear_splits(rows).columns == ["item_id", "quality", "toxic"]
    test = labels.of_split(rows, "test").select(F.lit("test").alias("s")).groupBy("s").agg(F.count("*").alias("t"))
    counts = labels.split_counts(rows).join(test, F.col("split") == F.col("s"), "left")
    return counts.crossJoin(F.broadcast(labels.has_split(rows))).select("split", "n", "has_split", F.coalesce("t", F.lit(0).cast("long")).alias("test_items"))


@query("SELECT criterion, value::VARCHAR AS value, split, count(*) AS n FROM (SELECT 'quality' AS criterion, quality AS value, CASE doc_id % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'train' WHEN 2 THEN 'other' END AS split FROM labels UNION ALL SELECT 'toxic', toxic, CASE doc_id % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'train' WHEN 2 THEN 'other' END FROM labels) GROUP BY 1, 2, 3")
def split_marginals(spark, sf_dir):
    return sampling.split_marginals(_split(spark, sf_dir), ["quality", "toxic"])


@query("SELECT doc_id AS item_id, quality::VARCHAR AS y1, (1 - toxic)::VARCHAR AS y2 FROM labels WHERE doc_id % 6 NOT IN (0, 1)")
def paired_judge_labels(spark, sf_dir):
    i = F.col("item_id") % 6
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), "quality", "toxic")
    rows = rows.select("item_id", F.when(i != 0, F.col("quality").cast("string")).alias("human_label"), F.when(i == 1, "unsure").otherwise(F.when(F.col("toxic") == 0, "TRUE").otherwise("ошибка")).alias("llm_label"))
    return labels.paired_labels(rows, BINARY)


@query("""SELECT doc_id AS item_id, CASE WHEN doc_id % 5 = 1 THEN repeat('g', 157) || '…' WHEN doc_id % 5 = 2 THEN '—' ELSE 'short' END AS goals, CASE WHEN doc_id % 3 = 0 THEN 'timeout' ELSE 'Не удалось получить метку от LLM' END AS error FROM labels WHERE doc_id % 3 IN (0, 1) AND doc_id % 4 <> 0""")
def judge_run_errors(spark, sf_dir):
    i = F.col("item_id")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), "quality")
    rows = rows.select("item_id", F.when(i % 4 != 0, F.col("quality").cast("string")).alias("human_label"), F.create_map().cast("map<string,string>").alias("human_labels"), F.when(i % 3 == 2, "да").when(i % 3 == 1, "?").alias("llm_label"), F.when(i % 3 == 0, " timeout ").otherwise(" ").alias("llm_error"), F.when(i % 5 == 1, F.repeat(F.lit("g"), F.lit(200))).when(i % 5 == 2, " ").otherwise(" short ").alias("goals"))
    return labels.run_errors(rows, BINARY)


@query("SELECT doc_id AS item_id, CASE WHEN doc_id % 2 = 0 THEN quality::VARCHAR END AS human_label, CASE WHEN doc_id % 2 = 0 THEN 'noted' ELSE '' END AS human_note, NULL::VARCHAR AS llm_reason FROM labels")
def calibration_export(spark, sf_dir):
    i, q = F.col("item_id"), F.col("quality").cast("string")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), "quality")
    rows = rows.select("item_id", F.when(i % 2 == 0, F.create_map(F.lit("ann"), q)).otherwise(F.create_map(F.lit("ann"), q, F.lit("bob"), q)).alias("human_labels"), F.create_map(F.lit("ann"), F.lit("noted")).alias("human_notes"))
    out = exports.calibration_rows(labels.calibration_items(rows).withColumnRenamed("item_id", "idx"))
    return out.select(F.col("idx").alias("item_id"), "human_label", "human_note", "llm_reason")


# --- agreement details


def _ratings(spark, sf_dir) -> DataFrame:
    from .dialogs import _ratings

    return _ratings(spark, sf_dir)


@query("""WITH r AS (SELECT doc_id AS item_id, 'a' AS rater, quality AS label FROM labels UNION ALL SELECT doc_id, 'b', 1 - toxic FROM labels WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 'c', CASE WHEN doc_id % 3 = 0 THEN toxic ELSE quality END FROM labels WHERE doc_id % 4 <> 0)
    SELECT item_id, string_agg(rater || label, ',' ORDER BY rater) AS labels FROM r GROUP BY item_id HAVING count(DISTINCT label) > 1""")
def rater_disagreements(spark, sf_dir):
    d = agreement.disagreements(_ratings(spark, sf_dir))
    return d.select("item_id", F.array_join(F.transform("labels", lambda x: F.concat(x["rater"], x["label"].cast("string"))), ",").alias("labels"))


_KAPPA = "CASE WHEN n < 2 THEN NULL WHEN pe >= 1 THEN CASE WHEN po >= 1 THEN 1.0 ELSE 0.0 END ELSE (po - pe) / (1 - pe) END"


@query(f"""WITH p AS (SELECT 'quality' AS criterion, quality AS y1, 1 - toxic AS y2 FROM labels UNION ALL SELECT 'odd', quality, (doc_id % 2)::INT FROM labels),
    a AS (SELECT criterion, count(*)::DOUBLE AS n, avg((y1 = y2)::INT) AS po, (sum(y1) * sum(y2) + sum(1 - y1) * sum(1 - y2))::DOUBLE / (count(*) * count(*)) AS pe FROM p GROUP BY criterion), k AS (SELECT criterion, po AS exact, 2 * po - 1 AS pabak, {_KAPPA} AS kappa FROM a)
    SELECT count(*) AS n_criteria, round(avg(exact), 9) AS exact, round(avg(pabak), 9) AS pabak, round(avg(kappa), 9) AS kappa, round(min(kappa), 9) AS min_kappa, round(min(pabak), 9) AS min_pabak FROM k""")
def criteria_agreement(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    pair = F.array(F.struct(F.lit("quality").alias("criterion"), F.col("quality").alias("y1"), (1 - F.col("toxic")).alias("y2")), F.struct(F.lit("odd").alias("criterion"), F.col("quality").alias("y1"), (F.col("doc_id") % 2).cast("int").alias("y2")))
    rows = lab.select(F.explode(pair).alias("p")).select("p.*")
    found = agreement.criteria_summary(agreement.two_rater_metrics(agreement.confusion(rows, "y1", "y2", ["criterion"]), ["criterion"]))
    return rounded(found, "exact", "pabak", "kappa", "min_kappa", "min_pabak")


@query("""WITH v AS (SELECT doc_id % 4 AS variant, quality AS y1, (1 - toxic) AS y2 FROM labels), a AS (SELECT variant, avg((y1 = y2)::INT) AS po FROM v GROUP BY variant) SELECT variant, CASE WHEN 2 * po - 1 >= 0.8 THEN 'high' WHEN 2 * po - 1 >= 0.6 THEN 'acceptable' ELSE 'low' END AS quality, variant = (SELECT arg_max(variant, (po, -variant)) FROM a) AS best FROM a""")
def judge_variants(spark, sf_dir):
    """Variants of a judge ranked by one metric, with a word for how well each agrees."""
    v = table(spark, sf_dir, "labels").select((F.col("doc_id") % 4).alias("variant"), F.col("quality").alias("y1"), (1 - F.col("toxic")).alias("y2"))
    m = agreement.two_rater_metrics(agreement.confusion(v, "y1", "y2", ["variant"]), ["variant"]).withColumn("f1", -F.col("variant").cast("double"))
    best = agreement.best_variant(m, "exact").withColumnRenamed("variant", "top")
    return m.crossJoin(F.broadcast(best)).select("variant", agreement.quality_label(F.col("pabak")).alias("quality"), (F.col("variant") == F.col("top")).alias("best"))


@query("""WITH o AS (SELECT unnest(['yes', '10', '0', 'no', 'b', '2', 'да', 'A']) AS label) SELECT string_agg(label, ',' ORDER BY CASE label WHEN '0' THEN 1 WHEN 'no' THEN 4 WHEN 'да' THEN 7 WHEN 'yes' THEN 8 WHEN '2' THEN 12 WHEN '10' THEN 20 WHEN 'A' THEN 30 ELSE 31 END) AS labels FROM o""")
def ordered_labels(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in ("yes", "10", "0", "no", "b", "2", "да", "A")], "label string")
    return rows.agg(F.array_sort(F.collect_list(F.struct(agreement.label_order(F.col("label")).alias("o"), "label"))).alias("l")).select(F.array_join("l.label", ",").alias("labels"))


def _interval(value: str, levels: int, replicates: int, group: str = "", where: str = "true") -> str:
    return draws_sql(f"SELECT ({value})::DOUBLE AS value FROM labels WHERE {where}", levels, replicates, group=group) + """, r AS (SELECT b, sum(value * k) / sum(k) AS mean FROM d JOIN lv USING (place) GROUP BY b)
    SELECT (SELECT sum(m)::BIGINT FROM lv) AS n, round((SELECT sum(value * m) / sum(m) FROM lv), 9) AS mean, round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high FROM r"""


@query(_interval("(quality + (1 - toxic)) / 2.0::DOUBLE", 3, 5000))
def bootstrap_ci_mean_score(spark, sf_dir):
    """The interval of the mean criterion score of a dialog."""
    from ..operators import scoring

    m = F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("clean"), (1 - F.col("toxic")).cast("double"))
    rows = table(spark, sf_dir, "labels").select(scoring.row_mean(m).alias("a"))
    return rounded(bootstrap.bootstrap_mean(rows, "a"), "mean", "low", "high")


@query(" UNION ALL ".join(f"SELECT '{name}' AS criterion, * FROM ({_interval(value, 2, 1000, name, where)})" for name, value, where in (("quality", "quality", "true"), ("clean", "1 - toxic", "doc_id % 3 <> 0"))))
def bootstrap_ci_criteria(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    long = F.array(F.struct(F.lit("quality").alias("criterion"), F.col("quality").cast("double").alias("a")), F.struct(F.lit("clean").alias("criterion"), F.when(F.col("doc_id") % 3 != 0, (1 - F.col("toxic")).cast("double")).alias("a")))
    rows = lab.select(F.explode(long).alias("x")).select("x.*")
    return rounded(bootstrap.bootstrap_by(rows, "criterion", "a", ["quality", "clean"], replicates=1000), "mean", "low", "high")


# --- samples and clusters


@query("""WITH e AS (SELECT vec_id, label, 't' || (vec_id % 9) AS t FROM embeddings), d AS (SELECT label, t, count(*) AS n, min(vec_id) AS o FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY o, t) AS k FROM d)
    SELECT label AS cluster_id, sum(n)::BIGINT AS n, count(*) AS distinct_texts, string_agg(t, ',' ORDER BY k) FILTER (WHERE k <= 3) AS examples FROM r GROUP BY label""")
def cluster_overview(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_idx"), F.col("label").alias("cluster_id"), F.concat(F.lit("t"), (F.col("vec_id") % 9).cast("string")).alias("t"))
    return metrics.cluster_summary(e, "t").withColumn("examples", F.array_join("examples", ","))


@query("""WITH w AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings WHERE label <> 3)
    SELECT l.label AS cluster_id, CASE WHEN l.label = 3 THEN 'ключевые слова не выявлены' ELSE (SELECT string_agg('w' || vec_id, '.' ORDER BY k) FROM w WHERE w.label = l.label AND k <= 4) END AS label, CASE WHEN l.label = 3 THEN 'Тема 3' ELSE (SELECT string_agg('w' || vec_id, ', ' ORDER BY k) FROM w WHERE w.label = l.label AND k <= 5) END AS topic FROM (SELECT DISTINCT label FROM embeddings) l""")
def cluster_labels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    words = F.transform(F.array_sort(F.collect_list(F.when(F.col("label") != 3, F.col("vec_id")))), lambda x: F.struct(F.concat(F.lit("w"), x.cast("string")).alias("term"), F.lit(1.0).alias("score")))
    w = e.groupBy(F.col("label").alias("cluster_id")).agg(words.alias("words"))
    return topics.labels(w).join(topics.topic_labels(w).withColumnRenamed("label", "topic"), "cluster_id")


@query("""SELECT CASE WHEN label < 5 THEN label ELSE label + 100 END AS cluster_id, CASE WHEN label < 5 AND label % 2 = 0 THEN 'first' ELSE 'second' END AS word FROM (SELECT DISTINCT label FROM embeddings UNION SELECT DISTINCT label + 5 FROM embeddings) WHERE label < 5 OR label >= 10""")
def merged_keywords(spark, sf_dir):
    """Primary words, filled from others where they are empty or absent."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("c")).distinct()
    all_ = e.union(e.select(F.col("c") + 5)).distinct().where("c < 5 or c >= 10").select(F.when(F.col("c") < 5, F.col("c")).otherwise(F.col("c") + 100).alias("cluster_id"))
    word = lambda w: F.array(F.struct(F.lit(w).alias("term"), F.lit(1.0).alias("score")))
    primary = all_.where("cluster_id < 5").withColumn("words", F.when(F.col("cluster_id") % 2 == 0, word("first")).otherwise(F.slice(word("none"), 1, 0)))
    return topics.merge_words(primary, all_.withColumn("words", word("second"))).select("cluster_id", F.element_at("words", 1)["term"].alias("word"))


@query("""SELECT b.vec_id, CASE WHEN b.vec_id % 7 = 0 THEN NULL ELSE (SELECT max(a.vec_id) FROM embeddings a WHERE a.vec_id % 50 = b.vec_id % 50) END AS source FROM embeddings b""")
def embeddings_by_dialog(spark, sf_dir):
    """Embeddings looked up by dialog: the last of a repeated id, null for unknown ids."""
    e = table(spark, sf_dir, "embeddings")
    source = e.select(F.col("vec_id").alias("row_idx"), F.concat(F.lit("d"), (F.col("vec_id") % 50).cast("string")).alias("dialog_id"))
    vectors = e.select(F.col("vec_id").alias("row_idx"), F.array(F.col("vec_id").cast("double")).alias("embedding"))
    asked = e.select("vec_id", F.when(F.col("vec_id") % 7 == 0, "unknown").otherwise(F.concat(F.lit("d"), (F.col("vec_id") % 50).cast("string"))).alias("dialog_id"))
    assert similarity.by_dialog_id(source, vectors.where("row_idx > 0")).isEmpty()
    return similarity.for_records(asked, source, vectors).select("vec_id", F.element_at("embedding", 1).cast("long").alias("source"))


@query("SELECT c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS similarity FROM embeddings q JOIN embeddings c ON q.vec_id = 7 AND c.vec_id <> 7 WHERE list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) >= 0.1 ORDER BY 2 DESC, 1 LIMIT 12")
def similar_to_row(spark, sf_dir):
    return rounded(similarity.search(table(spark, sf_dir, "embeddings"), 7, 12, 0.1, key="vec_id"), "similarity")


@query("SELECT 500 AS n, min(greatest(2, least(10, greatest(2, 500 // 5), 499))) AS auto, 3 AS asked, 50 AS components, 7 AS few, 'spectral' AS start, 'random' AS small FROM (SELECT 1)")
def layout_rules(spark, sf_dir):
    row = (500, cluster.layout_neighbours(0, 500), cluster.layout_neighbours(3, 500), cluster.layout_components(0, 64, 500), cluster.layout_components(0, 64, 8), cluster.layout_start("auto", 500), cluster.layout_start("auto", 49))
    return spark.createDataFrame([row], "n int, auto int, asked int, components int, few int, start string, small string")


@query("SELECT vec_id AS row_idx FROM (SELECT vec_id, label FROM embeddings WHERE label = 2 ORDER BY vec_id LIMIT 5 OFFSET 3)")
def cluster_page(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("label = 2").select(F.col("vec_id").alias("row_idx"))
    return sampling.page(e, "row_idx", 5, 3)


@query("SELECT doc_id, quality FROM labels WHERE quality = 0")
def failed_rows(spark, sf_dir):
    """What failure grouping starts from: rows of accuracy 0."""
    from ..operators import compare

    return table(spark, sf_dir, "labels").where(~compare.passed(F.col("quality"))).select("doc_id", "quality")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE t <> '') AS n_non_empty, count(DISTINCT t) FILTER (WHERE t <> '') AS n_unique, round(avg(length(t)) FILTER (WHERE t <> ''), 6) AS mean_len, count(DISTINCT t) FILTER (WHERE t <> '') < greatest(3, count(*) FILTER (WHERE t <> '') // 8) AS repetitive, avg(length(t)) FILTER (WHERE t <> '') < 35 AS short FROM (SELECT trim(event_type) AS t FROM events)")
def document_statistics(spark, sf_dir):
    return metrics.doc_stats(table(spark, sf_dir, "events"), "event_type").withColumn("mean_len", F.round("mean_len", 6))
