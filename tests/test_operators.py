"""Operators against brute force and by their properties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy import shared
from colloquy.functions import text, values
from colloquy.operators import agreement, bootstrap, cluster, compare, dedup, metrics, sampling, scoring, similarity, timing, topics
from colloquy.plans import pipelines, providers
from colloquy.sources import traces
from colloquy.sources.catalog import Catalog
from colloquy.streaming import jobs


def test_distribution_bounds(spark):
    for counts in ([5], [3, 3, 3], [1, 9, 0], [7, 1, 1, 2]):
        df = spark.createDataFrame([(str(i), n) for i, n in enumerate(counts)], "category string, n long")
        pos = sorted(n for n in counts if n)
        k, t = len(pos), sum(pos)
        h = -sum(n / t * math.log(n / t) for n in pos) / math.log(k) if k > 1 else 0
        g = sum((2 * i - k - 1) * v for i, v in enumerate(pos, 1)) / (k * t)
        assert metrics.normalized_entropy(df).first().entropy == pytest.approx(h)
        assert metrics.gini(df).first().gini == pytest.approx(g)
        assert metrics.max_min_ratio(df).first().max_min == (pos[-1] / pos[0] if k > 1 else None)


def brute_kappa(a, b):
    n = len(a)
    po = sum(x == y for x, y in zip(a, b)) / n
    pe = sum(a.count(v) * b.count(v) for v in set(a) | set(b)) / n / n
    return None if n < 2 else (1.0 if po >= 1 else 0.0) if pe >= 1 else (po - pe) / (1 - pe)


@pytest.mark.parametrize("labels", [[1, 0], [1, 2, 3]])
def test_two_raters(spark, labels):
    rnd = random.Random(3)
    a = [rnd.choice(labels) for _ in range(60)]
    b = [x if rnd.random() < 0.7 else rnd.choice(labels) for x in a]
    for y in (b, a, [labels[0]] * 60):
        df = spark.createDataFrame(list(zip(a, y)), "a int, b int")
        r = agreement.two_rater_metrics(agreement.confusion(df, "a", "b")).first()
        assert r.kappa == pytest.approx(brute_kappa(a, y)) and r.pabak == pytest.approx(2 * r.exact - 1)
    same = agreement.two_rater_metrics(agreement.confusion(spark.createDataFrame([(1, 1), (1, 1)], "a int, b int"), "a", "b")).first()
    assert same.kappa == 1.0


def brute_alpha(units, ordinal):
    o, values_ = {}, sorted({v for u in units for v in u})
    for u in (u for u in units if len(u) > 1):
        for i, c in enumerate(u):
            for j, d in enumerate(u):
                if i != j:
                    o[c, d] = o.get((c, d), 0) + 1 / (len(u) - 1)
    n = {c: sum(v for (x, _), v in o.items() if x == c) for c in values_}

    def gap(c, d):
        if not ordinal:
            return float(c != d)
        lo, hi = sorted((c, d))
        return (sum(n[g] for g in values_ if lo <= g <= hi) - (n[c] + n[d]) / 2) ** 2

    de = sum(n[c] * n[d] * gap(c, d) for c in values_ for d in values_)
    return 1 - (sum(n.values()) - 1) * sum(v * gap(*k) for k, v in o.items()) / de


@pytest.mark.parametrize("mode", ["nominal", "ordinal"])
def test_krippendorff(spark, mode):
    rnd = random.Random(5)
    units = [[rnd.choice([1, 2, 2, 3, 5]) for _ in range(rnd.randint(1, 3))] for _ in range(40)]
    rows = [(i, f"r{k}", v) for i, u in enumerate(units) for k, v in enumerate(u)]
    df = spark.createDataFrame(rows, "item_id int, rater string, label int")
    assert agreement.krippendorff(df, mode).first().alpha == pytest.approx(brute_alpha(units, mode == "ordinal"))


def test_mcnemar(spark):
    for a, b in ((0, 0), (5, 0), (7, 7), (30, 12), (400, 300)):
        n, k = a + b, min(a, b)
        want = None if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
        got = spark.createDataFrame([(a, b)], "a long, b long").select(compare.mcnemar(F.col("a"), F.col("b")).alias("p")).first().p
        assert got == (None if want is None else pytest.approx(want))


def test_bootstrap(spark):
    rnd = random.Random(6)
    x = [rnd.choice([0.0, 0.5, 1.0]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in x], "a double")
    r = bootstrap.bootstrap_mean(df, "a", replicates=400).first()
    se = np.std(x) / math.sqrt(300)
    assert r.n == 300 and r.low < r.mean < r.high and abs((r.high - r.low) / (2 * 1.96 * se) - 1) < 0.2
    assert bootstrap.bootstrap_mean(df.where("a > 5"), "a", replicates=100).first().low is None


def test_split(spark):
    df = spark.createDataFrame([(i, "a" if i < 50 else "b" if i < 53 else None) for i in range(54)], "item_id long, s string")
    got = sampling.stratified_split(df, "s").groupBy("stratum").agg(F.count_if(F.col("split") == "test").alias("t")).collect()
    assert {r.stratum: r.t for r in got} == {"a": 10, "b": 1, "__unlabeled__": 0}


def test_exact_and_greedy_dedup(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    x = np.concatenate([base + rng.normal(scale=s, size=base.shape) for s in (0, 0.1, 0.25, 0.3)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_idx long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    kept = []
    for i in range(len(u)):
        if not any(u[i] @ u[j] >= 0.93 for j in kept):
            kept.append(i)
    exact = dedup.exact_pairs(df, 0.93)
    assert {(r.i, r.j) for r in dedup.semantic_pairs(df, 0.93).collect()} == {(r.i, r.j) for r in exact.collect()}
    gone = dedup.greedy_keep(df, exact).collect()
    assert sorted(set(range(len(u))) - {r.row_idx for r in gone}) == kept
    t = spark.createDataFrame([(0, "a"), (1, " a "), (2, ""), (3, None), (4, "b")], "row_idx long, t string")
    assert [r.row_idx for r in dedup.exact(t, "t").where("dup").collect()] == [1]


def test_top_k(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(40, [0.0] * 8), (41, None)], "row_idx long, embedding array<double>")
    sims = x @ x[3] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[3])
    want = [int(i) for i in np.argsort(-sims, kind="stable") if i != 3 and sims[i] >= 0][:5]
    assert [r.row_idx for r in similarity.top_k(df, x[3].tolist(), 5, exclude=3).collect()] == want
    assert similarity.top_k(df, [0.0] * 8).count() == 0


def brute_mmr(x, limit, share):
    """Row numbers of one cluster in order of choice."""
    if len(x) <= limit:
        return list(range(len(x)))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(norm > 0, norm, 1)
    centre = u.mean(axis=0) / np.linalg.norm(u.mean(axis=0))
    picked = [max(range(len(x)), key=lambda i: u[i] @ centre)]
    while len(picked) < limit:
        free = [i for i in range(len(x)) if i not in picked]
        picked.append(max(free, key=lambda i: share * (u[i] @ centre) - (1 - share) * max(u[i] @ u[j] for j in picked)))
    return picked


@pytest.mark.parametrize("limit, share", [(1, 0.6), (3, 0.6), (6, 0.2)])
def test_mmr_against_brute_force(spark, limit, share):
    rng = np.random.default_rng(8)
    groups = {0: rng.normal(size=(30, 6)), 1: rng.normal(size=(3, 6)) + 1, 2: rng.normal(size=(12, 6)) + 2}
    groups[2][4] = 0.0
    rows = [(100 * c + i, c, v.tolist()) for c, x in groups.items() for i, v in enumerate(x)] + [(500, 0, None), (501, None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "row_idx long, cluster_id int, embedding array<double>")
    want = {(c, k, 100 * c + i) for c, x in groups.items() for k, i in enumerate(brute_mmr(x, limit, share))}
    assert {(r.cluster_id, r.pick, r.row_idx) for r in sampling.mmr_select(df, limit, share).collect()} == want
    assert sampling.mmr_select(df.limit(0), limit).count() == 0


def test_term_filter(spark):
    pairs = [("график работы", 9.0), ("график", 5.0), ("граф", 4.0), ("and", 3.0), ("12", 2.0), ("x", 2.0), ("офис", 1.0)]
    df = spark.createDataFrame([(pairs,)], "w array<struct<term:string,score:double>>")
    assert [r.term for r in df.select(text.keep_terms(F.col("w")).alias("k")).first().k] == ["график", "офис"]
    words = spark.createDataFrame([(0, pairs[1:2]), (-1, pairs[1:2]), (1, [])], "cluster_id int, words array<struct<term:string,score:double>>")
    assert {r.cluster_id: r.label for r in topics.labels(words).collect()} == {0: "график", -1: "шум", 1: "ключевые слова не выявлены"}


def test_timing(spark):
    rows = [("d", 0, "user", 0.0, None), ("d", 1, "assistant", 2.5, None), ("d", 2, "user", 1.0, None), ("d", 3, "bot", None, 4.0)]
    df = spark.createDataFrame(rows, "dialog_id string, turn_idx int, role string, ts double, duration double").withColumn("wall", F.lit(10.0))
    lag = timing.infer_durations(df)
    assert [r.duration for r in lag.orderBy("turn_idx").collect()] == [None, 2.5, None, 4.0]
    full = timing.enrich(df)
    assert [r.duration for r in full.orderBy("turn_idx").collect()] == [1.75, 2.5, 1.75, 4.0]
    assert [r.duration for r in timing.enrich(full).orderBy("turn_idx").collect()] == [1.75, 2.5, 1.75, 4.0]
    assert timing.dialog_times(lag).first().avg_assistant == 3.25
    got = spark.createDataFrame([("1,5",), ("true",), ("-1",), ("nan",)], "s string").select(values.metric(F.col("s")).alias("m")).collect()
    assert [r.m for r in got] == [1.5, None, -1.0, None]


def test_paired_runs(spark):
    schema = "dialog_id string, row_idx long, accuracy double, category string"
    a = spark.createDataFrame([("x", 0, 0.0, "c"), ("x", 1, 1.0, "c"), (" ", 2, 1.0, "c"), ("y", 3, None, None), ("only", 4, 1.0, "c")], schema)
    b = spark.createDataFrame([("x", 0, 0.5, None), ("y", 1, 1.0, "k"), ("z", 2, 1.0, "k")], schema)
    got = {r.dialog_id: (r.change, r.category) for r in compare.paired(a, b).collect()}
    assert got == {"x": ("regressed", "c"), "y": ("improved", "k"), "only": (None, "c"), "z": (None, "k")}


def test_redaction(spark):
    df = spark.createDataFrame([({"API-Key": "s", "name": "n"}, '{"a": {"secret_key": "x\\"y", "token": 12}, "b": "token"}')], "m map<string,string>, j string")
    r = df.select(values.redact(F.col("m")).alias("m"), values.redact_json(F.col("j")).alias("j")).first()
    assert r.m == {"API-Key": "[скрыто]", "name": "n"} and r.j == '{"a": {"secret_key": "[скрыто]", "token": "[скрыто]"}, "b": "token"}'


def test_traces(spark):
    out = '{"messages": [{"type": "human", "id": "m1", "content": "hi"}, {"type": "ai", "content": "", "tool_calls": [{"name": "find", "args": {"q": 1}}]}, {"type": "tool", "name": "find", "content": "[]"}, {"type": "ai", "content": "done"}]}'
    rows = [
        ("t1", "n", None, "u", ["a"], "2024-01-02T00:00:00Z", '{"goals": ["g"], "category": "c"}', None, out),
        ("t2", "n", "s", "u", None, "2024-01-03T00:00:00Z", None, '{"messages": [{"type": "human", "id": "m1", "content": "hi"}]}', None),
        ("t3", "n3", "s3", "u", ["b"], None, "not json", "plain question", "plain answer"),
    ]
    df = spark.createDataFrame(rows, traces.TRACES)
    got = {r.trace_id: r for r in traces.to_cases(df).collect()}
    assert [(t.role, t.content) for t in got["t1"].history] == [("user", "hi"), ("assistant", '→ find({"q":1})'), ("tool", "find: (нет данных)"), ("assistant", "done")]
    assert got["t1"].goals == ["g"] and '"category":"c"' in got["t1"].context and got["t1"].conv_key == "m1"
    assert [t.content for t in got["t3"].history] == ["plain question", "plain answer"] and got["t3"].dialog_id == "s3" and got["t3"].goals == ["n3"]
    out = traces.export(df).collect()
    assert [r.dialog_id for r in out] == ["t1", "t3"]  # the longer of the two traces of one conversation
    assert [r.dialog_id for r in traces.export(df, tool="FIND").collect()] == ["t1"]
    assert traces.api_filters(df, start="2024-01-02 12:00:00").count() == 1 and traces.api_filters(df, end="2024-01-02 12:00:00").count() == 2
    assert traces.post_filters(df, tags_all=["a"]).count() == 1 and traces.post_filters(df, metadata_contains={"category": "c"}).count() == 1


def test_trace_source_pages(spark):
    class Fake(traces.TraceSource):
        @staticmethod
        def fetch(options, page):
            return {"data": [{"id": f"{page}-{i}", "tags": ["x"], "metadata": {"p": page}} for i in range(2)], "meta": {"totalPages": 3}}

    spark.dataSource.register(Fake)
    got = spark.read.format("dialog_traces").load().collect()
    assert sorted(r.id for r in got) == ["1-0", "1-1", "2-0", "2-1", "3-0", "3-1"] and got[0].tags == ["x"]


def test_catalog_and_worker(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "catalog"))
    assert c.migrate() == [1, 2, 3, 4] and c.migrate() == []
    lines = spark.createDataFrame([('{"accuracy": 1.0}',), ('{"accuracy": 0.0}',)], "value string")
    inbox = str(tmp_path / "inbox")
    evaluate = lambda df: df.select(F.try_variant_get(F.try_parse_json("value"), "$.accuracy", "double").alias("accuracy"))
    good = jobs.new_run(c, inbox, lines, '{"scenario_id": "SC7"}', "first")
    bad = jobs.new_run(c, inbox, lines, title="second")
    c.table("runs")
    stopped = jobs.new_run(c, inbox, lines, title="third")
    assert c.cancel(stopped) and not c.cancel(stopped)
    assert c._move(bad, ("queued",), input_key="nowhere")
    jobs.worker(spark, c, inbox, str(tmp_path / "results"), str(tmp_path / "ck"), evaluate).awaitTermination()
    assert (c.run(good).status, c.run(good).avg_accuracy, c.run(good).progress_done) == ("completed", 0.5, 2)
    assert c.run(bad).status == "failed" and c.run(stopped).status == "cancelled"
    assert jobs.process_run(c, good, evaluate, str(tmp_path / "results")) == "completed"  # a second delivery changes nothing
    assert [r.id for r in c.recent_runs(search="sc7").collect()] == [good] and c.recent_runs(limit=2).count() == 2
    p = c.save_preset("b", "{}", is_default=True)
    q = c.save_preset("a", "{}", is_default=True)
    assert c.default_preset().id == q and [r.name for r in c.presets().collect()] == ["a", "b"] and c.delete("presets", p) and not c.delete("presets", p)
    with pytest.raises(ValueError):
        c.save_preset(" ", "{}")
    s = c.save_sample("set", lines)
    key = c.sample_by_name(" set ").data_key
    assert c.sample_by_name(" set ").id == s and c.sample_lines(s).count() == 2 and c.sample_lines("none") is None
    assert c.delete("samples", s) and c.get_lines(key) is None


def test_catalog_decides_again_when_another_writer_was_first(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    c = Catalog(spark, str(tmp_path / "catalog"))
    run = c.create_run()
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda k: Catalog(spark, c.root).claim(run, f"worker-{k}"), range(4)))
    assert won.count(True) == 1
    number, version = c._pointer("runs")
    assert not c._point("runs", number, "late") and c._pointer("runs") == (number, version)
    owner = c.run(run).claimed_by
    assert c.claim(run, owner) and not c.claim(run, "someone else")  # only a restart of the same batch takes it up again
    evaluate = lambda df: df.select(F.lit(1.0).alias("accuracy"))
    c.put_lines(c.run(run).input_key, spark.createDataFrame([("{}",)], "value string"))
    assert jobs.process_run(c, run, evaluate, str(tmp_path / "results"), "someone else") == "running"
    assert jobs.process_run(c, run, evaluate, str(tmp_path / "results"), owner) == "completed"


def test_plans(spark):
    rnd = random.Random(9)
    topics_ = [["график", "работа", "офис", "открыт", "время"], ["карта", "банк", "платёж", "счёт", "перевод"]]
    rows = [(i, [("user", " ".join(rnd.choice(topics_[i % 2]) for _ in range(12))), ("assistant", "понятно")], ["ответ"]) for i in range(40)]
    rows.append((40, rows[0][1], ["ответ"]))
    df = spark.createDataFrame(rows, "row_idx long, history array<struct<role:string,content:string>>, goals array<string>")
    got = pipelines.cluster_sample(df, providers.HashedWords(64), "user", threshold=0.999)
    removed = {r.row_idx: r.reason for r in got.removed.collect()}
    assert removed[40] == "exact" and got.records.count() == 41 - len(removed)
    assert got.quality.first().n_clusters >= 2 and got.keywords.count() >= 2
    judge = providers.RuleJudge(lambda p: {"result": 1 if "карта" in p else 0, "reason": "r"})
    scored = pipelines.evaluate_existing(df, judge).select("result", F.contains(F.to_json("history"), F.lit("карта")).alias("want")).collect()
    assert all(r.result == r.want for r in scored)
    items = df.select(F.to_json("history").alias("prompt"), F.when(F.contains(F.to_json("history"), F.lit("карта")), "да").otherwise("нет").alias("human"))
    found, best = pipelines.compare_judges(items, {"good": judge, "always": providers.RuleJudge(lambda p: {"result": True})}, "prompt")
    assert best.first().variant == "good" and {r.variant: r.kappa for r in found.collect()}["good"] == 1.0


def test_judge_failures_are_rows(spark):
    class Broken:
        def judge(self, prompts):
            raise TimeoutError("late")

    df = spark.createDataFrame([("g", [("user", "x")])], "g string, history array<struct<role:string,content:string>>").withColumn("goals", F.array("g"))
    r = pipelines.evaluate_existing(df, Broken(), "result,reason").first()
    assert r.accuracy == 0.0 and "late" in r.error and r.criterion_accuracy == {"result": 0.0}


def test_repeats(spark):
    cases = spark.createDataFrame([("a",)], "dialog_id string")
    assert [r.dialog_id for r in scoring.with_repeats(cases, 2).orderBy("repeat_index").collect()] == ["a#1", "a#2"]
    met = spark.createDataFrame([(["None"], []), (["None"], ["f"]), (["f", "g"], ["g"]), (["f"], None)], "g array<string>, c array<string>")
    assert [r.m for r in met.select(scoring.tool_call_met(F.col("g"), F.col("c")).alias("m")).collect()] == [True, False, True, False]


def test_tools(spark):
    from colloquy.functions import tools

    calls = '[{"function": {"name": "f", "arguments": "{\\"tool_arguments\\": {\\"a\\": {\\"block_id\\": 1, \\"b\\": \\"ж\\"}}}"}, "id": "1", "x": 2}, {"function": {"name": "g", "arguments": "not json"}}]'
    schema = '{"function": {"name": "f", "description": "d"}}'
    df = spark.createDataFrame([(calls, schema, '{"a": ["{x} {y}"]}', {"x": "1"})], "c string, s string, t string, m map<string,string>")
    call = tools.schema_call(F.parse_json("s"), "v")
    r = df.select(tools.calls_for_display(F.col("c")).alias("c"), call.alias("s"), tools.substitute(F.col("t"), F.col("m")).alias("t")).first()
    import hashlib
    import json

    shown = json.loads(r.c)
    assert shown[0] == {"function": {"name": "f", "arguments": '{"a":{"b":"ж"}}'}, "id": "1", "type": "function"} and shown[1]["function"]["arguments"] == "not json"
    assert r.s.arguments == '{"description":"d"}' and r.s.id == "call_" + hashlib.md5(b'v\0f\0{"description":"d"}').hexdigest()[:24]
    assert json.loads(r.t) == {"a": ["1 {y}"]}
    events = spark.createDataFrame([('{"tool_event_source": "http_variables"}',), ('{"type": "tool_call", "http_tool_variable_names": []}',), ('{"type": "tool_call", "tool_event_source": "tech_log"}',)], "e string")
    got = events.select(tools.from_variables(F.parse_json("e")).alias("a"), tools.hidden_event(F.parse_json("e"), True).alias("b")).collect()
    assert [(x.a, x.b) for x in got] == [(True, False), (True, False), (False, True)]
    fields = spark.createDataFrame([('{"passed": true, "score": 2, "failed_checks": ["x", "y"]}',), ('"text"',), ("null",)], "e string")
    assert [x.t for x in fields.select(tools.eval_field_text(F.parse_json("e")).alias("t")).collect()] == ["✅ · score=2 · failed: x; y", "text", "—"]
    assert "● f" in tools.tools_for_prompt([{"type": "function", "function": {"name": "f"}}])


def test_simulation(spark):
    from colloquy.plans import simulation

    class Echo:
        def __init__(self, name):
            self.name = name

        def reply(self, history):
            return f"{self.name}{len(history)}"

    df = spark.createDataFrame([("a", []), ("b", [("user", "hi")])], "dialog_id string, history array<struct<role:string,content:string>>")
    got = {r.dialog_id: r for r in simulation.simulate(df, Echo("u"), Echo("s"), 3).collect()}
    assert [t.content for t in got["a"].history] == ["u0", "s1", "u2", "s3"] and got["a"].turns == 3
    assert [t.content for t in got["b"].history] == ["hi", "s1", "u2", "s3"]
    stopped = simulation.simulate(df, Echo("u"), Echo("s"), 5, stop=lambda h: True).collect()
    assert {len(r.history) for r in stopped} == {2}
    assert {r.dialog_id: len(r.history) for r in simulation.one_reply(df, Echo("s")).collect()} == {"a": 1, "b": 2}


def test_keywords_look_beyond_terms_without_meaning(spark):
    names = [f"{a}{b}" for a in ("kiwi", "plum", "fig") for b in ("stone", "water", "cloud", "grass")]
    junk = [str(n) for n in range(1000, 1300)] * 2
    inside = ["kiwistone" * 4] * 9 + ["k"]
    df = spark.createDataFrame([(0, " ".join(junk + names)), (1, " ".join(inside + ["other"]))], "cluster_id int, text string")
    got = {r.cluster_id: [w.term for w in r.words] for r in topics.keywords(df, "text").collect()}
    assert got[0] == sorted(names)[:10]
    assert {r.cluster_id: [w.term for w in r.words] for r in topics.keywords(df, "text", pool=2).collect()} == got


@pytest.mark.parametrize("threshold", [0.5, 0.7])
def test_semantic_pairs_at_low_thresholds(spark, threshold):
    rnd = np.random.default_rng(4)
    base = rnd.standard_normal((12, 16))
    vectors = [(i, (base[i % 12] + 0.7 * rnd.standard_normal(16)).tolist()) for i in range(240)]
    df = spark.createDataFrame(vectors, "row_idx long, embedding array<double>")
    want = {(r.i, r.j) for r in dedup.exact_pairs(df, threshold).collect()}
    assert len(want) > 300 and {(r.i, r.j) for r in dedup.semantic_pairs(df, threshold).collect()} == want


def test_clustering_makes_and_compares_each_text_once(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(pipelines, "materialise", lambda df, name: (tables.append(name), shared.materialise(df, name))[1])
    turns = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("text "), (F.col("id") % 5).cast("string")).alias("content")))
    got = pipelines.cluster_sample(spark.range(40).select(F.col("id").alias("row_idx"), turns.alias("history")), providers.HashedWords(16), "user", threshold=None)
    plan = got.removed._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "Join" not in plan and "Aggregate" not in plan
    assert tables[:2] == ["texts", "marked"]
    assert {(r.row_idx, r.kept_idx) for r in got.removed.collect()} == {(i, i % 5) for i in range(5, 40)}
