"""The published unit cases of the analytics surface."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text, values
from colloquy.operators import metrics, scoring
from colloquy.sources import jsonl

HISTORY = "history array<struct<role:string,content:string>>"


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


def test_coverage(spark):
    rows = lambda d: spark.createDataFrame([(k,) for k, n in d.items() for _ in range(n)], "category string")
    assert metrics.coverage(rows({"a": 2, "b": 1}), rows({"a": 3, "c": 1}), "category").first().coverage_pct == 50.0


def test_mean_pairwise_cosine(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0])], "id int, embedding array<double>")
    assert metrics.mean_pairwise_cosine(df).first().mean_cosine == pytest.approx(1 / 3)
    assert metrics.mean_pairwise_cosine(df.where("id = 0")).first().mean_cosine is None


def test_sample_metrics(spark):
    df = spark.createDataFrame([("g1", 1, 1), ("g2", 2, 1), ("g1", 0, 2)], "goal string, turns int, cluster_id int")
    r = metrics.sample_metrics(df).first()
    assert (r.n_dialogs, r.n_turns, r.mean_turns, r.n_goals, r.n_clusters) == (3, 3, 1.0, 2, 2)


def test_compare_samples(spark):
    a = spark.createDataFrame([("g1", 0, 1), ("g2", 0, 2)], "goal string, turns int, cluster_id int")
    b = spark.createDataFrame([("g1", 1, 1)], "goal string, turns int, cluster_id int")
    got = {r.metric: r.current for r in metrics.compare_samples(a, b).collect()}
    assert got["goal_coverage_pct"] == 50.0 and len(got) > 8


def test_context_in_a_string(spark):
    v = values.parse_context(F.try_variant_get(F.parse_json(F.lit('{"context": "{\\"city\\": \\"Челябинск\\"}"}')), "$.context", "variant"))
    assert one(spark, F.to_json(v)) == '{"city":"Челябинск"}'


def case_rows(spark, *lines):
    return jsonl.cases(jsonl.parsed(jsonl.lines_of(spark, "\n".join(lines)), comments=False)).select("line_no", "dialog_id", "goals", F.to_json("context").alias("context"), "error").orderBy("line_no").collect()


def test_two_cases(spark):
    a, b = case_rows(spark, '{"goals": "цель", "context": {"k": 1}}', '{"goals": ["a", " ", "b "], "dialog_id": "dlg-1", "context": null}')
    assert a.goals == ["цель"] and a.context == '{"k":1}' and a.dialog_id.startswith("case-") and a.error is None
    assert b.goals == ["a", "b"] and b.dialog_id == "dlg-1" and b.context == "{}" and b.error is None
    assert case_rows(spark, '{"goals": "цель", "context": {"k": 1}}')[0].dialog_id == a.dialog_id


def test_invalid_cases(spark):
    a, b, c = case_rows(spark, '{"goals": "x", "context": ["not", "dict"]}', "not json", '{"goals": 5}')
    assert "context" in a.error and "JSON" in b.error and "goals" in c.error


def test_sanitize(spark):
    assert one(spark, text.sanitize(F.lit("none Привет,true"))) == "Привет,"


def test_roles(spark):
    row = ([("user", "Хочу узнать график"), ("assistant", "Офис работает до 18:00"), ("user", " ")],)
    assert one(spark, text.cluster_text(F.col("history"), "user"), HISTORY, row) == "Хочу узнать график"
    assert one(spark, text.cluster_text(F.col("history"), "assistant"), HISTORY, row) == "Офис работает до 18:00"
    assert one(spark, text.cluster_text(F.col("history"), "user", 2), HISTORY, row) == ""
    assert one(spark, text.cluster_text(F.col("history")), HISTORY, (None,)) == ""


def test_field_names():
    assert text.validate_field("dialog") == "dialog" and text.validate_field("a.b-1") == "a.b-1"
    for bad in ("history", "", "a b", "cluster_id"):
        with pytest.raises(ValueError):
            text.validate_field(bad)


def test_lenient_scan(spark):
    rows, bad = jsonl.lenient(jsonl.lines_of(spark, '{"a": 1}\nnot-json\n{"b": 2}\n[1]\n# note'))
    assert rows.count() == 2 and bad.first().bad == 2


def test_strict_scan(spark):
    rows = jsonl.strict(jsonl.lines_of(spark, '\n# comment\n{"a": 1}\n\n{"b": 2}\n')).select("line_no", F.to_json("obj").alias("o")).orderBy("line_no").collect()
    assert [(r.line_no, r.o) for r in rows] == [(3, '{"a":1}'), (5, '{"b":2}')]
    with pytest.raises(Exception, match="line 2"):
        jsonl.strict(jsonl.lines_of(spark, '{"a": 1}\n{bad\n')).select(F.to_json("obj")).collect()


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "ж")], "a int, b string")
    jsonl.to_jsonl_with_report(df, ["total 2"], str(tmp_path / "out"))
    rows, bad = jsonl.lenient(jsonl.numbered_lines(spark, str(tmp_path / "out")))
    assert sorted(r.o for r in rows.select(F.to_json("obj").alias("o")).collect()) == ['{"a":1,"b":null}', '{"a":2,"b":"ж"}'] and bad.first().bad == 0


def test_timeline(spark):
    line = '{"dialog_id": "d-1", "history": [{"role": "user", "content": "привет"}, {"role": "assistant", "content": "шум"}, {"role": "assistant", "content": "ответ"}, {"role": "assistant", "content": "", "tool_calls": [{"name": "f"}]}]}'
    rows, _ = jsonl.lenient(jsonl.lines_of(spark, line))
    events = jsonl.timeline(rows, noise=lambda role, content: content == "шум")
    assert events.where("type = 'message'").count() == 2 and events.where("type = 'tool_call'").count() == 1
    turns = jsonl.turns_table(events).collect()
    assert len(turns) == 2 and {t.dialog_id for t in turns} == {"d-1"}


@pytest.mark.parametrize(
    "code,env,want",
    [
        ("goals.strip().lower() in str(eval_value).strip().lower()", {"goals": "Да", "eval_value": " да! "}, True),
        ('response.get("address", {}).get("status") == "full"', {"response": {"address": {"status": "full"}}}, True),
        ("history[-1]['n'] > 2 if history else False", {"history": [{"n": 3}]}, True),
        ("len(goals[1:]) * 2 == 4 and not 1 in {2, 3}", {"goals": [1, 2, 3]}, True),
    ],
)
def test_predicates(code, env, want):
    assert scoring.Predicate(code, set(env))(env) is want


@pytest.mark.parametrize("code", ["__import__('os').system('echo')", "open('/etc/passwd')", "goals.__class__", "[x for x in goals]", "(lambda: 1)()", "f'{goals}'"])
def test_refused_predicates(code):
    with pytest.raises(ValueError):
        scoring.Predicate(code, {"goals"})


def test_empty_predicate():
    assert scoring.Predicate("", {"goals"})({}) is False and scoring.Predicate(" ", {"goals"}, True)({}) is True
