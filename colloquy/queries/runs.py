"""Evaluation runs: judging, repeats, simulation, timing, catalog, queue, traces and providers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import scoring, timing
from ..plans import pipelines, providers, simulation
from ..shared import scratch
from ..sources import traces
from ..sources.catalog import Catalog
from ..sources.exports import stored_config
from ..streaming import jobs
from .base import query, rounded, table

# --- judging


def _dialogs(spark, sf_dir) -> DataFrame:
    from .dialogs import dialogs

    return dialogs(spark, sf_dir).select(F.col("conv_id").cast("string").alias("dialog_id"), F.array(F.lit("goal")).alias("goals"), "history")


def _rule(prompt: str) -> dict:
    return {"result": len(prompt) % 2, "clear": {"passed": len(prompt) % 3 == 0}, "reason": "r"}


class _Unsure:
    """A judge that fails on prompts of a length divisible by four and doesn't always answer in JSON."""

    def judge(self, prompts: list[str]) -> list[str]:
        if any(len(p) % 4 == 0 for p in prompts):
            raise TimeoutError("late")
        return ["Вердикт: да" if len(p) % 2 else json.dumps({"result": "no"}) for p in prompts]


_PROMPT = """(SELECT conv_id::VARCHAR AS dialog_id, length('Цели: goal' || chr(10) || chr(10) || 'Диалог:' || chr(10) || string_agg((CASE role WHEN 'user' THEN 'USER' WHEN 'assistant' THEN 'ASSISTANT' ELSE upper(role) END) || ': ' || regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) ORDER BY turn) || chr(10) || chr(10) || 'Ответьте JSON.') AS n FROM conversations GROUP BY conv_id)"""


@query(f"SELECT dialog_id, n % 2 = 1 AND n % 3 = 0 AS result, (n % 2 = 1 AND n % 3 = 0)::INT::DOUBLE AS accuracy, 'clear=' || (n % 3 = 0)::INT || ',result=' || n % 2 AS criteria FROM {_PROMPT}")
def evaluated_dialogs(spark, sf_dir):
    rows = pipelines.evaluate_existing(_dialogs(spark, sf_dir), providers.RuleJudge(_rule), "result,clear,reason")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("criterion_accuracy")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("int").cast("string"))), ",")
    return rows.select("dialog_id", "result", "accuracy", shown.alias("criteria"))


@query(f"SELECT dialog_id, CASE WHEN n % 4 = 0 THEN 0.0 ELSE n % 2 END::DOUBLE AS accuracy, CASE WHEN n % 4 = 0 THEN 'TimeoutError: late' END AS error FROM {_PROMPT}")
def unsure_judge(spark, sf_dir):
    """Failures of a judge are rows of accuracy 0, and an answer without JSON is read for its verdict."""
    return pipelines.evaluate_existing(_dialogs(spark, sf_dir), _Unsure()).select("dialog_id", "accuracy", "error")


@query("SELECT conv_id || '#' || k AS dialog_id, conv_id::VARCHAR AS source_id, k::INT AS repeat_index FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest(range(1, 4)) AS k)")
def repeated_cases(spark, sf_dir):
    return scoring.with_repeats(_dialogs(spark, sf_dir), 3).select("dialog_id", "source_id", "repeat_index")


@query("SELECT l_orderkey AS source_id, 'flag' AS criterion, round(avg((l_returnflag = 'N')::INT), 9) AS mean, min((l_returnflag = 'N')::INT) = 1 AS all_passed FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1")
def repeat_criteria(spark, sf_dir):
    flag = F.when(F.col("l_linenumber") != 2, F.create_map(F.lit("flag"), (F.col("l_returnflag") == "N").cast("double")))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), flag.alias("criterion_accuracy"))
    return rounded(scoring.repeat_criteria(rows), "mean")


def _agrees(prompt: str) -> dict:
    return {"result": prompt.startswith("1")}


def _always(prompt: str) -> dict:
    return {"result": True}


_VARIANT = "SELECT '{name}' AS variant, count(*) AS n, avg((y1 = y2)::INT) AS exact, count(*) FILTER (WHERE y1 = 1 AND y2 = 1)::DOUBLE AS tp, count(*) FILTER (WHERE y1 = 0 AND y2 = 1)::DOUBLE AS fp, 'close' AS best FROM (SELECT quality AS y1, {y2} AS y2 FROM labels)"


@query(_VARIANT.format(name="close", y2="(quality = 1 AND doc_id % 10 <> 0)::INT") + " UNION ALL " + _VARIANT.format(name="always", y2="1"))
def judge_comparison(spark, sf_dir):
    prompt = F.concat(F.when(F.col("doc_id") % 10 == 0, 0).otherwise(F.col("quality")).cast("string"), F.lit(" text"))
    items = table(spark, sf_dir, "labels").select(prompt.alias("prompt"), F.when(F.col("quality") == 1, "да").otherwise("нет").alias("human"))
    found, best = pipelines.compare_judges(items, {"close": providers.RuleJudge(_agrees), "always": providers.RuleJudge(_always)}, "prompt")
    return found.crossJoin(F.broadcast(best.withColumnRenamed("variant", "best"))).select("variant", "n", "exact", "tp", "fp", "best")


@query("SELECT CASE WHEN conv_id % 3 = 0 THEN 'new' || conv_id ELSE conv_id::VARCHAR END AS dialog_id, 'kept' AS extra, count(*)::INT AS turns, coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant'), '') AS predicted, 'LLM' AS mode, 'SC1' AS scenario_id FROM conversations GROUP BY conv_id")
def merged_results(spark, sf_dir):
    """A case's fields with those of its run, which win; the run may rename the dialog."""
    cases = _dialogs(spark, sf_dir).withColumn("extra", F.lit("kept")).withColumn("turns", F.lit(-1))
    found = pipelines.existing_result(cases).withColumn("new_dialog_id", F.when(F.col("dialog_id").cast("int") % 3 == 0, F.concat(F.lit("new"), "dialog_id")).otherwise(" "))
    return pipelines.with_output(cases, found, mode="LLM", scenario=" SC1 ").select("dialog_id", "extra", "turns", "predicted", "mode", "scenario_id")


@query("SELECT DISTINCT conv_id::VARCHAR AS dialog_id, 0.0::DOUBLE AS accuracy, 0::INT AS turns, 'result=0.0' AS criteria, 'KeyError' AS error_type, 'lost: x' AS error FROM conversations")
def failed_cases(spark, sf_dir):
    rows = pipelines.failed_result(_dialogs(spark, sf_dir), "KeyError: lost: x", "result,reason")
    return rows.withColumn("criteria", F.array_join(F.transform(F.map_entries("criterion_accuracy"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")).drop("criterion_accuracy")


@query("SELECT conv_id, conv_id % 2 = 0 AS blank, 'x {' || conv_id || '}' AS prompt FROM (SELECT DISTINCT conv_id FROM conversations)")
def prompt_previews(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    v = F.create_map(F.lit("id"), F.col("conv_id").cast("string"))
    return c.select("conv_id", text.blank(F.when(F.col("conv_id") % 2 == 0, " \t").otherwise("y")).alias("blank"), text.template("x {{id}}", v).alias("prompt"))


# --- simulation


class _Says:
    """A speaker that says its name and how much it has heard."""

    def __init__(self, name: str):
        self.name = name

    def reply(self, history: list[dict]) -> str:
        return f"{self.name}{len(history)}"


def _enough(history: list[dict]) -> bool:
    return len(history) >= 6


@query("""SELECT conv_id::VARCHAR AS dialog_id, CASE WHEN conv_id % 2 = 0 THEN 'user=u0 assistant=a1 user=u2 assistant=a3 user=u4 assistant=a5' ELSE 'user=hello assistant=a1 user=u2 assistant=a3 user=u4 assistant=a5' END AS said, 5::INT AS turns FROM (SELECT DISTINCT conv_id FROM conversations)""")
def simulated_dialogs(spark, sf_dir):
    """A user and an assistant by turns: an empty dialog is opened by the user, and a condition ends it."""
    empty = F.array().cast("array<struct<role:string,content:string>>")
    begun = F.array(F.struct(F.lit("user").alias("role"), F.lit("hello").alias("content")))
    cases = table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.when(F.col("conv_id") % 2 == 0, empty).otherwise(begun).alias("history"))
    done = simulation.simulate(cases.withColumnRenamed("conv_id", "dialog_id"), _Says("u"), _Says("a"), 9, _enough)
    return done.select("dialog_id", F.array_join(F.transform("history", lambda t: F.concat(t["role"], F.lit("="), t["content"])), " ").alias("said"), "turns")


@query("SELECT conv_id::VARCHAR AS dialog_id, 'a' || count(*) AS reply, 1::INT AS turns FROM conversations GROUP BY conv_id")
def one_reply_each(spark, sf_dir):
    done = simulation.one_reply(_dialogs(spark, sf_dir), _Says("a"))
    return done.select("dialog_id", F.element_at("history", -1)["content"].alias("reply"), "turns")


# --- timing


def _turns(spark, sf_dir) -> DataFrame:
    from .dialogs import _turns

    return _turns(spark, sf_dir)


_TURNS = "(SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn_idx, CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, epoch_us(ts) AS us, CASE WHEN event_id % 3 = 0 THEN value END AS duration FROM events)"


@query(f"""WITH d AS (SELECT user_id, avg(duration) FILTER (WHERE role = 'assistant') AS a, avg(duration) FILTER (WHERE role = 'user') AS u, sum(duration) AS t FROM {_TURNS} GROUP BY user_id) SELECT round(avg(a), 6) AS mean_assistant, round(avg(u), 6) AS mean_user, round(avg(t), 5) AS mean_duration FROM d""")
def mean_reply_times(spark, sf_dir):
    m = timing.mean_times(timing.dialog_times(_turns(spark, sf_dir)))
    return m.select(F.round("mean_assistant", 6).alias("mean_assistant"), F.round("mean_user", 6).alias("mean_user"), F.round("mean_duration", 5).alias("mean_duration"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN value WHEN 2 THEN 1.5 WHEN 3 THEN 2.25 END::DOUBLE AS seconds FROM events")
def turn_durations(spark, sf_dir):
    i, v = F.col("event_id") % 5, F.col("value").cast("string")
    first, second = F.when(i == 0, v).when(i == 1, "-1"), F.when(i == 1, F.replace(v, F.lit("."), F.lit(",")))
    seconds = timing.turn_duration([first, second], F.when(i == 2, F.lit("1500")), F.when(i == 3, F.lit(2.25)))
    return table(spark, sf_dir, "events").select("event_id", seconds.alias("seconds"))


_SHARE = """s AS (SELECT *, budget // nullif(unit, 0) AS whole, 2 * (budget % nullif(unit, 0)) AS rest FROM w)
    SELECT event_id, coalesce(duration, {when} (whole + (rest > unit OR (rest = unit AND whole % 2 = 1))::INT)::DOUBLE / 10000 END) AS duration FROM s"""


@query(f"""WITH w AS (SELECT *, greatest(0, 20000000000 - coalesce(sum(round(duration * 1000000)::BIGINT) OVER p, 0)::BIGINT) AS budget, 100 * count(*) FILTER (WHERE duration IS NULL) OVER p AS unit FROM {_TURNS} WINDOW p AS (PARTITION BY user_id)), {_SHARE.format(when='CASE WHEN true THEN')}""")
def backfilled_durations(spark, sf_dir):
    return timing.backfill(_turns(spark, sf_dir).withColumn("total", F.lit(20000.0)), "total").select("event_id", "duration")


@query(f"""WITH g AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY turn_idx) AS gap FROM {_TURNS}), r AS (SELECT *, gap // 100 AS q, gap % 100 AS rest0 FROM g),
    t AS (SELECT event_id, user_id, coalesce(duration, CASE WHEN gap >= 0 THEN (100 * (q + (rest0 > 50 OR (rest0 = 50 AND q % 2 = 1))::INT))::DOUBLE / 1000000 END) AS duration FROM r),
    w AS (SELECT *, 9000000000000 - coalesce(sum(round(duration * 1000000)::BIGINT) OVER p, 0)::BIGINT AS budget, 100 * count(*) FILTER (WHERE duration IS NULL) OVER p AS unit FROM t WINDOW p AS (PARTITION BY user_id)), {_SHARE.format(when='CASE WHEN budget > 0 THEN')}""")
def enriched_durations(spark, sf_dir):
    """Durations from time stamps, then from the wall time, done twice: the second time changes nothing."""
    once = timing.enrich(_turns(spark, sf_dir).withColumn("wall", F.lit(9_000_000.0)))
    return timing.enrich(once).select("event_id", "duration")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts)::DOUBLE / 1000000 WHEN 1 THEN epoch_us(date_trunc('second', ts))::DOUBLE / 1000000 WHEN 2 THEN 12.5 END AS seconds FROM events")
def read_times(spark, sf_dir):
    """ISO texts with a zone, naive ones (UTC), numbers and nonsense as seconds."""
    i = F.col("event_id") % 4
    t = F.when(i == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(i == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(i == 2, "12,5").otherwise("soon")
    return table(spark, sf_dir, "events").select("event_id", values.epoch_seconds(t).alias("seconds"))


# --- catalog and queue


@query("""SELECT * FROM (VALUES ('run', 'done', 'completed', 'progress 4 of 4, 0.75'), ('run', 'stopped', 'cancelled', 'progress 1 of 4, 0.5'), ('run', 'broken', 'failed', '8000'), ('found', 'done', 'completed', ''),
    ('preset', 'a', 'true', '{}'), ('preset', 'b', 'false', '{}'), ('sample', 'set', '2', 'ordinal'), ('migrations', '4', '', ''), ('config', 'model-x', 'http://base', '5')) AS t(kind, name, state, detail)""")
def catalog_history(spark, sf_dir):
    """What a catalog holds after runs, presets and samples have been made, moved, replaced and deleted."""
    c = Catalog(spark, scratch(spark, "catalog"))
    c.migrate()
    config = stored_config({"k": 5}, "2024-01-01", {"LITELLM_MODEL_NAME": "model-x", "LITELLM_API_BASE": " http://base "})
    done, stopped, broken = (c.create_run(json.dumps({"scenario_id": s}), title=t, total=4) for s, t in (("SC1", "done"), ("x", "stopped"), ("y", "broken")))
    c.progress(done, 1, 4, 0.1)  # not running yet: nothing happens
    assert c.claim(done) and not c.claim(done) and c.complete(done, "r", 0.75) and not c.cancel(done)
    assert c.cancel(stopped)
    c.attach_to_cancelled(stopped, "r", 0.5, 1, 4)
    c.fail(broken, "e" * 9000)
    old, _, _ = c.save_preset("old", "{}", is_default=True), c.save_preset("b", "{}"), c.save_preset("a", "{}", is_default=True)
    c.delete("presets", old)
    lines = spark.createDataFrame([("{}",), ("{}",), (" ",)], "value string")
    kept, gone = c.save_sample(" set ", lines, label_mode="ordinal"), c.save_sample("gone", lines)
    c.delete("samples", gone)
    assert c.sample_lines(kept).count() == 3 and c.sample_by_name("set").id == kept and c.default_preset().name == "a"
    s = lambda x: F.col(x).cast("string")
    detail = F.when(F.col("status") == "failed", F.length("error").cast("string")).otherwise(F.concat(F.lit("progress "), s("progress_done"), F.lit(" of "), s("progress_total"), F.lit(", "), s("avg_accuracy")))
    out = c.table("runs").select(F.lit("run").alias("kind"), F.col("title").alias("name"), F.col("status").alias("state"), detail.alias("detail"))
    out = out.union(c.recent_runs(search="sc1").select(F.lit("found"), "title", "status", F.lit("")))
    out = out.union(c.presets().select(F.lit("preset"), "name", s("is_default"), "config"))
    out = out.union(c.samples().select(F.lit("sample"), "name", s("case_count"), "label_mode"))
    out = out.union(c.table("versions").agg(F.count("*").cast("string").alias("n")).select(F.lit("migrations"), "n", F.lit(""), F.lit("")))
    told = (("config", config["enqueue_meta"]["litellm_model_name_env"], config["litellm_api_base"], str(config["k"])),)
    return out.union(spark.createDataFrame(told, "kind string, name string, state string, detail string"))


def _accuracy(lines: DataFrame) -> DataFrame:
    return lines.select((F.try_variant_get(F.try_parse_json("value"), "$.quality", "double")).alias("accuracy"))


@query("SELECT 'part ' || p AS title, CASE WHEN p = 2 THEN 'cancelled' ELSE 'completed' END AS status, CASE WHEN p <> 2 THEN round(a, 9) END AS avg_accuracy, CASE WHEN p = 2 THEN 0 ELSE n END::INT AS done FROM (SELECT doc_id % 3 AS p, avg(quality) AS a, count(*) AS n FROM labels GROUP BY 1)")
def queued_runs(spark, sf_dir):
    """Runs published to a queue, one of them cancelled in time, worked off by a stream."""
    root = scratch(spark, "queue")
    c, lab = Catalog(spark, f"{root}/catalog"), table(spark, sf_dir, "labels")
    ids = [jobs.new_run(c, f"{root}/inbox", lab.where(F.col("doc_id") % 3 == p).select(F.to_json(F.struct("quality")).alias("value")), title=f"part {p}") for p in range(3)]
    c.cancel(ids[2])
    jobs.worker(spark, c, f"{root}/inbox", f"{root}/results", f"{root}/checkpoint", _accuracy).awaitTermination()
    return c.table("runs").select("title", "status", F.round("avg_accuracy", 9).alias("avg_accuracy"), F.col("progress_done").alias("done"))


# --- traces


class _PagedTraces(traces.TraceSource):
    """Five pages of made-up traces in place of the remote service."""

    @classmethod
    def name(cls) -> str:
        return "paged_traces"

    @staticmethod
    def fetch(options: dict, page: int) -> dict:
        rows = [{"id": f"t{page}-{i}", "traceId": f"t{i}", "type": "TOOL" if i % 2 else "SPAN", "startTime": f"2024-01-0{page}", "tags": ["x", page], "metadata": {"p": page}} for i in range(4)]
        return {"data": rows, "meta": {"totalPages": 5}}


@query("SELECT 't' || p || '-' || i AS id, 'x,' || p AS tags, '{\"p\": ' || p || '}' AS metadata FROM (SELECT unnest(range(1, 6)) AS p), (SELECT unnest(range(4)) AS i)")
def paged_traces(spark, sf_dir):
    traces.register(spark, _PagedTraces)
    return spark.read.format("paged_traces").load().select("id", F.array_join("tags", ",").alias("tags"), "metadata")


@query("SELECT 't' || i AS trace_id, '2024-01-01' AS first, (SELECT count(*) FROM events WHERE event_id IN (1, 3)) AS wanted FROM (SELECT unnest([1, 3]) AS i)")
def traces_by_observation(spark, sf_dir):
    """Traces found by the kind of an observation."""
    traces.register(spark, _PagedTraces)
    seen = spark.read.format("paged_traces").option("what", "observations").load()
    own = table(spark, sf_dir, "events").select(F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("id"))
    found = traces.wanted_traces(own, observations=seen, kind_="TOOL").agg(F.count("*").alias("wanted"))
    assert traces.wanted_traces(own, ids=["t1"]).count() == 1
    return traces.observed_traces(seen, "TOOL").crossJoin(F.broadcast(found))


@query("""SELECT user_id::VARCHAR AS trace_id, string_agg(CASE WHEN event_id % 3 = 0 THEN 'user=' || event_type WHEN event_id % 3 = 1 THEN 'assistant=' || event_type ELSE 'tool={"x":1}' END, ' ' ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S'), event_id::VARCHAR) AS history FROM events WHERE event_id % 4 <> 3 GROUP BY user_id""")
def observation_histories(spark, sf_dir):
    i, t = F.col("event_id"), F.col("event_type")
    name = F.when(i % 3 == 0, "the User").when(i % 3 == 1, "x").otherwise("my_tool")
    out = F.when(i % 4 == 3, F.lit(None)).when(i % 3 == 0, F.concat(F.lit('{"text": "'), t, F.lit('"}'))).when(i % 3 == 1, t).otherwise('{"x": 1}')
    rows = table(spark, sf_dir, "events").select(i.cast("string").alias("id"), F.col("user_id").cast("string").alias("traceId"), F.when(i % 3 == 1, "generation").otherwise("SPAN").alias("type"), name.alias("name"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("startTime"), F.lit(None).cast("string").alias("input"), out.alias("output"))
    h = traces.observation_history(rows)
    return h.select("trace_id", F.array_join(F.transform("history", lambda x: F.concat(x["role"], F.lit("="), x["content"])), " ").alias("history"))


@query("""SELECT event_id::VARCHAR AS trace_id, CASE WHEN event_id % 2 = 0 THEN 'm' || event_id ELSE user_id::VARCHAR END AS dialog_id, CASE WHEN event_id % 2 = 0 THEN 'g' ELSE event_type END AS goals, 'forced' AS new_goals, CASE WHEN event_id % 2 = 0 THEN 'own' ELSE 'default' END AS eval,
    CASE event_id % 3 WHEN 0 THEN 'user=q assistant=' || event_type WHEN 1 THEN 'user=' || event_type ELSE 'user=from messages' END AS history FROM events""")
def trace_details(spark, sf_dir):
    """Cases from metadata, plain inputs and outputs, lists of turns and messages, then with defaults."""
    i, t = F.col("event_id"), F.col("event_type")
    meta = F.when(i % 2 == 0, F.concat(F.lit('{"dialog_id": "m'), i.cast("string"), F.lit('", "goals": ["g"], "eval": "own"}'))).otherwise("{}")
    inp = F.when(i % 3 == 0, F.lit("q")).when(i % 3 == 1, F.concat(F.lit('[{"role": "user", "content": "'), t, F.lit('"}]'))).otherwise('{"messages": [{"type": "human", "content": "from messages"}]}')
    out = F.when(i % 3 == 0, F.concat(F.lit('{"content": " '), t, F.lit(' "}')))
    rows = table(spark, sf_dir, "events").select(i.cast("string").alias("id"), t.alias("name"), F.col("user_id").cast("string").alias("sessionId"), meta.alias("metadata"), inp.alias("input"), out.alias("output"), F.lit("2024").alias("timestamp"))
    cases = traces.to_cases(rows)
    late = traces.with_defaults(cases, "forced", "default")
    rows = cases.select("trace_id", "dialog_id", F.array_join("goals", ",").alias("goals"), F.array_join(F.transform("history", lambda x: F.concat(x["role"], F.lit("="), x["content"])), " ").alias("history"))
    more = late.select(F.col("trace_id").alias("late_id"), F.array_join("goals", ",").alias("new_goals"), F.get_json_object("context", "$.eval").alias("eval"))
    return rows.join(more, F.col("trace_id") == F.col("late_id")).drop("late_id")


# --- providers and the clustering plan


class _Shape:
    """Vectors of the length of a text and the number of its words; none for texts of forbidden words."""

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        return [None if "error" in t else [float(len(t)), float(len(t.split(" ")))] for t in texts]


@query("SELECT event_id, CASE WHEN event_type <> 'error' AND event_id % 3 <> 0 THEN length(event_type) + 2 END::DOUBLE AS size, CASE WHEN event_type <> 'error' AND event_id % 3 <> 0 THEN 2 END::DOUBLE AS words FROM events")
def embedded_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.concat("event_type", F.lit(" x"))).alias("text"))
    e = F.col("embedding")
    return providers.embed(rows, "text", _Shape()).select("event_id", F.get(e, 0).alias("size"), F.get(e, 1).alias("words"))


@query("SELECT 'fallback' AS listed, 'own' AS model, 0.5::DOUBLE AS temperature, NULL::VARCHAR AS key, 'default' AS other FROM (SELECT count(*) FROM region)")
def provider_options(spark, sf_dir):
    own, other = providers.role_options(" own ", " ", "http://b", '{"temperature": 0.5, "messages": []}', "default"), providers.role_options("", "k", None, "not json", "default")
    assert "messages" not in own
    row = (providers.model_names("", "", "fallback")[0], own["model"], own["temperature"], own["api_key"], other["model"])
    return spark.createDataFrame([row], "listed string, model string, temperature double, key string, other string")


class _Kinds:
    """Almost equal vectors for texts of the same first word, orthogonal ones otherwise."""

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        kinds = ("view", "signup", "click", "purchase", "error")
        return [[float(t.split()[0] == k) for k in kinds] + [0.01 * int(t.split()[1]) / 100] for t in texts]


@query("SELECT event_type AS kind, count(DISTINCT user_id) AS n, (SELECT count(*) FROM events) - (SELECT count(*) FROM (SELECT DISTINCT event_type, user_id FROM events)) AS removed FROM events GROUP BY 1")
def clustered_sample(spark, sf_dir):
    """The whole clustering plan: exact duplicates, embeddings, density clusters, keywords and labels."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_idx"), F.array(F.struct(F.lit("user").alias("role"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("content"))).alias("history"))
    got = pipelines.cluster_sample(e, _Kinds(), "user", threshold=None, min_cluster_size=10)
    removed = got.removed.agg(F.count("*").alias("removed"))
    rows = got.records.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("n"), F.min(F.substring_index("text", " ", 1)).alias("kind"), F.max(F.substring_index("text", " ", 1)).alias("last"))
    return rows.where("kind = last").crossJoin(F.broadcast(removed)).select("kind", "n", "removed")
