"""Scans, normalisation of nested records, and text fields."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import highlight, text, tools, values
from ..operators import cases, ranks, scoring
from ..shared import scratch, spread
from ..sources import jsonl, jsonl_sink, traces
from .base import query, table


def _variant(value: Column) -> Column:
    """Any column as the value that its JSON says."""
    return F.try_variant_get(F.parse_json(F.to_json(F.struct(value.alias("v")))), "$.v", "variant")


def _lines(rows: DataFrame, line: Column) -> DataFrame:
    """The rows' lines written as text and scanned again with their numbers."""
    path = scratch(rows.sparkSession, "lines")
    rows.select(line.alias("value")).write.text(path)
    return jsonl.numbered_lines(rows.sparkSession, path)


def _by(column: Column, *choices) -> Column:
    """The choice at the column's place, from 0."""
    out = None
    for i, c in enumerate(choices):
        c = c if isinstance(c, Column) else F.lit(c)
        out = F.when(column == i, c) if out is None else out.when(column == i, c)
    return out


# --- scans


@query("SELECT event_id, user_id, event_type, value FROM events")
def jsonl_round_trip(spark, sf_dir):
    """Records written as JSON lines and read by the strict scan."""
    path = scratch(spark, "records")
    jsonl.to_jsonl(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), path)
    obj = F.col("obj")
    rows = jsonl.strict(jsonl.numbered_lines(spark, path))
    return rows.select(*(F.try_variant_get(obj, f"$.{c}", t).alias(c) for c, t in (("event_id", "long"), ("user_id", "long"), ("event_type", "string"), ("value", "double"))))


_KIND = "CASE WHEN event_id % 7 = 0 THEN 'note' WHEN event_id % 11 = 0 THEN 'broken' WHEN event_id % 13 = 0 THEN 'list' WHEN event_id % 17 = 0 THEN 'blank' ELSE 'object' END"


def _mixed(e: DataFrame) -> DataFrame:
    i = F.col("event_id")
    good = F.to_json(F.struct("event_id", "event_type"))
    return _lines(e, F.when(i % 7 == 0, F.concat(F.lit("# "), good)).when(i % 11 == 0, F.lit('{"a": 1,')).when(i % 13 == 0, F.lit("[1, 2]")).when(i % 17 == 0, F.lit("  \t")).otherwise(F.concat(F.lit(" "), good)))


@query(f"SELECT event_id FROM (SELECT event_id, {_KIND} AS kind FROM events) WHERE kind = 'object'")
def jsonl_lenient_scan(spark, sf_dir):
    rows, _ = jsonl.lenient(_mixed(table(spark, sf_dir, "events")))
    return rows.select(F.try_variant_get("obj", "$.event_id", "long").alias("event_id"))


@query(f"SELECT count(*) FILTER (WHERE kind IN ('broken', 'list')) AS bad FROM (SELECT {_KIND} AS kind FROM events)")
def jsonl_bad_lines(spark, sf_dir):
    return jsonl.lenient(_mixed(table(spark, sf_dir, "events")))[1]


def _case_lines(e: DataFrame) -> DataFrame:
    """Cases of six shapes, two of them in error."""
    i = F.col("event_id")
    own = F.expr("concat('\"dialog_id\": \" d', event_id, ' \"')")
    site = F.concat(F.lit('{"site": "s'), (i % 5).cast("string"), F.lit('"}'))
    quoted = F.concat(F.lit('"'), F.replace(site, F.lit('"'), F.lit('\\"')), F.lit('"'))
    goals = _by(i % 6, "null", F.concat(F.lit('"  '), F.col("event_type"), F.lit(' "')), F.concat(F.lit('[" a ", "", null, "'), F.col("event_type"), F.lit('"]')), "7", '["g"]', '[]')
    context = _by(i % 6, site, "null", site, site, quoted, "[1]")
    return _lines(e, F.concat(F.lit("{"), own, F.lit(', "goals": '), goals, F.lit(', "context": '), context, F.lit("}")))


@query("""SELECT 'd' || event_id AS dialog_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN event_type WHEN 2 THEN 'a;' || event_type WHEN 4 THEN 'g' WHEN 5 THEN '' END AS goals,
    CASE WHEN event_id % 6 IN (0, 2, 3, 4) THEN 's' || (event_id % 5) END AS site, CASE event_id % 6 WHEN 3 THEN 'goals: neither text nor list' WHEN 5 THEN 'context: not an object' END AS error FROM events""")
def case_scan(spark, sf_dir):
    rows = jsonl.cases(jsonl.parsed(_case_lines(table(spark, sf_dir, "events")), comments=False))
    site = F.try_variant_get("context", "$.site", "string")
    return rows.select("dialog_id", F.array_join("goals", ";").alias("goals"), F.when(values.is_object(F.col("context")), site).alias("site"), "error")


@query("SELECT user_id, event_id FROM events")
def json_array_scan(spark, sf_dir):
    """JSON arrays with elements that aren't objects."""
    e = table(spark, sf_dir, "events")
    each = e.groupBy("user_id", (F.col("event_id") % 16).alias("part")).agg(F.concat(F.lit('[7, "x", '), F.array_join(F.collect_list(F.to_json(F.struct("user_id", "event_id"))), ", "), F.lit(", null]")).alias("value"))
    return jsonl.json_array(each).select(*(F.try_variant_get("obj", f"$.{c}", "long").alias(c) for c in ("user_id", "event_id")))


def _dialog_lines(spark, sf_dir) -> DataFrame:
    """Dialogs whose turns stand in one of four places; every third turn calls a tool, named in one of three places."""
    c = table(spark, sf_dir, "conversations")
    call = F.lit('[{"function": {"name": "find", "arguments": "{}"}}]')
    calls = _by(F.col("turn") % 3, "", "", _by(F.col("conv_id") % 3, F.concat(F.lit(', "tool_calls": '), call), F.concat(F.lit(', "full_response": {"tool_calls": '), call, F.lit("}")), F.concat(F.lit(', "full_response": {"response": {"tool_calls": {"function": {"name": "find"}}}}'))))
    turn = F.concat(F.lit('{"role": '), F.to_json(F.array("role")).substr(F.lit(2), F.length("role") + 2), F.lit(', "content": '), F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)"), calls, F.lit("}"))
    turns = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), ", ").alias("t"))
    listed = F.concat(F.lit("["), F.col("t"), F.lit("]"))
    in_text = F.expr("substring(to_json(array(concat('[', t, ']'))), 2, length(to_json(array(concat('[', t, ']')))) - 2)")
    place = _by(F.col("conv_id") % 4, F.concat(F.lit('"history": '), listed), F.concat(F.lit('"history": [], "messages": '), listed), F.concat(F.lit('"context": {"history": '), listed, F.lit("}")), F.concat(F.lit('"history": '), in_text))
    return jsonl.strict(_lines(turns, F.concat(F.lit('{"id": "'), F.col("conv_id").cast("string"), F.lit('", '), place, F.lit("}"))))


_EVENT = "CASE WHEN turn % 3 = 2 THEN 'tool_call' ELSE 'message' END"


@query(f"SELECT conv_id::VARCHAR AS dialog_id, turn::INT AS turn_idx, {_EVENT} AS type, CASE WHEN turn % 3 = 2 THEN 'assistant' ELSE role END AS role, CASE WHEN turn % 3 = 2 THEN '' ELSE text END AS content FROM conversations WHERE turn % 3 = 2 OR role <> 'system'")
def dialog_timeline(spark, sf_dir):
    return jsonl.timeline(_dialog_lines(spark, sf_dir), noise=lambda role, content: role == "system")


@query("SELECT conv_id::VARCHAR AS dialog_id, turn::INT AS turn_idx, role, text AS content FROM conversations WHERE turn % 3 <> 2")
def dialog_turns(spark, sf_dir):
    return jsonl.turns_table(jsonl.timeline(_dialog_lines(spark, sf_dir)))


@query("""SELECT CASE WHEN conv_id % 5 = 0 THEN '' ELSE conv_id::VARCHAR END AS dialog_id, '' AS scenario_id, CASE WHEN conv_id % 3 = 0 THEN 'g1;g2' WHEN conv_id % 3 = 1 THEN 'from text' ELSE '' END AS goals, count(*) AS turns,
    string_agg(role || '=' || text, chr(10) ORDER BY turn) AS history, count(*) FILTER (WHERE turn % 2 = 1) AS calls, CASE WHEN conv_id % 2 = 0 THEN '{"password":"[скрыто]","site":"x"}' END AS context FROM conversations GROUP BY conv_id""")
def annotation_export(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    call = F.when(F.col("turn") % 4 == 1, F.lit('[{"id": 1}]'))
    response = F.when(F.col("turn") % 4 == 3, F.lit('{"tool_calls": [{"id": 2}], "other": 3}'))
    h = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"), call.alias("tool_calls"), response.alias("full_response")))).alias("history"))
    i = F.col("conv_id")
    rows = h.select(F.when(i % 5 != 0, i.cast("string")).alias("dialog_id"), F.lit(None).cast("string").alias("scenario_id"), F.when(i % 3 == 0, F.array(F.lit("g1"), F.lit("g2"))).alias("goals"), F.when(i % 3 == 1, F.lit(" from text ")).alias("goals_text"), "history", F.when(i % 2 == 0, F.lit('{"password":"p","site":"x"}')).alias("context"))
    out = jsonl.annotation_records(rows)
    lines = F.array_join(F.transform("history", lambda t: F.concat(t["role"], F.lit("="), t["content"])), "\n")
    calls = F.size(F.filter("history", lambda t: t["tool_calls"].isNotNull())).cast("long")
    return out.select("dialog_id", "scenario_id", F.array_join("goals", ";").alias("goals"), F.size("history").cast("long").alias("turns"), lines.alias("history"), calls.alias("calls"), "context")


@query("SELECT event_id, 7 AS skipped FROM events")
def export_with_report(spark, sf_dir):
    """A file of records and a report that the scans skip; the report is counted on its own."""
    path = scratch(spark, "report")
    jsonl.to_jsonl_with_report(table(spark, sf_dir, "events").select("event_id"), [f"line {i}" for i in range(7)], path)
    lines = jsonl.numbered_lines(spark, path)
    notes = lines.agg(F.count_if(F.col("value").startswith("#")).cast("int").alias("skipped"))
    return jsonl.strict(lines).select(F.try_variant_get("obj", "$.event_id", "long").alias("event_id")).crossJoin(F.broadcast(notes))


@query("""WITH d AS (SELECT substr(coalesce(source, ''), 1, 80) AS field, coalesce(lang, '') AS label FROM documents), s AS (SELECT field, CASE label WHEN '' THEN '(пусто)' ELSE label END AS label FROM d),
    lines AS (SELECT 'records: ' || count(*) AS line FROM d UNION ALL SELECT 'by label' UNION ALL SELECT 'by field' UNION ALL SELECT 'by field and label'
    UNION ALL SELECT count(*) || chr(9) || label FROM s GROUP BY label UNION ALL SELECT count(*) || chr(9) || field FROM s GROUP BY field UNION ALL SELECT count(*) || chr(9) || field || chr(9) || label FROM s GROUP BY field, label)
    SELECT '# ' || line AS line, (SELECT count(*) FROM documents) AS scanned, (SELECT sum(doc_id)::BIGINT FROM documents) AS ids FROM lines""")
def export_with_stats(spark, sf_dir):
    """Records whose writer counts them, and their report; the scans skip the report and find every record."""
    path = scratch(spark, "stats")
    d = table(spark, sf_dir, "documents")
    jsonl_sink.save_with_report(d.select("doc_id", "lang", "source"), path, F.col("lang"), F.col("source"))
    lines = jsonl.numbered_lines(spark, path)
    found = jsonl.strict(lines).agg(F.count("*").alias("scanned"), F.sum(F.try_variant_get("obj", "$.doc_id", "long")).alias("ids"))
    return lines.where(F.col("value").startswith("#")).select(F.col("value").alias("line")).crossJoin(F.broadcast(found))


@query("""SELECT event_type, count(*) AS n, (SELECT count(*) FROM events) AS rows, (SELECT sum(octet_length(encode('{"event_id":' || event_id || ',"event_type":' || coalesce('"' || event_type || '"', 'null') || ',"user_id":' || coalesce(user_id::VARCHAR, 'null') || '}')) + 1)::BIGINT FROM events) AS bytes, 0::BIGINT AS damaged FROM events GROUP BY event_type""")
def export_commit(spark, sf_dir):
    """Tallies and totals that the writing tasks returned; a scan finds the lines of their digests."""
    path = scratch(spark, "commit")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    jsonl_sink.save(e, path, {"type": F.col("event_type")})
    told = jsonl_sink.manifest(spark, path).agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    bad = jsonl_sink.damaged(spark, path).agg(F.count("*").alias("damaged"))
    return jsonl_sink.tallies(spark, path, ["event_type"]).crossJoin(F.broadcast(told)).crossJoin(F.broadcast(bad))


@query("""WITH e AS (SELECT event_id + 1 AS line_no, CASE WHEN event_id % 97 = 55 THEN 'invalid JSON' WHEN event_id % 97 = 61 THEN 'not an object' WHEN event_id % 97 = 43 THEN 'goals: neither text nor list' WHEN event_id % 97 = 71 THEN 'context: not an object' END AS error FROM events)
    SELECT min(line_no) AS line_no, arg_min(error, line_no) AS error, count(error) AS n FROM e WHERE error IS NOT NULL""")
def first_bad_case(spark, sf_dir):
    """The first line that a strict scan of cases would stop at, and how many there are."""
    k = F.col("event_id") % 97
    bad = F.when(k == 55, '{"goals":').when(k == 61, "[1]").when(k == 43, '{"goals": 3}').when(k == 71, '{"goals": "g", "context": [2]}')
    value = F.coalesce(bad, F.concat(F.lit('{"dialog_id": "'), F.col("event_id").cast("string"), F.lit('", "goals": ["g"]}')))
    lines = table(spark, sf_dir, "events").select(F.lit("").alias("file"), (F.col("event_id") + 1).alias("line_no"), value.alias("value"))
    checked = jsonl.cases(jsonl.parsed(lines))
    return jsonl.first_error(checked).crossJoin(checked.agg(F.count("error").alias("n")))


# --- normalisation


def _goals(e: DataFrame) -> DataFrame:
    g = _by(F.col("event_id") % 4, F.array(F.lit(" one "), F.col("event_type")), F.array(F.lit(" "), F.lit(None).cast("string")), F.array().cast("array<string>"), F.array(F.col("event_type")))
    return e.select("event_id", g.alias("goals"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'one, ' || event_type WHEN 3 THEN event_type ELSE 'Без цели' END AS joined, CASE event_id % 4 WHEN 0 THEN 'one' WHEN 3 THEN event_type ELSE 'Без цели' END AS first,
    CASE event_id % 4 WHEN 0 THEN 'one; ' || event_type WHEN 3 THEN event_type ELSE '' END AS dedup FROM events""")
def goal_texts(spark, sf_dir):
    g = F.col("goals")
    return _goals(table(spark, sf_dir, "events")).select("event_id", text.goals_text(g).alias("joined"), text.first_goal(g).alias("first"), text.dedup_text(g).alias("dedup"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'k=' || json_extract_string(props, '$.k') || ',list=[1,2],none=,type=' || event_type WHEN 1 THEN 'k=' || json_extract_string(props, '$.k') || ',type=' || event_type ELSE 'type=' || event_type END AS fields FROM events""")
def context_fields(spark, sf_dir):
    """Contexts as objects, as JSON objects in text, and as something else, flattened and overridden."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    raw = _by(i % 3, F.concat(F.lit('{"k": '), k, F.lit(', "list": [1, 2], "none": null, "type": "old"}')), F.concat(F.lit('"{\\"k\\": '), k, F.lit('}"')), "[5]")
    flat = values.merge_maps(values.flatten_context(values.as_object(F.try_parse_json(raw))), F.create_map(F.lit("type"), F.col("event_type")))
    return e.select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries(flat)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("fields"))


@query("""SELECT event_id, '{"kind":"' || event_type || '","number":' || (event_id % 9) || CASE WHEN event_id % 2 = 0 THEN ',"share":"x7"}' ELSE ',"share":7}' END AS body FROM events""")
def request_bodies(spark, sf_dir):
    """Context keys renamed through a mapping; named numeric fields become whole numbers."""
    i = F.col("event_id")
    mapping = values.field_map('{"event_type": "kind", "n": "number", "s": "share"}')
    assert mapping and values.field_map("[1]") is None and values.field_map('{"a": 1}') is None and values.field_map("{") is None
    fields = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("n"), F.concat((i % 9).cast("string"), F.lit(".0")), F.lit("s"), F.when(i % 2 == 0, "x7").otherwise("7"), F.lit("left_out"), F.lit("z"))
    return table(spark, sf_dir, "events").select("event_id", values.whole_numbers(values.rename_keys(fields, mapping), ["number", "share"]).alias("body"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 12 WHEN 1 THEN 7 WHEN 4 THEN 3 ELSE 0 END::INT AS block FROM events")
def stop_blocks(spark, sf_dir):
    i = F.col("event_id") % 5
    return table(spark, sf_dir, "events").select("event_id", values.positive_int(_by(i, "12", "0", "x", None, "-4"), _by(i, "5", "7", "-1", None, "3")).alias("block"))


@query("SELECT event_type AS text, '{}' AS context, (user_id % 3)::INT AS stop_id, least(500, count(*))::INT AS n FROM events GROUP BY 1, 3")
def generation_forms_with_stop(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    context = F.create_map(F.lit("site"), F.lit("s1"), F.lit("stop_block_id"), (F.col("user_id") % 3).cast("string"))
    rows = e.select(F.col("event_id").alias("row_idx"), F.array("event_type").alias("goals"), context.alias("context"))
    return cases.form_rows(rows, with_stop=True).select("text", "context", "stop_id", "n")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN value WHEN 1 THEN value WHEN 2 THEN 12.5 END::DOUBLE AS x, CASE event_id % 6 WHEN 0 THEN value WHEN 1 THEN value WHEN 2 THEN 12.5 END::DOUBLE AS y FROM events""")
def metric_numbers(spark, sf_dir):
    """Numbers, numbers in text with a comma, booleans, words and infinities, from text and from JSON."""
    i, v = F.col("event_id") % 6, F.col("value").cast("string")
    as_text = _by(i, v, F.concat(F.lit(" "), F.replace(v, F.lit("."), F.lit(","))), "12,5", "true", "Infinity", "word")
    as_json = F.try_parse_json(_by(i, v, F.concat(F.lit('" '), F.replace(v, F.lit("."), F.lit(",")), F.lit('"')), '"12,5"', "true", "null", "[1]"))
    return table(spark, sf_dir, "events").select("event_id", values.metric(as_text).alias("x"), values.metric_variant(as_json).alias("y"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'user' WHEN 2 THEN 'assistant' WHEN 3 THEN 'assistant' END AS side FROM events")
def speaking_sides(spark, sf_dir):
    i = F.col("event_id") % 5
    role = values.timing_role(_by(i, " Client ", None, None, "оператор", "system"), _by(i, None, None, "AI", None, "x"), _by(i, None, "human", "human", None, None))
    return table(spark, sf_dir, "events").select("event_id", values.side(role).alias("side"))


@query("""SELECT event_id, '[{"function":{"name":"find","arguments":"{\\"type\\":\\"' || event_type || '\\",\\"deep\\":[{\\"x\\":1}]}"},"id":"c' || event_id || '","type":"function"}]' AS shown FROM events""".replace("\\\\", "\\"))
def shown_tool_calls(spark, sf_dir):
    """Calls with wrapped arguments and block ids at any depth."""
    inner = F.concat(F.lit('{"tool_arguments": {"block_id": 1, "type": "'), F.col("event_type"), F.lit('", "deep": [{"block_id": 2, "x": 1}]}}'))
    quoted = F.replace(inner, F.lit('"'), F.lit('\\"'))
    call = F.concat(F.lit('[{"function": {"name": "find", "arguments": "'), quoted, F.lit('"}, "id": "c'), F.col("event_id").cast("string"), F.lit('", "noise": 5}]'))
    return table(spark, sf_dir, "events").select("event_id", tools.calls_for_display(call).alias("shown"))


@query("""SELECT event_id, event_type AS name, '{"description":"d"}' AS arguments, 'call_' || substr(md5('v' || chr(0) || event_type || chr(0) || '{"description":"d"}'), 1, 24) AS id FROM events""")
def schema_calls(spark, sf_dir):
    schema = F.parse_json(F.concat(F.lit('{"type": "function", "function": {"name": "'), F.col("event_type"), F.lit('", "description": "d"}}')))
    return table(spark, sf_dir, "events").select("event_id", tools.schema_call(schema, "v").alias("c")).select("event_id", "c.*")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a=1,b=' || event_type ELSE 'a=1,b=' || event_type || ',c=3' END AS kept, CASE WHEN event_id % 3 = 0 THEN '[скрыто]' ELSE event_type END AS secret FROM events""")
def allowed_and_redacted(spark, sf_dir):
    """Variables by an allowlist (an empty one allows all), and secret keys whatever their spelling."""
    fields = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.col("event_type"), F.lit("c"), F.lit("3"))
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    kept = F.when(F.col("event_id") % 2 == 0, shown(values.allow_keys(fields, ["a", "b"]))).otherwise(shown(values.allow_keys(fields, [])))
    secret = values.redact(F.create_map(F.when(F.col("event_id") % 3 == 0, "API-Key").otherwise("kind"), F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", kept.alias("kept"), F.element_at(F.map_values(secret), 1).alias("secret"))


@query("SELECT event_id, event_id % 4 IN (0, 2) AS from_variables, event_id % 4 = 1 AS hidden FROM events")
def tool_event_sources(spark, sf_dir):
    event = F.parse_json(_by(F.col("event_id") % 4, '{"tool_event_source": "http_variables"}', '{"type": "tool_call", "tool_event_source": "tech_log"}', '{"type": "tool_call", "http_tool_variable_names": ["x"]}', '{"type": "message"}'))
    return table(spark, sf_dir, "events").select("event_id", tools.from_variables(event).alias("from_variables"), tools.hidden_event(event, True).alias("hidden"))


@query("""SELECT event_id, '{"a": "' || event_type || ' {missing} {x: 1}", "b": [1, "' || event_type || '"]}' AS filled FROM events""")
def filled_structures(spark, sf_dir):
    template = F.lit('{"a": "{type} {missing} {x: 1}", "b": [1, "{type}"]}')
    return table(spark, sf_dir, "events").select("event_id", tools.substitute(template, F.create_map(F.lit("type"), F.col("event_type"))).alias("filled"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'second' ELSE '' END AS persona FROM events")
def personas(spark, sf_dir):
    i = F.col("event_id") % 3
    return table(spark, sf_dir, "events").select("event_id", cases.persona(_by(i, F.concat(F.lit(" "), F.col("event_type")), " { user_prompt } ", None), _by(i, "other", "second", " ")).alias("persona"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS a, event_type AS b, '[Поле не найдено]' AS c, CASE WHEN event_id % 2 = 0 THEN event_type ELSE event_type || ' said' END AS pred, 'ref ' || event_type AS ref FROM events""")
def field_paths(spark, sf_dir):
    """Dotted paths through objects and lists, and the texts that a semantic comparison takes."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    v = F.parse_json(F.concat(F.lit('{"x": {"y": [0, '), k, F.lit(']}, "list": [{"t": "'), F.col("event_type"), F.lit('"}]}')))
    at = lambda p: F.coalesce(values.variant_text(v, values.json_path(p)), F.lit("[Поле не найдено]"))
    response = F.parse_json(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"response": " '), F.col("event_type"), F.lit('"}'))).otherwise("{}"))
    case = F.parse_json(F.concat(F.lit('{"subtopic": "ref '), F.col("event_type"), F.lit(' "}')))
    pred = scoring.semantic_prediction(response, F.concat(F.col("event_type"), F.lit(" said ")))
    return table(spark, sf_dir, "events").select("event_id", at("x.y.1").alias("a"), at("list.0.t").alias("b"), at("x.z").alias("c"), pred.alias("pred"), scoring.semantic_reference(case).alias("ref"))


# --- text fields


@query("""SELECT doc_id, CASE WHEN t = '' THEN '[пустой user]' ELSE substr(t, 1, 8000) END AS history_text, CASE WHEN trim(regexp_replace(text, '\\s', ' ', 'g')) = '' THEN '[пустой topic]' ELSE substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 1000) END AS field_text FROM
    (SELECT doc_id, coalesce(text, '') AS text, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(^|[^\\p{L}\\p{N}_])(none|null|nan|undefined|true|false)($|[^\\p{L}\\p{N}_])', '\\1 \\3', 'gi'), '([.!?;,])(\\S)', '\\1 \\2', 'g'), '\\s+', ' ', 'g')) AS t FROM documents)""")
def cluster_model_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.for_cluster_model(F.col("text"), "user").alias("history_text"), text.for_cluster_model(F.col("text"), "topic").alias("field_text"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'id' || event_id WHEN 2 THEN event_id::VARCHAR ELSE '?' END AS dialog_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '' ELSE event_type END AS cleaned, CASE event_id % 4 WHEN 0 THEN '(пусто)' WHEN 1 THEN '(пусто)' ELSE event_type END AS stat FROM events""")
def record_keys(spark, sf_dir):
    i, t = F.col("event_id") % 4, F.col("event_type")
    own = text.dialog_id(_by(i, F.concat(t, F.lit(" ")), " ", None, None), _by(i, "x", F.concat(F.lit("id"), F.col("event_id").cast("string")), "", " "), _by(i, None, None, F.col("event_id").cast("string"), None))
    return table(spark, sf_dir, "events").select("event_id", own.alias("dialog_id"), text.clean_metadata(_by(i, "None", " UNKNOWN ", t, F.concat(F.lit(" "), t))).alias("cleaned"), text.or_empty(_by(i, " ", None, t, F.concat(t, F.lit(" ")))).alias("stat"))


@query("""SELECT DISTINCT term, length(term) BETWEEN 2 AND 24 AND NOT regexp_matches(term, '^\\d+$') AND regexp_matches(term, '\\p{L}') AND lower(term) NOT IN ('the', 'is', 'are', 'to', 'of', 'in', 'on', 'at', 'for', 'with', 'and', 'or', 'not', 'this', 'that', 'it', 'you', 'your', 'i', 'we', 'they', 'none', 'null', 'nan', 'true', 'false', 'unknown', 'undefined', 'assistant', 'user', 'bot', 'system', 'a', 'an', 'was', 'were', 'be', 'empty', 'o') AS good
    FROM (SELECT unnest(string_split_regex(text, '[^a-zA-Z0-9]+')) AS term FROM documents)""")
def meaningful_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[^a-zA-Z0-9]+")).alias("term")).distinct()
    return d.select("term", text.meaningful_term(F.col("term")).alias("good"))


@query("""SELECT conv_id, 'dialog_id: ' || conv_id || chr(10) || 'suggestion: try' || chr(10) || string_agg(role || ': ' || regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) ORDER BY turn) AS full_text,
    string_agg(role || ': ' || regexp_replace(substr(text, 1, 40), '^\\s+|\\s+$', '', 'g'), chr(10) ORDER BY turn) FILTER (WHERE turn < 3) AS prompt FROM conversations GROUP BY conv_id""")
def dialog_prompts(spark, sf_dir):
    from .dialogs import dialogs

    d, h = dialogs(spark, sf_dir), F.col("history")
    return d.select("conv_id", text.dialog_full(F.col("conv_id").cast("string"), F.lit("try"), h).alias("full_text"), text.dialog_for_prompt(h, 40, 3).alias("prompt"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'second' ELSE '' END AS said, CASE event_id % 3 WHEN 0 THEN '👤 ' WHEN 1 THEN '🤖 ' ELSE '• ' END || event_type AS shown,
    CASE event_id % 3 WHEN 0 THEN '50.0–75.0 %' WHEN 1 THEN '50.0–75.0 %' ELSE '—' END AS interval FROM events""")
def turn_texts(spark, sf_dir):
    i, t = F.col("event_id") % 3, F.col("event_type")
    said = text.turn_text(_by(i, F.concat(F.lit(" "), t), " ", None), _by(i, "x", "second", ""))
    return table(spark, sf_dir, "events").select("event_id", said.alias("said"), text.turn_display(_by(i, "USER", "assistant", "tool"), t).alias("shown"), tools.interval_text(F.lit(0.5), F.when(i < 2, 0.75)).alias("interval"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '✅ · score=' || (event_id % 9) WHEN 1 THEN '❌ · failed: a; b' WHEN 2 THEN event_type ELSE '—' END AS shown FROM events""")
def eval_field_texts(spark, sf_dir):
    i = F.col("event_id")
    v = F.parse_json(_by(i % 4, F.concat(F.lit('{"passed": true, "score": '), (i % 9).cast("string"), F.lit("}")), '{"passed": false, "failed_checks": ["a", "b"]}', F.concat(F.lit('" '), F.col("event_type"), F.lit('"')), '" "'))
    return table(spark, sf_dir, "events").select("event_id", tools.eval_field_text(v).alias("shown"))


@query(r"""WITH w AS (SELECT coalesce(lang, '') AS lang, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents), c AS (SELECT lang, term, count(*) AS n FROM w WHERE length(term) >= 2 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS k FROM c), t AS (SELECT lang, term FROM r WHERE k <= 200), o AS (SELECT * FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE a.lang = b.lang AND length(b.term) > length(a.term) AND contains(b.term, a.term))),
    p AS (SELECT lang, '(' || string_agg(term, '|' ORDER BY length(term) DESC, term) || ')' AS pattern FROM o GROUP BY lang)
    SELECT doc_id, CASE WHEN pattern IS NULL THEN text ELSE regexp_replace(text, pattern, '**\1**', 'gi') END AS marked, coalesce(len(regexp_extract_all(text, pattern, 1, 'i')), 0)::INT AS n FROM documents d LEFT JOIN p ON p.lang = coalesce(d.lang, '')""")
def cluster_highlight(spark, sf_dir):
    """Each document with the 200 most frequent words of its language marked."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang")))
    words = d.select("lang", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).where(F.length("term") >= 2)
    best = ranks.rank_within(words.groupBy("lang", "term").agg(F.count("*").alias("n")), ["lang"], [F.col("n").desc(), "term"]).where("rank <= 200")
    terms = best.groupBy("lang").agg(F.to_json(F.array_sort(F.collect_list("term"))).alias("terms"))
    told = d.join(terms, "lang", "left").select("doc_id", highlight.marked_and_counted(F.col("text"), F.col("terms")).alias("told"))
    return told.select("doc_id", "told.marked", "told.n")


@query(r"""SELECT page_id, regexp_replace(html, '(article|title|the)', '**\1**', 'gi') AS marked FROM pages""")
def text_highlight(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.highlight(F.col("html"), ["the", "article", "title", "art", " "]).alias("marked"))


@query("""SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'шум (-1)' WHEN vec_id % 3 = 1 THEN label || ': L' || label ELSE label || ': Кластер ' || label END AS name,
    'd' || vec_id || ' · ' || repeat('x', 71) || '…' AS similar FROM embeddings""")
def cluster_names(spark, sf_dir):
    i, c = F.col("vec_id"), F.col("label")
    name = text.cluster_name(F.when(i % 3 == 0, -1).otherwise(c), F.when(i % 3 == 1, F.concat(F.lit("L"), c.cast("string"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", name.alias("name"), text.similarity_label(F.concat(F.lit("d"), i.cast("string")), F.lit(" "), F.repeat(F.lit("x"), F.lit(90))).alias("similar"))


@query("""SELECT label AS cluster_id, string_agg('w' || vec_id || ' (' || printf('%.3f', vec_id / 1000.0) || ')', ', ' ORDER BY vec_id) AS words FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) WHERE k <= 10 GROUP BY label""")
def stored_keywords(spark, sf_dir):
    """Keywords of clusters written as one JSON object and read back, bad entries dropped."""
    e = table(spark, sf_dir, "embeddings")
    words = e.groupBy(F.col("label").alias("cluster_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("term"), (F.col("vec_id") / 1000.0).alias("score")))).alias("w"))
    stored = text.words_to_json(words.select("cluster_id", F.transform("w", lambda x: F.struct(x["term"], x["score"])).alias("words")))
    spoiled = stored.select(F.concat(F.lit('{"x": [["a", 1]], "90": 5, "91": [["b"]], '), F.expr("substring(value, 2)")).alias("value"))
    return text.words_from_json(spoiled).select("cluster_id", text.format_terms(F.col("words")).alias("words"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'user: hello' || chr(10) || 'assistant: → find({"t":"' || event_type || '"}) → ?()' || chr(10) || 'tool: (нет данных)' ELSE 'assistant: ' || event_type || chr(10) || '→ f()' || chr(10) || 'find: ' || event_type END AS history FROM events""")
def message_histories(spark, sf_dir):
    """Chat messages of people, models and tools with their calls."""
    t = F.col("event_type")
    even = F.concat(F.lit('{"messages": [{"type": "human", "content": " hello "}, {"type": "ai", "content": "", "tool_calls": [{"name": "find", "args": {"t": "'), t, F.lit('"}}, {}]}, {"type": "tool", "content": " [] "}, {"type": "human", "content": " "}]}'))
    odd = F.concat(F.lit('{"messages": [{"type": "AI", "content": "'), t, F.lit('", "tool_calls": [{"name": "f", "args": {}}]}, {"type": "tool", "name": "find", "content": "'), t, F.lit('"}]}'))
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, even).otherwise(odd).alias("io"))
    return e.select("event_id", text.history_lines(F.transform(traces.messages_history(traces.messages_of(F.col("io"))), lambda x: F.struct(F.when((x["role"] == "tool") & x["content"].startswith("find"), "find").otherwise(x["role"]).alias("role"), F.regexp_replace(x["content"], "^(tool|find): ", "").alias("content")))).alias("history"))


@query("SELECT 'search' AS name, '● search' || chr(10) || '  Описание: Без описания' || chr(10) || '  Параметры:' || chr(10) || '{}' AS described, count(*) AS n FROM region")
def described_tools(spark, sf_dir):
    told = tools.tools_for_prompt([{"type": "function", "function": {"name": "search"}}, {"type": "other"}])
    return table(spark, sf_dir, "region").groupBy().agg(F.count("*").alias("n")).select(F.lit("search").alias("name"), F.lit(told).alias("described"), "n")


# --- predicates


@query("SELECT event_id::VARCHAR AS id FROM events WHERE event_type = 'click'")
def cases_with_tool(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    history = F.array(F.struct(F.lit("user").alias("role"), F.lit("CLICK: no").alias("content")), F.struct(F.lit("tool").alias("role"), F.concat(F.initcap("event_type"), F.lit(": done")).alias("content")))
    return traces.with_tool(e.select(F.col("event_id").cast("string").alias("id"), history.alias("history")), "cLiCk").select("id")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type = 'click' WHEN 1 THEN event_type <> 'view' WHEN 2 THEN false ELSE true END AS met, lower(event_type) LIKE '%c%' AS in_field, event_id % 2 = 0 AS compared FROM events")
def tool_goals_met(spark, sf_dir):
    i, t = F.col("event_id"), F.col("event_type")
    nothing = F.array().cast("array<string>")
    goals = _by(i % 4, F.array(F.lit("click"), F.lit("x")), F.array(F.lit("None")), F.array(F.lit("y")), F.array(t))
    called = _by(i % 4, F.array(t), F.when(t == "view", F.array(t)).otherwise(nothing), nothing, F.array(t, F.lit("z")))
    field = scoring.goal_in_field(F.array(F.lit("C"), F.lit(" ")), t)
    last = scoring.last_turn(F.array(F.struct(F.lit("assistant").alias("role"), F.lit("old").alias("content")), F.struct(F.lit(" Assistant ").alias("role"), F.when(i % 2 == 0, "yes").otherwise("no").alias("content")), F.struct(F.lit("user").alias("role"), F.lit("yes").alias("content"))))
    return table(spark, sf_dir, "events").select("event_id", scoring.tool_call_met(goals, called).alias("met"), field.alias("in_field"), (last["content"] == "yes").alias("compared"))


@query("SELECT event_id, (event_id % 10) || ',' || (10 + event_id % 10) AS blocks FROM events")
def block_numbers(spark, sf_dir):
    i = F.col("event_id") % 10
    said = F.concat(F.lit("at "), i.cast("string"), F.lit(", 00"), (i + 10).cast("string"), F.lit(" or 1234567890123, "), i.cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(scoring.block_ids(said), lambda x: x.cast("string")), ",").alias("blocks"))


@query("""SELECT '[{"type": "stringObject", "column": "metadata", "key": "k", "operator": "=", "value": "v"}, {"type": "string", "column": "name", "operator": "contains", "value": "part"}, {"type": "arrayOptions", "column": "tags", "operator": "any of", "value": ["t"]}]' AS filter, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') LIKE '%7%'""")
def pushed_filters(spark, sf_dir):
    """The filter that a server is asked for, and the texts within metadata that are looked for afterwards."""
    wanted = traces.parse_contains(["k:7"])
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.lit("n").alias("name"), F.array(F.lit("t")).alias("tags"), F.col("props").alias("metadata"))
    asked = json.dumps(json.loads(traces.advanced_filter({"k": "v"}, "part", "t")))
    return traces.post_filters(rows, metadata_contains=wanted).agg(F.count("*").alias("n")).select(F.lit(asked).alias("filter"), "n")
