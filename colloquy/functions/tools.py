"""Tool calls and tool descriptions. Nested JSON of any depth goes through Arrow batches of JSON texts."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import is_object, variant_text


def _over_json(fn: Callable[[object], object]):
    """Arrow function from JSON text to JSON text; text that isn't JSON gives null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else json.dumps(fn(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        return texts.map(one)

    return run


def plain_arguments(value: object) -> object:
    """Arguments without a lone ``tool_arguments`` wrapper and without ``block_id`` at any depth."""
    match value:
        case {"tool_arguments": dict() | list() as inner} if len(value) == 1:
            return plain_arguments(inner)
        case dict():
            return {k: plain_arguments(v) for k, v in value.items() if k != "block_id"}
        case list():
            return [plain_arguments(v) for v in value]
    return value


def _shown(call: object) -> object:
    if not isinstance(call, dict):
        return call
    function = call.get("function")
    if not isinstance(function, dict):
        return {k: v for k, v in call.items() if k in {"function", "id", "type"}}
    raw = function.get("arguments", "{}")
    if isinstance(raw, str):
        try:
            raw = json.loads(raw) if raw.strip() else {}
        except ValueError:
            return {"function": {"name": function.get("name"), "arguments": raw}, "id": call.get("id"), "type": call.get("type", "function")}
    text = json.dumps(plain_arguments({} if raw is None else raw), ensure_ascii=False, separators=(",", ":"))
    return {"function": {"name": function.get("name"), "arguments": text}, "id": call.get("id"), "type": call.get("type", "function")}


def calls_for_display(calls: Column) -> Column:
    """JSON list of tool calls, reduced to function, id and type with canonical arguments."""
    return _over_json(lambda v: [] if v is None else [_shown(c) for c in v] if isinstance(v, list) else v)(calls)


def substitute(template: Column, variables: Column) -> Column:
    """Fill ``{name}`` in every text of a JSON value from a map; other braces stay."""
    import re

    @F.pandas_udf("string")
    def run(texts: pd.Series, maps: pd.Series) -> pd.Series:
        def fill(v, names):
            if isinstance(v, str):
                return re.sub(r"\{([A-Za-z_]\w*)\}", lambda m: names.get(m[1], m[0]), v)
            if isinstance(v, dict):
                return {k: fill(x, names) for k, x in v.items()}
            return [fill(x, names) for x in v] if isinstance(v, list) else v

        return pd.Series([None if t is None else json.dumps(fill(json.loads(t), dict(m or {})), ensure_ascii=False) for t, m in zip(texts, maps)], dtype=object)

    return run(template, variables)


def schema_call(schema: Column, variable: str = "") -> Column:
    """A tool definition (VARIANT) as a call: struct<name, arguments, id>; null without a name.

    The id is derived from variable, name and arguments, so the same definition has the same id.
    """
    name = F.nullif(variant_text(schema, "$.function.name"), F.lit(""))
    fields = F.map_filter(F.try_variant_get(schema, "$.function", "map<string,variant>"), lambda k, v: k != "name")
    args = F.to_json(fields)
    key = F.concat(F.lit(variable), F.lit("\x00"), name, F.lit("\x00"), args)
    call = F.struct(name.alias("name"), args.alias("arguments"), F.concat(F.lit("call_"), F.substring(F.md5(key), 1, 24)).alias("id"))
    return F.when(name.isNotNull() & is_object(F.try_variant_get(schema, "$.function", "variant")), call)


def from_variables(event: Column) -> Column:
    """Whether a timeline event (VARIANT) stands for a call made from scenario variables."""
    source = F.coalesce(F.try_variant_get(event, "$.tool_event_source", "string"), F.lit(""))
    legacy = (F.try_variant_get(event, "$.type", "string") == "tool_call") & (source != "tech_log") & F.try_variant_get(event, "$.http_tool_variable_names", "variant").isNotNull()
    return (source == "http_variables") | F.coalesce(legacy, F.lit(False))


def hidden_event(event: Column, variables_shown: bool) -> Column:
    """Log events of tools are hidden while the calls from variables are shown."""
    kinds = F.coalesce(F.try_variant_get(event, "$.type", "string").isin("tool_call", "tool_schema", "tool_message"), F.lit(False))
    return F.lit(variables_shown) & (F.coalesce(F.try_variant_get(event, "$.tool_event_source", "string"), F.lit("")) == "tech_log") & kinds


def tools_for_prompt(tools: list[dict]) -> str:
    """Bullet text of function tools, made once per plan."""
    rows = []
    for tool in tools or []:
        if tool.get("type") == "function":
            f = tool.get("function", {})
            params = json.dumps(f.get("parameters", {}), ensure_ascii=False, indent=2)
            rows.append(f"● {f.get('name', 'unknown')}\n  Описание: {f.get('description', 'Без описания')}\n  Параметры:\n{params}")
    return "\n\n".join(rows) if tools else "Нет доступных инструментов."


def eval_field_text(v: Column) -> Column:
    """A judge's field for people: a sign, score and failed checks for a rubric, else its text."""
    rubric = is_object(v) & F.coalesce(F.try_variant_get(v, "$.passed", "variant"), F.try_variant_get(v, "$.score", "variant"), F.try_variant_get(v, "$.failed_checks", "variant")).isNotNull()
    sign = F.when(F.coalesce(F.try_variant_get(v, "$.passed", "boolean"), F.lit(False)), "✅").otherwise("❌")
    failed = F.array_join(F.try_variant_get(v, "$.failed_checks", "array<string>"), "; ")
    parts = F.concat_ws(" · ", sign, F.concat(F.lit("score="), variant_text(v, "$.score")), F.when(failed != "", F.concat(F.lit("failed: "), failed)))
    return F.when(rubric, parts).otherwise(F.coalesce(F.nullif(F.trim(variant_text(v)), F.lit("")), F.lit("—")))


def interval_text(low: Column, high: Column, percent: bool = True) -> Column:
    text = F.format_string("%.1f–%.1f %%", low * 100, high * 100) if percent else F.format_string("%.4f–%.4f", low, high)
    return F.when(low.isNull() | high.isNull(), F.lit("—")).otherwise(text)
