"""Coercion and normalisation of loosely typed values; ``v`` columns are VARIANT."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import non_blank, strip


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, ... of a VARIANT, upper case; VOID for JSON null."""
    return F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def variant_text(v: Column, path: str = "$") -> Column:
    """Text of a value: strings as they are, everything else as canonical JSON."""
    got = F.try_variant_get(v, path, "variant") if path != "$" else v
    # a scalar has a text of its own; what is left is an object, a list or null
    return F.coalesce(F.try_variant_get(v, path, "string"), F.when(~F.is_variant_null(got), F.to_json(got)))


def json_path(dotted: str) -> str:
    """``a.0.b`` as a JSON path."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in dotted.split(".") if p)


def as_object(v: Column) -> Column:
    """An object, or the object in a JSON string; anything else an empty object."""
    inner = F.try_parse_json(F.try_variant_get(v, "$", "string"))
    return F.when(is_object(v), v).when(is_object(inner), inner).otherwise(F.parse_json(F.lit("{}")))


def parse_context(v: Column) -> Column:
    """A context that is a JSON object in a string becomes that object; else it stays."""
    inner = F.try_parse_json(F.try_variant_get(v, "$", "string"))
    return F.when((kind(v) == "STRING") & is_object(inner), inner).otherwise(v)


def goals_list(v: Column) -> Column:
    """null -> [], text -> [trimmed] or [], list -> trimmed non-blank texts; other types null."""
    items = F.try_variant_get(v, "$", "array<variant>")
    texts = F.filter(F.transform(items, lambda x: strip(F.coalesce(variant_text(x), F.lit("")))), lambda t: t != "")
    one = strip(F.try_variant_get(v, "$", "string"))
    none = F.array().cast("array<string>")
    return F.when(v.isNull() | (kind(v) == "VOID"), none).when(kind(v) == "STRING", F.when(one == "", none).otherwise(F.array(one))).when(kind(v) == "ARRAY", texts)


def metric(c: Column) -> Column:
    """Text or number to a finite double; a decimal comma is read as a point."""
    x = F.regexp_replace(strip(c.cast("string")), ",", ".").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def metric_variant(v: Column) -> Column:
    """As ``metric``; booleans and nested values are no numbers."""
    return F.when(kind(v).isin("BOOLEAN", "OBJECT", "ARRAY", "VOID"), F.lit(None).cast("double")).otherwise(metric(F.try_variant_get(v, "$", "string")))


def non_negative(c: Column) -> Column:
    return F.when(c >= 0, c)


def positive_int(*candidates: Column) -> Column:
    ok = [F.when(c.try_cast("int") > 0, c.try_cast("int")) for c in candidates]
    return F.coalesce(*ok, F.lit(0))


def integral(c: Column) -> Column:
    """Numeric text or integral number to a long, else null."""
    x = metric(c)
    return F.when(x == F.floor(x), x.cast("long"))


def words(c: Column, true: list[str], false: list[str]) -> Column:
    t = F.lower(strip(c.cast("string")))
    return F.when(t.isin(true), F.lit(True)).when(t.isin(false), F.lit(False))


def criterion_passed(v: Column) -> Column:
    """A judge's criterion: boolean, exactly 1 or 0, {passed}, or a word; else null."""
    number = F.try_variant_get(v, "$", "double")
    nested = F.coalesce(F.try_variant_get(v, "$.passed", "boolean"), F.lit(False))
    return (
        F.when(kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind(v) == "STRING", words(F.try_variant_get(v, "$", "string"), vocab.CRITERION_TRUE, vocab.CRITERION_FALSE))
        .when(is_object(v) & F.try_variant_get(v, "$.passed", "variant").isNotNull(), nested)
        .when(number == 1, F.lit(True)).when(number == 0, F.lit(False))
    )


def criterion_text(c: Column) -> Column:
    return words(c, vocab.CRITERION_TRUE, vocab.CRITERION_FALSE)


def binary_label(c: Column) -> Column:
    """A rater's label as boolean; any number but 0 is true, an unknown word null."""
    x = c.try_cast("double")
    return F.coalesce(words(c, vocab.LABEL_TRUE, vocab.LABEL_FALSE), F.when(x.isNotNull(), x != 0))


def ordinal_label(c: Column, low: int = 1, high: int = 5) -> Column:
    x = F.floor(F.abs(c.try_cast("double"))).cast("int") * F.signum(c.try_cast("double")).cast("int")
    return F.when(x.between(low, high), x)


def categorical_label(c: Column, categories: list[str]) -> Column:
    t = strip(c.cast("string"))
    out = F.when(t.isin(categories), t)
    for x in categories:
        out = out.when(F.lower(t) == x.lower(), F.lit(x))
    return out


def multi_label(labels: Column, criteria: list[str]) -> Column:
    """map<string,string> of criteria to labels -> map<string,int>; null unless every criterion has one."""
    each = [binary_label(F.try_element_at(labels, F.lit(c))) for c in criteria]
    ok = each[0].isNotNull()
    for e in each[1:]:
        ok = ok & e.isNotNull()
    return F.when(ok, F.create_map(*[x for c, e in zip(criteria, each) for x in (F.lit(c), e.cast("int"))]))


def human_labels(labels: Column, legacy: list[Column]) -> Column:
    """Labels by rater; the first legacy field stands under the unnamed rater unless it has one."""
    named = F.coalesce(F.map_filter(labels, lambda k, v: ~F.coalesce(strip(k) == "", F.lit(True))), F.create_map().cast("map<string,string>"))
    old = F.coalesce(*legacy) if legacy else F.lit(None).cast("string")
    add = old.isNotNull() & ~F.map_contains_key(named, vocab.UNNAMED_RATER)
    return F.when(add, F.map_concat(named, F.create_map(F.lit(vocab.UNNAMED_RATER), old))).otherwise(named)


def flatten_context(context: Column) -> Column:
    """VARIANT object -> map<string,string>: nested values as JSON, null as empty."""
    fields = F.try_variant_get(context, "$", "map<string,variant>")
    return F.transform_values(F.coalesce(fields, F.create_map().cast("map<string,variant>")), lambda k, v: F.coalesce(variant_text(v), F.lit("")))


def merge_maps(base: Column, over: Column) -> Column:
    """Keys of ``over`` win."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)


def rename_keys(fields: Column, names: dict[str, str] | None) -> Column:
    """Project a map through ``{source: target}``; None keeps it."""
    if names is None:
        return fields
    kept = F.map_filter(fields, lambda k, v: k.isin(list(names)))
    return F.transform_keys(kept, lambda k, v: F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), k))


def field_map(raw: str) -> dict[str, str] | None:
    """A mapping of field names in JSON; anything but an object of texts gives None."""
    try:
        found = json.loads(raw or "")
    except ValueError:
        return None
    ok = isinstance(found, dict) and all(isinstance(v, str) and v.strip() for v in found.values())
    return {k.strip(): v.strip() for k, v in found.items() if k.strip()} if ok else None


def whole_numbers(fields: Column, names: list[str]) -> Column:
    """A map as a JSON object whose named fields, where they are whole numbers, stand as numbers."""
    def entry(x: Column) -> Column:
        number = F.when(x["key"].isin(names), integral(x["value"]).cast("string"))
        quote = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
        return F.concat(quote(x["key"]), F.lit(":"), F.coalesce(number, quote(x["value"]), F.lit("null")))

    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(fields)), entry), ","), F.lit("}"))


def allow_keys(fields: Column, allowed: list[str]) -> Column:
    return F.map_filter(fields, lambda k, v: k.isin(allowed)) if allowed else fields


def key_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def redact(fields: Column) -> Column:
    return F.transform_values(fields, lambda k, v: F.when(key_name(k).isin(vocab.SECRET_KEYS), F.lit(vocab.REDACTED)).otherwise(v))


def redact_json(c: Column) -> Column:
    """Redact values of secret keys anywhere in a JSON text (strings, numbers and literals)."""
    names = "|".join("[^A-Za-z0-9\"]*".join(k) for k in vocab.SECRET_KEYS)
    return F.regexp_replace(c, rf'(?i)("[^A-Za-z0-9"]*(?:{names})[^A-Za-z0-9"]*"\s*:\s*)(?:"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|true|false|null)', '$1"' + vocab.REDACTED + '"')


def utc_plus_5(c: Column) -> Column:
    """ISO text to ``YYYY-MM-DD HH:MM:SS (UTC+5)``; null a dash, unreadable text as it is."""
    ts = F.try_to_timestamp(c)
    return F.when(c.isNull() | (c == ""), F.lit("—")).otherwise(F.coalesce(F.concat(F.date_format(F.from_utc_timestamp(ts, "+05:00"), "yyyy-MM-dd HH:mm:ss"), F.lit(" (UTC+5)")), c))


def epoch_seconds(c: Column) -> Column:
    """Number or ISO text (naive: UTC) to seconds."""
    return F.coalesce(metric(c), F.unix_micros(F.try_to_timestamp(strip(c.cast("string")))) / 1e6)


def timing_role(role: Column, speaker: Column | None = None, message_type: Column | None = None) -> Column:
    low = lambda c: F.lower(non_blank(c))
    names = F.create_map(*[F.lit(x) for p in vocab.MESSAGE_ROLES.items() for x in p])
    parts = [low(role)] + ([low(speaker)] if speaker is not None else [])
    if message_type is not None:
        parts.append(F.coalesce(F.try_element_at(names, low(message_type)), low(message_type)))
    return F.coalesce(*parts, F.lit(""))


def side(role: Column) -> Column:
    return F.when(role.isin(vocab.USER_ROLES), "user").when(role.isin(vocab.ASSISTANT_ROLES), "assistant")
