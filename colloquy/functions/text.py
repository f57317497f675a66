"""Text functions over columns; ``history`` columns are array<struct<role, content, ...>>."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab

_WHITE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(c, _WHITE, "")


def field_key(c: Column) -> Column:
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def blank(c: Column) -> Column:
    return F.coalesce(strip(c.cast("string")) == "", F.lit(True))


def non_blank(c: Column) -> Column:
    """The trimmed text, null where nothing is left."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def sanitize(c: Column) -> Column:
    """Drop null-like words, put a space after punctuation, collapse white space."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?iU)\b(?:none|null|nan|undefined|true|false)\b", " ")
    c = F.regexp_replace(c, r"(?U)([.!?;,])([^\s])", "$1 $2")
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def role_of(turn: Column) -> Column:
    return F.lower(F.trim(F.coalesce(turn["role"], F.lit(""))))


def role_texts(history: Column, field: str) -> Column:
    """Non-blank contents of the turns of a role; all turns for ``dialog``."""
    keep = lambda t: ~blank(t["content"]) & (F.lit(True) if field == "dialog" else role_of(t) == field)
    texts = F.transform(F.filter(history, keep), lambda t: strip(t["content"]))
    return F.coalesce(texts, F.array().cast("array<string>"))


def cluster_text(history: Column, field: str = "dialog", turn: int = 0) -> Column:
    """Sanitized text of the dialog or of one role; ``turn`` picks the k-th of the filtered turns from 1."""
    texts = role_texts(history, field)
    raw = F.array_join(texts, " ") if turn <= 0 else F.coalesce(F.try_element_at(texts, F.lit(turn)), F.lit(""))
    return sanitize(raw)


def dedup_text(goals: Column) -> Column:
    return F.array_join(F.filter(F.transform(goals, field_key), lambda g: g != ""), "; ")


def for_embedding(c: Column, field: str, limit: int | None = None) -> Column:
    """First characters of the text; a placeholder for an empty one."""
    limit = limit or max_chars(field)
    return F.when(F.length(c) == 0, F.lit(vocab.EMPTY_FIELD.format(field=field))).otherwise(F.substring(c, 1, limit))


def for_cluster_model(raw: Column, field: str, limit: int | None = None) -> Column:
    return for_embedding(sanitize(raw) if field in vocab.HISTORY_FIELDS else field_key(raw), field, limit)


query_text = for_cluster_model


def max_chars(field: str) -> int:
    return vocab.HISTORY_CHARS if field in vocab.HISTORY_FIELDS else vocab.FIELD_CHARS


def validate_field(field: str) -> str:
    """A history field, or a record field of letters, digits, ``_``, ``-`` and ``.`` that isn't reserved."""
    field = (field or "").strip()
    if field in vocab.HISTORY_FIELDS:
        return field
    if not re.fullmatch(r"[\w.-]+", field) or field in vocab.RESERVED_FIELDS:
        raise ValueError(f"not a record field: {field!r}")
    return field


def resolve_field(selected: str, custom: str = "") -> str:
    return validate_field(custom if selected == "__custom__" else selected)


def dialog_id(*candidates: Column) -> Column:
    return F.coalesce(*(non_blank(c) for c in candidates), F.lit("?"))


def clean_metadata(c: Column) -> Column:
    key = field_key(c)
    return F.when(F.lower(key).isin(vocab.JUNK_TERMS), F.lit("")).otherwise(key)


def meaningful_term(c: Column) -> Column:
    t = strip(c)
    return (F.length(t).between(2, vocab.MAX_TERM) & ~F.contains(t, F.lit(" ")) & ~F.lower(t).isin(vocab.JUNK_TERMS + vocab.STOP_WORDS) & ~t.rlike(r"(?U)^\d+$") & t.rlike(r"\p{L}"))


def meaningful_label(c: Column) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    return (t != "") & ~t.rlike(r"(?iU)^тема\s*-?\d+$") & F.exists(F.split(t, ","), meaningful_term)


def keep_terms(pairs: Column, top: int = 10) -> Column:
    """array<struct<term, score>>: meaningful terms, best first, none inside a term already kept."""
    order = F.array_sort(F.filter(pairs, lambda p: meaningful_term(p["term"])), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["term"] < b["term"], -1).when(a["term"] > b["term"], 1).otherwise(0))
    start = F.array().cast("array<struct<term:string,score:double>>")
    typed = F.transform(order, lambda p: F.struct(p["term"].alias("term"), p["score"].cast("double").alias("score")))
    fold = lambda kept, p: F.when((F.size(kept) >= top) | F.exists(kept, lambda k: F.contains(F.lower(k["term"]), F.lower(p["term"]))), kept).otherwise(F.concat(kept, F.array(p)))
    return F.aggregate(typed, start, fold)


def history_lines(history: Column) -> Column:
    lines = F.transform(F.filter(history, lambda t: ~blank(t["content"])), lambda t: F.concat(F.coalesce(t["role"], F.lit("?")), F.lit(": "), strip(t["content"])))
    return F.array_join(lines, "\n")


def dialog_full(dialog: Column, suggestion: Column, history: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("dialog_id: "), dialog), F.when(~blank(suggestion), F.concat(F.lit("suggestion: "), suggestion)), history_lines(history))


def dialog_for_prompt(history: Column, limit: int = 1500, turns: int = 20) -> Column:
    cut = F.transform(F.slice(history, 1, turns), lambda t: F.struct(t["role"].alias("role"), F.substring(t["content"], 1, limit).alias("content")))
    return history_lines(cut)


def turn_text(*candidates: Column) -> Column:
    """First non-blank of content, text, message, body and the nested response."""
    return F.coalesce(*(non_blank(c) for c in candidates), F.lit(""))


def json_in_text(c: Column) -> Column:
    """The JSON object in a model's answer: a fenced block first, then from the first to the last brace."""
    raw = strip(F.coalesce(c, F.lit("")))
    fenced = F.regexp_extract(raw, r"(?is)```(?:json)?\s*(\{.*\})\s*```", 1)
    brace = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    is_object = lambda t: F.when(F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT"), t)
    return F.try_parse_json(F.coalesce(is_object(fenced), is_object(brace)))


def swap_roles(history: Column) -> Column:
    swap = lambda r: F.when(r == "user", "assistant").when(r == "assistant", "user").otherwise(r)
    return F.transform(history, lambda t: F.struct(swap(t["role"]).alias("role"), F.coalesce(t["content"].cast("string"), F.lit("")).alias("content")))


def highlight_terms(terms: Column) -> Column:
    """Distinct terms, longest first, without those inside a longer one."""
    order = F.array_sort(F.array_distinct(F.filter(F.transform(terms, strip), lambda t: t != "")), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    fold = lambda kept, t: F.when(F.exists(kept, lambda k: F.contains(F.lower(k), F.lower(t))), kept).otherwise(F.concat(kept, F.array(t)))
    return F.aggregate(order, F.array().cast("array<string>"), fold)


def _any_of(terms: list[str]) -> str:
    kept: list[str] = []
    for t in sorted({t.strip() for t in terms if t.strip()}, key=lambda t: (-len(t), t)):
        if not any(t.lower() in k.lower() for k in kept):
            kept.append(t)
    return "|".join("\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E" for t in kept)


def highlight(c: Column, terms: list[str], left: str = "**", right: str = "**") -> Column:
    """Mark the terms, longest first, in one pass and whatever their case."""
    pattern = _any_of(terms)
    return F.regexp_replace(c, f"(?iu)({pattern})", f"{left}$1{right}".replace("*", "\\*")) if pattern else c


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def highlight_html(c: Column, terms: list[str]) -> Column:
    safe = [t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#x27;") for t in terms]
    pattern = _any_of(safe)
    out = escape_html(c)
    out = F.regexp_replace(out, f"(?iu)({pattern})", "<mark>$1</mark>") if pattern else out
    return F.replace(out, F.lit("\n"), F.lit("<br>"))


def format_terms(pairs: Column, most: int = 10) -> Column:
    return F.array_join(F.transform(F.slice(pairs, 1, most), lambda p: F.format_string("%s (%.3f)", p["term"], p["score"].cast("double"))), ", ")


def words_to_json(words: DataFrame) -> DataFrame:
    """One row, value: the words (term, score) of all clusters as a JSON object. There is an entry per cluster."""
    pairs = F.transform("words", lambda p: F.concat(F.lit("["), F.regexp_replace(F.to_json(F.array(p["term"])), r"^\[|\]$", ""), F.lit(","), p["score"].cast("double").cast("string"), F.lit("]")))
    entry = F.concat(F.lit('"'), F.col("cluster_id").cast("string"), F.lit('":['), F.array_join(pairs, ","), F.lit("]"))
    return words.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(entry)), ","), F.lit("}")).alias("value"))


def words_from_json(stored: DataFrame) -> DataFrame:
    """cluster_id, words of such objects; keys that aren't numbers, values that aren't lists and short pairs go."""
    fields = F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>")
    rows = stored.select(F.explode(fields).alias("key", "list")).select(F.col("key").try_cast("int").alias("cluster_id"), F.try_variant_get("list", "$", "array<variant>").alias("list"))
    pair = lambda p: F.struct(F.try_variant_get(p, "$[0]", "string").alias("term"), F.try_variant_get(p, "$[1]", "double").alias("score"))
    words = F.filter(F.transform("list", pair), lambda p: p["term"].isNotNull() & p["score"].isNotNull())
    return rows.where("cluster_id is not null and list is not null").select("cluster_id", words.alias("words")).where(F.size("words") > 0)


def cluster_name(cluster: Column, label: Column) -> Column:
    named = F.concat(cluster.cast("string"), F.lit(": "), F.coalesce(non_blank(label), F.concat(F.lit("Кластер "), cluster.cast("string"))))
    return F.when(cluster == vocab.NOISE, F.lit("шум (-1)")).when(cluster == vocab.NO_EMBEDDING, F.lit("нет эмбеддинга (-2)")).otherwise(named)


def preview(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def similarity_label(dialog: Column, label: Column, text: Column, most: int = 72) -> Column:
    return F.concat_ws(" · ", dialog, non_blank(label), non_blank(preview(text, most)))


def or_empty(c: Column) -> Column:
    return F.coalesce(non_blank(c), F.lit(vocab.EMPTY))


def goals_text(goals: Column, sep: str = ", ") -> Column:
    cleaned = F.filter(F.transform(goals, field_key), lambda g: g != "")
    return F.coalesce(F.nullif(F.array_join(cleaned, sep), F.lit("")), F.lit(vocab.NO_GOAL))


def first_goal(goals: Column) -> Column:
    return F.coalesce(non_blank(F.try_element_at(goals, F.lit(1))), F.lit(vocab.NO_GOAL))


def turn_display(role: Column, content: Column) -> Column:
    icon = F.when(F.lower(role) == "user", "👤").when(F.lower(role) == "assistant", "🤖").otherwise("•")
    return F.concat_ws(" ", icon, F.coalesce(content, F.lit("")))


def transcript(history: Column) -> Column:
    """Role-labelled transcript for a judge; an empty assistant turn is named as such."""
    label = lambda r: F.when(r == "user", "USER").when(r == "assistant", "ASSISTANT").otherwise(F.upper(r))
    line = lambda t: F.concat(label(role_of(t)), F.lit(": "), F.when(blank(t["content"]) & (role_of(t) == "assistant"), F.lit("[пустой ответ]")).otherwise(field_key(t["content"])))
    return F.array_join(F.transform(history, line), "\n")


def template(text: str, variables: Column) -> Column:
    """Fill ``{name}`` from a map; unknown names become empty and other braces stay. Split at plan time."""
    parts, at = [], 0
    for m in re.finditer(r"\{([A-Za-z_]\w*)\}", text):
        parts += [F.lit(text[at : m.start()]), F.coalesce(F.try_element_at(variables, F.lit(m[1])), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))
