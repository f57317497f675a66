"""JSONL and JSON scans and writers. Lines are numbered within their file from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import strip
from ..functions.values import goals_list, is_object, kind, parse_context, redact_json, variant_text


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, value of every physical line.

    A large file is read in blocks by many tasks. Ids that grow by one within a task number the lines
    of a block; the lines of the blocks before come from a table with a row per block.
    """
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    rows = spark.read.text(path).select(*block, F.monotonically_increasing_id().alias("id"), "value")
    blocks = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", (before + 1 - F.col("first")).alias("shift"))
    return rows.join(blocks, ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("line_no"), "value")


def lines_of(spark: SparkSession, text: str) -> DataFrame:
    """The lines of one text, for small inputs."""
    rows = [(i, x) for i, x in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n"), 1)]
    return spark.createDataFrame(rows, "line_no int, value string").withColumn("file", F.lit(""))


def parsed(lines: DataFrame, comments: bool = True) -> DataFrame:
    """line_no, value, obj (VARIANT), error of lines that aren't blank or, with ``comments``, start with #."""
    t = strip(F.col("value"))
    rows = lines.where(t != "")
    rows = rows.where(~t.startswith("#")) if comments else rows
    obj = F.try_parse_json(t)
    error = F.when(obj.isNull(), F.lit("invalid JSON")).when(~is_object(obj), F.lit("not an object"))
    return rows.select("file", "line_no", "value", obj.alias("obj"), error.alias("error"))


def strict(lines: DataFrame) -> DataFrame:
    """All objects; the first bad line of a file raises with its number."""
    rows = parsed(lines)
    bad = rows.where("error is not null").groupBy("file").agg(F.min(F.struct("line_no", "error")).alias("bad"))
    checked = rows.join(F.broadcast(bad), "file", "left")  # a row per file
    message = F.concat(F.lit("line "), F.col("bad.line_no").cast("string"), F.lit(": "), F.col("bad.error"))
    return checked.select("file", "line_no", F.when(F.col("bad").isNotNull(), F.raise_error(message).cast("variant")).otherwise(F.col("obj")).alias("obj"))


def lenient(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, one row with the number of bad lines)."""
    rows = parsed(lines)
    return rows.where("error is null").select("file", "line_no", "obj"), rows.agg(F.count("error").alias("bad"))


def json_array(texts: DataFrame, value: str = "value") -> DataFrame:
    """Rows of the objects of a JSON array, or the object itself; other elements are dropped."""
    v = F.try_parse_json(F.col(value))
    items = F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).when(is_object(v), F.array(v)).otherwise(F.array().cast("array<variant>"))
    rows = texts.select(F.posexplode(items).alias("pos", "obj"))
    return rows.where(is_object(F.col("obj"))).select((F.col("pos") + 1).alias("line_no"), "obj")


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def cases(rows: DataFrame) -> DataFrame:
    """line_no, dialog_id, goals, context (VARIANT object), obj, error from parsed objects.

    Goals become a list of texts, null goals an empty one; a context must be an object or a JSON
    object in a string. A missing id is made from file and line, so that a rerun makes it again.
    """
    obj = F.col("obj")
    context = parse_context(_get(obj, "$.context"))
    goals = goals_list(_get(obj, "$.goals"))
    missing = context.isNull() | (kind(context) == "VOID")
    error = F.coalesce(F.col("error") if "error" in rows.columns else F.lit(None).cast("string"), F.when(goals.isNull(), F.lit("goals: neither text nor list")), F.when(~missing & ~is_object(context), F.lit("context: not an object")))
    made = F.concat(F.lit("case-"), F.substring(F.md5(F.concat_ws("|", F.col("file"), F.col("line_no").cast("string"))), 1, 24))
    own = F.nullif(strip(F.coalesce(variant_text(obj, "$.dialog_id"), variant_text(obj, "$.id"), F.lit(""))), F.lit(""))
    return rows.select("file", "line_no", F.coalesce(own, made).alias("dialog_id"), goals.alias("goals"), F.when(missing, F.parse_json(F.lit("{}"))).otherwise(context).alias("context"), "obj", error.alias("error"))


def first_error(checked: DataFrame) -> DataFrame:
    return checked.where("error is not null").groupBy().agg(F.min(F.struct("line_no", "error")).alias("e")).select("e.line_no", "e.error")


TURN = "array<struct<role:string,content:variant,text:string,tool_calls:variant>>"


def history(obj: Column) -> Column:
    """Turns of history or messages, in the record or its context; a JSON array in a string is read too."""
    def turns(path: str) -> Column:
        v = _get(obj, path)
        inner = F.when(kind(v) == "STRING", F.try_parse_json(F.try_variant_get(v, "$", "string"))).otherwise(v)
        got = F.filter(F.try_variant_get(inner, "$", "array<variant>"), is_object)
        return F.when(F.size(got) > 0, got)

    found = F.coalesce(turns("$.history"), turns("$.messages"), turns("$.context.history"), turns("$.context.messages"), F.array().cast("array<variant>"))
    return F.transform(found, lambda t: F.struct(F.coalesce(F.try_variant_get(t, "$.role", "string"), F.lit("")).alias("role"), F.coalesce(variant_text(t, "$.content"), F.lit("")).alias("content"), t.alias("turn")))


def tool_calls(turn: Column) -> Column:
    """Tool calls of a message, of its full response or of the response inside, always as a list."""
    def listed(path: str) -> Column:
        v = _get(turn, path)
        return F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).when(is_object(v), F.array(v))

    some = lambda p: F.when(F.size(listed(p)) > 0, listed(p))
    return F.coalesce(some("$.tool_calls"), some("$.full_response.tool_calls"), some("$.full_response.response.tool_calls"), F.array().cast("array<variant>"))


def timeline(records: DataFrame, noise=None) -> DataFrame:
    """dialog_id, turn_idx, type (message or tool_call), role, content of dialogs that keep an event.

    ``noise`` maps (role, content) columns to a condition under which a message is dropped.
    """
    obj = F.col("obj")
    rows = records.select(F.coalesce(variant_text(obj, "$.dialog_id"), variant_text(obj, "$.id"), F.lit("?")).alias("dialog_id"), F.posexplode(history(obj)).alias("turn_idx", "t"))
    is_call = F.size(tool_calls(F.col("t.turn"))) > 0
    events = rows.select("dialog_id", "turn_idx", F.when(is_call, "tool_call").otherwise("message").alias("type"), F.when(is_call, "assistant").otherwise(F.col("t.role")).alias("role"), F.when(is_call, "").otherwise(F.col("t.content")).alias("content"))
    return events.where((F.col("type") == "tool_call") | ~F.coalesce(noise(F.col("role"), F.col("content")), F.lit(False))) if noise else events


def turns_table(events: DataFrame) -> DataFrame:
    return events.where((F.col("type") == "message") & (strip("content") != "")).select("dialog_id", "turn_idx", "role", "content")


def to_jsonl(records: DataFrame, path: str) -> None:
    """Compact JSON lines with null fields kept."""
    records.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def to_jsonl_with_report(records: DataFrame, report: list[str], path: str) -> None:
    """JSON lines, then the report as comment lines that the scans skip."""
    body = records.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    notes = records.sparkSession.createDataFrame([("",), *((f"# {x}",) for x in report)], "value string").coalesce(1)
    body.unionByName(notes).write.mode("overwrite").text(path)


def annotation_records(results: DataFrame) -> DataFrame:
    """dialog_id, scenario_id, goals, history (role, content, tool_calls), context for annotators.

    Missing ids are empty; goals come from goals, else goals_text, else one empty goal. Tool calls
    (JSON texts) are a turn's own, else those of its full response; an empty list counts as none.
    Secrets of the context (JSON text) are redacted, and columns that the results lack are null.
    """
    def col(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in results.columns else F.lit(None).cast(kind)

    goals = F.coalesce(F.when(F.size(col("goals", "array<string>")) > 0, col("goals", "array<string>")), F.when(strip(col("goals_text")) != "", F.array(strip(col("goals_text")))), F.array(F.lit("")))
    inner = results.schema["history"].dataType.elementType.names

    def turn(t: Column) -> Column:
        own = t["tool_calls"] if "tool_calls" in inner else F.lit(None).cast("string")
        answer = F.get_json_object(t["full_response"], "$.tool_calls") if "full_response" in inner else F.lit(None).cast("string")
        calls = F.coalesce(*(F.when(~F.trim(c).isin("", "[]", "{}", "null"), c) for c in (own, answer)))
        return F.struct(t["role"].alias("role"), F.coalesce(t["content"].cast("string"), F.lit("")).alias("content"), calls.alias("tool_calls"))

    context = F.nullif(strip(redact_json(col("context"))), F.lit(""))
    return results.select(F.coalesce(col("dialog_id"), F.lit("")).alias("dialog_id"), F.coalesce(col("scenario_id"), F.lit("")).alias("scenario_id"), goals.alias("goals"), F.transform("history", turn).alias("history"), F.nullif(context, F.lit("{}")).alias("context"))


def merged_labels(items: DataFrame, legacy: list[str]) -> DataFrame:
    """Items with human_labels that hold the older label fields, which are dropped."""
    from ..functions.values import human_labels

    present = [c for c in legacy if c in items.columns]
    return items.withColumn("human_labels", human_labels(F.col("human_labels"), [F.col(c).cast("string") for c in present])).drop(*present)


def annotators(items: DataFrame) -> DataFrame:
    """Distinct raters, by name, the unnamed one last."""
    names = items.select(F.explode(F.map_keys("human_labels")).alias("rater")).distinct()
    return names.orderBy(F.col("rater") == vocab.UNNAMED_RATER, F.lower("rater"))


def row_index(records: DataFrame, order: list[str]) -> DataFrame:
    """Adds row_idx from 0 in the given order."""
    from ..operators.ranks import rank_within

    return rank_within(records, [], order, "row_idx").withColumn("row_idx", F.col("row_idx") - 1)
