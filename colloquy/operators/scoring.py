"""Scoring of evaluation runs: criteria, repeats, tool calls, similarity and custom predicates."""

from __future__ import annotations

import ast
import operator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import strip
from ..functions.values import criterion_passed, json_path, variant_text


def scoring_fields(fields: str | list[str]) -> list[str]:
    names = [f.strip() for f in fields.split(",")] if isinstance(fields, str) else fields
    return [f for f in names if f and f not in vocab.META_FIELDS]


def criterion_scores(parsed: Column, fields: str | list[str]) -> Column:
    """VARIANT answer of a judge -> map<string, boolean>; a missing criterion has failed."""
    pairs = [x for f in scoring_fields(fields) for x in (F.lit(f), F.coalesce(criterion_passed(F.try_variant_get(parsed, f"$.{f}", "variant")), F.lit(False)))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,boolean>")


def all_passed(scores: Column) -> Column:
    return (F.size(scores) > 0) & F.forall(F.map_values(scores), lambda x: x)


def judge_result(results: DataFrame, answer: str, fields: str | list[str]) -> DataFrame:
    """Adds criterion_scores, criterion_accuracy, result and accuracy from the judge's text."""
    from ..functions.text import json_in_text

    rows = results.withColumn("parsed", json_in_text(F.col(answer)))
    rows = rows.withColumn("criterion_scores", criterion_scores(F.col("parsed"), fields))
    said = F.lower(F.coalesce(F.col(answer), F.lit("")))
    guess = F.contains(said, F.lit("true")) | said.rlike(r"вердикт:\s*да")
    rows = rows.withColumn("result", F.when(F.col("parsed").isNull(), guess).otherwise(all_passed(F.col("criterion_scores"))))
    return rows.withColumn("criterion_accuracy", F.transform_values("criterion_scores", lambda k, v: v.cast("double"))).withColumn("accuracy", F.col("result").cast("double")).drop("parsed")


def force_fail(results: DataFrame, condition: Column, fields: str | list[str]) -> DataFrame:
    """Rows under the condition fail with all their criteria."""
    zero = F.create_map(*[x for f in scoring_fields(fields) for x in (F.lit(f), F.lit(0.0))])
    return results.withColumn("criterion_accuracy", F.when(condition, zero).otherwise(F.col("criterion_accuracy"))).withColumn("accuracy", F.when(condition, F.lit(0.0)).otherwise(F.col("accuracy")))


def criterion_means(results: DataFrame, fields: list[str]) -> DataFrame:
    """criterion, accuracy: mean over rows that have it, 0 without any."""
    wanted = results.sparkSession.createDataFrame([(f,) for f in fields], "criterion string")
    got = results.select(F.explode("criterion_accuracy").alias("criterion", "a")).groupBy("criterion").agg(F.avg("a").alias("accuracy"))
    return F.broadcast(wanted).join(got, "criterion", "left").select("criterion", F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))


def row_mean(accuracies: Column) -> Column:
    v = F.filter(F.map_values(accuracies), lambda x: x.isNotNull())
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v))


def mean_score(results: DataFrame) -> DataFrame:
    return results.agg(F.avg(row_mean(F.col("criterion_accuracy"))).alias("mean_score"))


def aggregate_repeats(repeats: DataFrame, by: str = "source_id", order: str = "repeat_index") -> DataFrame:
    """Per case: mean accuracy (4 places), pass in one and in all repeats, accuracies in order, pass rate, result."""
    a = F.coalesce(F.col("accuracy").cast("double"), F.lit(0.0))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order), a.alias("a"))))
    g = repeats.groupBy(by).agg(F.count("*").alias("repeats"), F.bround(F.avg(a), 4).alias("accuracy"), F.bool_or(a >= 1).alias("pass_at_least_once"), F.bool_and(a >= 1).alias("pass_all"), listed.alias("l"), F.bround(F.avg((a >= 1).cast("double")), 4).alias("pass_rate"))
    return g.select(by, "repeats", "accuracy", "pass_at_least_once", "pass_all", F.col("l.a").alias("accuracies"), "pass_rate", F.col("pass_at_least_once").alias("result"))


def repeat_criteria(repeats: DataFrame, by: str = "source_id") -> DataFrame:
    """by, criterion, mean, all: over the repeats that have the criterion."""
    e = repeats.select(by, F.explode("criterion_accuracy").alias("criterion", "a"))
    return e.groupBy(by, "criterion").agg(F.avg("a").alias("mean"), F.bool_and(F.col("a") >= 1).alias("all_passed"))


def with_repeats(cases: DataFrame, k: int) -> DataFrame:
    """k rows per case: source_id stays, each repeat gets its own dialog_id."""
    out = cases.withColumn("source_id", F.col("dialog_id")).withColumn("repeat_index", F.explode(F.sequence(F.lit(1), F.lit(max(1, k)))))
    return out.withColumn("dialog_id", F.concat_ws("#", "source_id", F.col("repeat_index").cast("string")))


def tool_call_met(goals: Column, called: Column) -> Column:
    """Goals {"None"} ask for no call; otherwise one of the goals must have been called."""
    names = F.coalesce(called, F.array().cast("array<string>"))
    return F.when((F.size(goals) == 1) & (F.try_element_at(goals, F.lit(1)) == "None"), F.size(names) == 0).otherwise(F.arrays_overlap(goals, names))


def last_turn(history: Column, role: str = "assistant") -> Column:
    return F.try_element_at(F.filter(history, lambda t: F.lower(F.trim(t["role"])) == role), F.lit(-1))


def goal_in_field(goals: Column, value: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.exists(goals, lambda g: (F.trim(g) != "") & F.contains(v, F.lower(F.trim(g))))


def semantic_match(similarity: Column, threshold: float = 0.85) -> Column:
    return F.coalesce(similarity >= threshold, F.lit(False))


def semantic_prediction(response: Column, content: Column, path: str = "response") -> Column:
    """The predicted text of the last turn: a field of its response (VARIANT), or its content where the path means that."""
    found = F.nullif(strip(F.coalesce(variant_text(response, json_path(path)), F.lit(""))), F.lit(""))
    said = F.nullif(strip(F.coalesce(content, F.lit(""))), F.lit("")) if path in ("response", "content", "") else F.lit(None).cast("string")
    return F.coalesce(found, said, F.lit(""))


def semantic_reference(case: Column, path: str = "subtopic") -> Column:
    """The reference text at a path of the case (VARIANT)."""
    return strip(F.coalesce(variant_text(case, json_path(path)), F.lit("")))


def block_ids(text: Column) -> Column:
    """Distinct integers of 1 to 9 digits in a text."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)\d{1,9}(?!\d)"), F.lit(0)), lambda x: x.cast("int"))))


# --- custom predicates

_NAMES = {"len": len, "any": any, "all": all, "str": str, "bool": bool, "int": int, "float": float, "isinstance": isinstance}
_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod}
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Is: operator.is_, ast.IsNot: operator.is_not, ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b}
_METHODS = {"get", "strip", "lower", "upper", "split", "startswith", "endswith", "replace", "keys", "values", "items", "count", "find", "join"}


class Predicate:
    """A Python expression over named values, interpreted node by node.

    Nothing is compiled or looked up by Python itself: a node, name, function or method that isn't
    listed is refused when the predicate is made.
    """

    def __init__(self, code: str, names: set[str], default: bool = False):
        self.default, self.tree = default, None
        if code and code.strip():
            self.tree = ast.parse(code.strip(), mode="eval").body
            self._check(self.tree, names | _NAMES.keys())

    def _check(self, node: ast.AST, names: set[str]) -> None:
        allowed = (ast.Constant, ast.Name, ast.BoolOp, ast.UnaryOp, ast.BinOp, ast.Compare, ast.Call, ast.Attribute, ast.Subscript, ast.Slice, ast.List, ast.Tuple, ast.Dict, ast.Set, ast.IfExp, ast.Load, ast.boolop, ast.unaryop, ast.operator, ast.cmpop)
        if not isinstance(node, allowed):
            raise ValueError(f"not allowed: {type(node).__name__}")
        if isinstance(node, ast.Name) and node.id not in names:
            raise ValueError(f"unknown name: {node.id}")
        if isinstance(node, ast.Attribute) and node.attr not in _METHODS:
            raise ValueError(f"not allowed: .{node.attr}")
        if isinstance(node, ast.Call) and (node.keywords or not isinstance(node.func, ast.Name | ast.Attribute) or (isinstance(node.func, ast.Name) and node.func.id not in _NAMES)):
            raise ValueError("not a listed function")
        for child in ast.iter_child_nodes(node):
            self._check(child, names)

    def __call__(self, values: dict) -> bool:
        return self.default if self.tree is None else bool(self._value(self.tree, values))

    def _value(self, n: ast.AST, env: dict):
        v = lambda x: self._value(x, env)
        match n:
            case ast.Constant():
                return n.value
            case ast.Name():
                return env[n.id] if n.id in env else _NAMES[n.id]
            case ast.BoolOp():
                out = None
                for x in n.values:
                    out = v(x)
                    if bool(out) != isinstance(n.op, ast.And):
                        return out
                return out
            case ast.UnaryOp():
                x = v(n.operand)
                return not x if isinstance(n.op, ast.Not) else -x if isinstance(n.op, ast.USub) else +x
            case ast.BinOp():
                return _BINARY[type(n.op)](v(n.left), v(n.right))
            case ast.Compare():
                left = v(n.left)
                for op, right in zip(n.ops, n.comparators):
                    right = v(right)
                    if not _COMPARE[type(op)](left, right):
                        return False
                    left = right
                return True
            case ast.Call():
                f = _NAMES[n.func.id] if isinstance(n.func, ast.Name) else getattr(v(n.func.value), n.func.attr)
                return f(*map(v, n.args))
            case ast.Subscript():
                return v(n.value)[v(n.slice)]
            case ast.Slice():
                return slice(*(v(x) if x else None for x in (n.lower, n.upper, n.step)))
            case ast.List() | ast.Tuple() | ast.Set():
                return {ast.List: list, ast.Tuple: tuple, ast.Set: set}[type(n)](map(v, n.elts))
            case ast.Dict():
                return {v(k): v(x) for k, x in zip(n.keys, n.values)}
            case ast.IfExp():
                return v(n.body) if v(n.test) else v(n.orelse)
        raise ValueError(f"not allowed: {type(n).__name__}")


def custom_check(code: str, columns: dict[str, Column], default: bool = False) -> Column:
    """Boolean of a custom expression; values arrive as JSON texts in Arrow batches, errors give null."""
    import json

    names = list(columns)
    predicate = Predicate(code, set(names), default)

    @F.pandas_udf("boolean")
    def check(rows: pd.DataFrame) -> pd.Series:
        def one(r) -> bool | None:
            try:
                return predicate({k: json.loads(x) if x is not None else None for k, x in zip(names, r)})
            except (TypeError, KeyError, ValueError, AttributeError, IndexError, ZeroDivisionError):
                return None

        return pd.Series([one(r) for r in rows.itertuples(index=False)], dtype=object)

    return check(F.struct(*(c.alias(k) for k, c in columns.items())))
