"""Tolerant JSON: responses of any shape, looked up at several paths, where empty values count as missing.

A text is parsed once, to a variant, from which fields are then read; let() keeps it that way within an expression.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import NO_ERROR_TEXT, error_messages, ordered_distinct, with_default

ID_PATHS = ("$.backtestId", "$.id", "$.backtest.backtestId", "$.result.backtestId")
STATUS_PATHS = ("$.status", "$.state", "$.backtest.status", "$.backtest.state", "$.result.status")
PROJECT_PATHS = ("$.projectId", "$.model.projectId")
TRADE_PATHS = ("$.totalTrades", "$.backtest.totalTrades", "$.result.totalTrades")
RESULT_KEYS = ("alpha", "charts", "orders", "result", "results", "statistics", "totalTrades")
#: JSON texts of values that count as nothing.
_FALSY = r'^(?:""|\[\]|\{\}|false|null|-?0(?:\.0*)?(?:[eE][+-]?\d+)?)$'
_NONE = "array<string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body has it."""
    return F.transform(F.array(value), body)[0]


def parsed(raw: Column) -> Column:
    """The variant of a JSON text; null for other texts."""
    return F.try_parse_json(raw)


def token(v: Column, path: str) -> Column:
    """The JSON text of what a variant has at a path, null being 'null'; null where there is nothing."""
    return F.to_json(F.try_variant_get(v, path, "variant"))


def truthy(value: Column) -> Column:
    """Whether a JSON text is that of a value that counts as something, as any text but the empty one does; false for null."""
    return F.coalesce(~value.rlike(_FALSY), F.lit(False))


def lookup(v: Column, paths: tuple[str, ...]) -> Column:
    """failed, value, is_text of the first of the paths whose value counts as something; null if none does.

    failed: what a path goes through is there and is no object, and no earlier path had a value.
    """
    fields = lambda failed, value, is_text: F.struct(failed.alias("failed"), value.alias("value"), is_text.alias("is_text"))
    out = F.lit(None).cast("struct<failed: boolean, value: string, is_text: boolean>")
    for path in reversed(paths):
        at, parent = token(v, path), path.rpartition(".")[0]
        out = F.when(truthy(at), fields(F.lit(False), F.try_variant_get(v, path, "string"), at.startswith('"'))).otherwise(out)
        if parent != "$":
            out = F.when(~token(v, parent).startswith("{"), fields(F.lit(True), F.lit(None).cast("string"), F.lit(False))).otherwise(out)
    return out


def first_truthy(raw: Column, paths: tuple[str, ...]) -> Column:
    """The first value of raw, a JSON text, at one of the paths that counts as something; null if none does or the lookup fails."""
    return let(parsed(raw), lambda v: lookup(v, paths)["value"])


def lookup_fails(raw: Column, paths: tuple[str, ...]) -> Column:
    """Whether something that isn't an object is in the way."""
    return F.coalesce(let(parsed(raw), lambda v: lookup(v, paths)["failed"]), F.lit(False))


def kind(raw: Column) -> Column:
    """object, array, scalar, invalid or empty."""
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", "empty").when(parsed(raw).isNull(), "invalid").when(raw.rlike(r"(?s)^\s*\{.*\}\s*$"), "object")
        .when(raw.rlike(r"(?s)^\s*\[.*\]\s*$"), "array").when(raw.rlike(r'(?s)^\s*(?:".*"|[^\s"{\[]+)\s*$'), "scalar").otherwise("invalid")
    )


def _object(text: str) -> str:
    for read in (json.loads, ast.literal_eval):
        try:
            value = read(text)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
        try:
            return json.dumps(value) if isinstance(value, dict) else "{}"
        except (ValueError, TypeError, RecursionError):
            return "{}"
    return "{}"


@F.pandas_udf(T.StringType())
def _literal_object(raw: pd.Series) -> pd.Series:
    out, some = pd.Series("{}", index=raw.index, dtype=object), raw.notna()
    out[some] = raw[some].map(_object)
    return out


def safe_object(raw: Column, literals: bool = True) -> Column:
    """raw if it is a JSON object; the object that raw writes as a Python literal, if literals and raw isn't JSON; else {}.

    Only texts that Spark's parser refuses (repeated keys and text after an object among them) go through Python.
    """
    k = kind(raw)
    odd = (k == "invalid") | (k == "object") & raw.rlike(r"\}\s*\{")
    other = _literal_object(F.when(odd, raw)) if literals else F.lit("{}")
    return F.when(odd, other).when(k == "object", raw).otherwise("{}")


def resolved_backtest_id(raw: Column, pattern: Column) -> Column:
    """The id at one of ID_PATHS, else what the pattern found; null where the lookup fails."""
    return let(let(parsed(raw), lambda v: lookup(v, ID_PATHS)), lambda found: F.when(F.coalesce(found["failed"], F.lit(False)), None).otherwise(F.coalesce(found["value"], pattern)))


def status(raw: Column) -> Column:
    return first_truthy(raw, STATUS_PATHS)


def project_id(arguments: Column) -> Column:
    return first_truthy(arguments, PROJECT_PATHS)


def total_trades(raw: Column) -> Column:
    """Number of trades that a result tells; 0 if it tells none."""
    return F.coalesce(first_truthy(raw, TRADE_PATHS).try_cast("int"), F.lit(0))


def keys(raw: Column) -> Column:
    """Names of an object's fields, sorted; null for anything else."""
    return F.array_sort(F.json_object_keys(F.when(kind(raw) == "object", raw)))


def get(raw: Column, path: str, default: Column) -> Column:
    """What is at a path, texts as they are and other values as JSON, or the default where there is nothing; JSON's null is a value, and null."""
    return let(parsed(raw), lambda v: F.when(token(v, path).isNull(), default).otherwise(F.try_variant_get(v, path, "string")))


def argument_error(arguments: Column) -> Column:
    """Null for an empty text or an object; else what is wrong."""
    return let(kind(arguments), lambda k: F.when(k == "invalid", "arguments are not JSON").when(k.isin("array", "scalar"), "arguments are not an object"))


def complete(v: Column) -> Column:
    """Whether a variant is a finished run's: completed or finished is true itself (not a text that says so), or a
    result key holds something, at the top or under backtest, where this is an object."""
    out = F.lit(False)
    for at in ("$", "$.backtest"):
        for k in ("completed", "finished"):
            out = out | F.coalesce(token(v, f"{at}.{k}") == "true", F.lit(False))
        for k in RESULT_KEYS:
            out = out | truthy(token(v, f"{at}.{k}"))
    return out


def looks_complete(raw: Column) -> Column:
    """complete() of a JSON text; false for what isn't an object."""
    return F.coalesce(let(parsed(raw), complete), F.lit(False))


def _said(v: Column) -> Column:
    """What a variant says as text: null, true and false by Python's names, other values that aren't texts as JSON."""
    return let(F.to_json(v), lambda t: F.when(t == "null", "None").when(t == "true", "True").when(t == "false", "False").otherwise(v.cast("string")))


def compile_errors(raw: Column) -> Column:
    """Errors of a build response: those listed under errors (or its one text), compile.logs, error, whatever it is, and where the state tells of an
    error, message; of a text that isn't JSON, what the patterns find. Logs that are a single text count as one error."""
    none = F.array().cast(_NONE)

    def one(v: Column, path: str) -> Column:
        return let(F.try_variant_get(v, path, "variant"), lambda at: F.when(at.isNull(), none).otherwise(F.array(_said(at))))

    def many(v: Column, path: str) -> Column:
        items = F.transform(F.try_variant_get(v, path, "array<variant>"), _said)
        return F.when(token(v, path).startswith("["), items).when(token(v, path).startswith('"'), one(v, path)).otherwise(none)

    def listed(v: Column) -> Column:
        failed = F.lower(F.coalesce(F.try_variant_get(v, "$.state", "string"), F.lit(""))).contains("error")
        return F.concat(many(v, "$.errors"), many(v, "$.compile.logs"), one(v, "$.error"), F.when(failed, one(v, "$.message")).otherwise(none))

    found = let(parsed(raw), lambda v: F.when(v.isNotNull(), ordered_distinct(listed(v))))
    return let(F.coalesce(found, error_messages(raw), none), lambda items: with_default(items, NO_ERROR_TEXT))


def flatten_blocks(blocks: Column) -> Column:
    """One text of an array of blocks (text, data, model, other): of each the first part that is there; an empty text isn't."""
    return F.array_join(F.transform(blocks, lambda b: F.coalesce(F.nullif(b["text"], F.lit("")), b["data"], b["model"], b["other"], F.lit(""))), "\n")
