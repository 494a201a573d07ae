"""Polling: the first terminal observation of each run among a bounded number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonx, text

MAX_POLLS = 60
FAILED_CALL = "Error executing tool read_backtest"


def classify_status(status: Column) -> Column:
    """ok, fail or null by parts of the status, success first: an incomplete run counts as complete."""
    s = F.lower(status)
    return F.when(s.rlike("complete|completed|finished|success"), "ok").when(s.rlike("error|failed|cancel"), "fail")


def strict_status(status: Column) -> Column:
    """ok, fail or null by whole words of the status, failure first."""
    s = F.lower(status)
    return F.when(s.rlike(r"\b(error|failed|cancell?ed|incomplete|unsuccessful)\b"), "fail").when(s.rlike(r"\b(complete|completed|finished|success|successful)\b"), "ok")


def classify_build(state: Column) -> Column:
    return F.when(state == "BuildSuccess", "ok").when(state == "BuildError", "fail")


def classify_response(raw: Column, literals: bool = True) -> Column:
    """ok, fail or null of a polled response, an object as JSON or, if literals, as a Python literal: a failed call, a status that can't be
    looked up or is no text, an error, the status, a result, in this order. The object is parsed once."""

    def verdict(v: Column) -> Column:
        return jsonx.let(
            jsonx.lookup(v, jsonx.STATUS_PATHS),
            lambda s: F.when(s["failed"] | ~s["is_text"], "fail").when(jsonx.truthy(jsonx.token(v, "$.error")), "fail").otherwise(F.coalesce(classify_status(s["value"]), F.when(jsonx.complete(v), "ok"))),
        )

    return F.when(raw.startswith(FAILED_CALL), "fail").otherwise(jsonx.let(jsonx.parsed(jsonx.safe_object(raw, literals)), verdict))


def envelope(tool: Column, arguments: Column, raw: Column, available: Column, polled: Column, report: Column, start: str = "create_backtest") -> Column:
    """ok, error, data, raw, available of a call. What fails first counts: a tool that isn't available, arguments, and where the tool starts a run, no id
    of the run, no project, the outcome of its polling (ok, fail, timeout; null: it goes on, and so is ok).

    data is the object of the response, or that of the last poll (report) where the run ended.
    """
    none = F.lit(None).cast("string")

    def answer(ok, error=none, data=none, raw=none, available=F.lit(None).cast("array<string>")) -> Column:
        return F.struct(F.lit(ok).cast("boolean").alias("ok"), error.alias("error"), data.alias("data"), raw.alias("raw"), available.alias("available"))

    found, wrong = jsonx.safe_object(raw), jsonx.argument_error(arguments)
    bad = jsonx.lookup_fails(found, jsonx.ID_PATHS) | jsonx.lookup_fails(arguments, jsonx.PROJECT_PATHS)
    run, project = jsonx.resolved_backtest_id(found, text.backtest_id(raw)), jsonx.project_id(arguments)
    told = F.coalesce(jsonx.first_truthy(report, ("$.error",)), jsonx.status(report), report)
    return (
        F.when(~F.array_contains(available, tool), answer(False, F.concat(F.lit("Tool '"), tool, F.lit("' not in list")), available=available))
        .when(wrong.isNotNull(), answer(False, wrong))
        .when(tool != start, answer(True, data=found))
        .when(bad, answer(False, F.lit("response is of another shape")))
        .when(run.isNull(), answer(False, F.lit("No backtestId"), found, raw))
        .when(project.isNull(), answer(False, F.lit("No projectId"), found))
        .when(polled == "timeout", answer(False, F.lit("Backtest timeout")))
        .when(polled == "fail", answer(False, told, report))
        .when(polled == "ok", answer(True, data=report))
        .otherwise(answer(None, data=found))
    )


def poll_until_terminal(polls: DataFrame, run: str, order: list[str], verdict: Column, limit: int = MAX_POLLS) -> DataFrame:
    """run, outcome (ok, fail or timeout), polls and the order columns of the poll that ended it; polls after the limit aren't looked at.

    One shuffle by run; the window's bound is pushed below it, so no more than limit rows of a run pass from a task.
    """
    w = Window.partitionBy(run).orderBy(*order)
    seen = polls.select(run, *order, verdict.alias("__verdict")).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit)
    ended = F.when(F.col("__verdict").isNotNull(), F.struct("__n", "__verdict", *order))
    first = seen.groupBy(run).agg(F.min(ended).alias("e"), F.max("__n").alias("n"))
    return first.select(run, F.coalesce("e.__verdict", F.lit("timeout")).alias("outcome"), F.coalesce("e.__n", "n").alias("polls"), *[F.col(f"e.{c}").alias(c) for c in order])
