"""The retry and revision loop of a run, as a fold over its attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ATTEMPTS, MAX_REVISIONS = 3, 3
ATTEMPT = ("attempt", "raised", "submitted", "compile_ok", "backtest_ok", "trades", "errors", "project_id", "changed")
UNKNOWN_ERROR = "Unknown compile error"


def succeeded(compile_ok: Column, backtest_ok: Column, trades: Column) -> Column:
    return compile_ok & backtest_ok & (trades > 0)


def fingerprint(errors: Column) -> Column:
    """Equal for equal bags of messages, in whatever order, and for these only: the sorted messages themselves, nulls among them."""
    return F.sort_array(errors)


def last_submission(results: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last result of each attempt; an earlier one is overwritten."""
    rest = [c for c in results.columns if c not in keys]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")


def changed_code(rows: DataFrame, run: str, order: list[str], code: str) -> Column:
    """Whether a row's code is there and differs from the last one that was before it."""
    before = F.last(F.nullif(F.col(code), F.lit("")), ignorenulls=True).over(Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return (F.coalesce(F.col(code), F.lit("")) != "") & ~F.col(code).eqNullSafe(before)


def sticky(run: str, order: list[str], value: str) -> Column:
    """The last value so far that isn't empty."""
    return F.last(F.nullif(F.col(value), F.lit("")), ignorenulls=True).over(Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def fold(attempts: DataFrame, run: str, max_attempts: int = MAX_ATTEMPTS, max_revisions: int = MAX_REVISIONS) -> DataFrame:
    """run, outcome, final_attempt, revisions, project_id of each run.

    attempts has run and the columns ATTEMPT. The first rule that holds ends or goes on: raised, not submitted: next; success: stop;
    revisions used up: stop; build failed with errors seen before: stop; with new ones: remember them, and count a revision if
    the code changed; no trades: if the code changed, count a revision and forget the errors; anything else: next. outcome is success,
    revisions, repeated or exhausted; only the first three have a final_attempt.
    """
    rows = F.slice(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in ATTEMPT]))), 1, max_attempts)
    start = F.struct(F.lit("").alias("outcome"), F.lit(None).cast("int").alias("final"), F.lit(0).alias("revisions"), F.lit("").alias("project"), F.array().cast("array<array<string>>").alias("seen"))

    def step(s: Column, a: Column) -> Column:
        def state(outcome=None, final=None, revisions=None, seen=None, project=True) -> Column:
            keep = F.when(F.coalesce(a["project_id"], F.lit("")) != "", a["project_id"]).otherwise(s["project"]) if project else s["project"]
            return F.struct(
                (F.lit(outcome) if outcome else s["outcome"]).alias("outcome"), (final if final is not None else s["final"]).cast("int").alias("final"),
                (revisions if revisions is not None else s["revisions"]).alias("revisions"), keep.alias("project"), (seen if seen is not None else s["seen"]).alias("seen"),
            )

        errors = F.when(F.coalesce(F.size(a["errors"]), F.lit(0)) < 1, F.array(F.lit(UNKNOWN_ERROR))).otherwise(a["errors"])
        print_ = fingerprint(errors)
        more = s["revisions"] + F.when(a["changed"], 1).otherwise(0)
        return (
            F.when((s["outcome"] != "") | a["raised"] | ~a["submitted"], state(project=False))
            .when(succeeded(a["compile_ok"], a["backtest_ok"], a["trades"]), state("success", a["attempt"]))
            .when(s["revisions"] >= max_revisions, state("revisions", a["attempt"]))
            .when(~a["compile_ok"] & F.array_contains(s["seen"], print_), state("repeated", a["attempt"]))
            .when(~a["compile_ok"], state(revisions=more, seen=F.array_append(s["seen"], print_)))
            .when(a["trades"] == 0, state(revisions=more, seen=F.when(a["changed"], F.array().cast("array<array<string>>")).otherwise(s["seen"])))
            .otherwise(state())
        )

    out = attempts.groupBy(run).agg(F.aggregate(rows, start, step).alias("s"))
    return out.select(run, F.when(F.col("s.outcome") == "", "exhausted").otherwise(F.col("s.outcome")).alias("outcome"), F.col("s.final").alias("final_attempt"), F.col("s.revisions").alias("revisions"), F.col("s.project").alias("project_id"))
