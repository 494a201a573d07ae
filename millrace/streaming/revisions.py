"""The retry and revision loop over a stream of attempts, with keyed state: the same rules as operators.revision.fold."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.revision import ATTEMPT, MAX_ATTEMPTS, MAX_REVISIONS, UNKNOWN_ERROR
from .polls import KEEP, mode

OUTCOMES = "run string, outcome string, final_attempt int, revisions int, project_id string"


class Revisions(StatefulProcessor):
    """A row for each run when it ends: by success, revisions used up, repeated errors, or after the last attempt. Attempts of a batch go by number."""

    def __init__(self, max_attempts: int = MAX_ATTEMPTS, max_revisions: int = MAX_REVISIONS, keep: int | None = KEEP):
        self.max_attempts, self.max_revisions, self.keep = max_attempts, max_revisions, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "attempts int, outcome string, revisions int, project string, seen string", self.keep)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        attempts, outcome, revisions, project, seen = self.state.get() if self.state.exists() else (0, "", 0, "", "[]")
        seen, final = json.loads(seen), None
        for a in sorted(rows, key=lambda a: a.attempt):
            if outcome:
                break
            attempts += 1
            if not a.raised and a.submitted:
                project = a.project_id or project
                errors = sorted(a.errors or [UNKNOWN_ERROR], key=lambda x: (x is not None, x or ""))
                if a.compile_ok and a.backtest_ok and a.trades > 0:
                    outcome = "success"
                elif revisions >= self.max_revisions:
                    outcome = "revisions"
                elif not a.compile_ok:
                    if errors in seen:
                        outcome = "repeated"
                    else:
                        seen.append(errors)
                        revisions += bool(a.changed)
                elif a.trades == 0 and a.changed:
                    revisions, seen = revisions + 1, []
                final = a.attempt if outcome else None
            if not outcome and attempts >= self.max_attempts:
                outcome = "exhausted"
            if outcome:
                yield Row(run=key[0], outcome=outcome, final_attempt=final, revisions=revisions, project_id=project)
        self.state.update((attempts, outcome, revisions, project, json.dumps(seen)))

    def close(self) -> None:
        pass


def fold(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS, max_revisions: int = MAX_REVISIONS, keep: int | None = KEEP) -> DataFrame:
    """run, outcome, final_attempt, revisions, project_id from a stream of run and the columns ATTEMPT. Needs the RocksDB state store; runs with fewer attempts that haven't ended give no row."""
    rows = attempts.select(F.col("run").cast("string").alias("run"), *ATTEMPT)
    return rows.groupBy("run").transformWithState(Revisions(max_attempts, max_revisions, keep), OUTCOMES, "Append", mode(keep))
