"""Run log: log lines, the monitoring table, and the outcome of the steps of a run."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.sources.tables import append, rows_to_frame

log = logging.getLogger("tradewind")

# The states of a step and of a run, and the columns of the monitoring table.
STARTED, SUCCESS, ERROR, SKIPPED, PARTIAL = "STARTED", "SUCCESS", "ERROR", "SKIPPED", "PARTIAL_SUCCESS"
MONITORING_SCHEMA = "step_name string, status string, record_count bigint, error_message string, details string"


def log_step(step: str, status: str, details: str | None = None) -> str:
    """Write and return one line: ``[time] step: status - details``."""
    moment = datetime.now().strftime("%Y-%m-%d %H:%M:%S")
    line = f"[{moment}] {step}: {status}" + (f" - {details}" if details else "")
    log.log(logging.ERROR if status == ERROR else logging.INFO, line)
    return line


def monitoring_entry(
    spark: SparkSession,
    step: str,
    status: str,
    record_count: int | None = None,
    error_message: str | None = None,
    details: str | None = None,
) -> DataFrame:
    """One row for the monitoring table, stamped with the cluster's clock."""
    row = (step, status, record_count, error_message, details)
    return rows_to_frame(spark, [row], MONITORING_SCHEMA).withColumn("timestamp", F.current_timestamp())


@dataclass(frozen=True)
class Outcome:
    """How one step ended."""

    step: str
    status: str
    records: int = 0
    error: str | None = None

    @property
    def succeeded(self) -> bool:
        return self.status == SUCCESS


@dataclass
class RunLog:
    """Outcomes of a run, in order; each is logged and appended to the monitoring table."""

    spark: SparkSession
    monitoring_path: str
    outcomes: dict[str, Outcome] = field(default_factory=dict)

    def record(self, outcome: Outcome) -> Outcome:
        self.outcomes[outcome.step] = outcome
        return self._note(outcome)

    def summarize(self, name: str, prefix: str, details: str | None = None) -> Outcome:
        """Log the state and row total of the steps that start with ``prefix``; adds no step of its own."""
        return self._note(Outcome(name, self.status(prefix), self.total(prefix)), details)

    def _note(self, outcome: Outcome, details: str | None = None) -> Outcome:
        log_step(outcome.step, outcome.status, outcome.error or details or f"{outcome.records} records")
        entry = monitoring_entry(
            self.spark, outcome.step, outcome.status, outcome.records, outcome.error, details
        )
        try:
            append(entry, self.monitoring_path)
        except Exception:  # the log must not stop the run it describes
            log.exception("monitoring entry for %s was not written", outcome.step)
        return outcome

    def succeeded(self, steps: Iterable[str]) -> bool:
        return all(step in self.outcomes and self.outcomes[step].succeeded for step in steps)

    def step(
        self, name: str, work: Callable[[], int], needs: Iterable[str] = (), reraise: bool = False
    ) -> Outcome:
        """Run ``work`` (it returns the rows written) unless a step it needs has not succeeded."""
        missing = [need for need in needs if not self.succeeded([need])]
        if missing:
            return self.record(Outcome(name, SKIPPED, error=f"needs {', '.join(missing)}"))
        log_step(name, STARTED)
        try:
            records = work()
        except Exception as error:
            self.record(Outcome(name, ERROR, error=str(error)))
            if reraise:
                raise
            return self.outcomes[name]
        return self.record(Outcome(name, SUCCESS, records))

    def total(self, prefix: str = "") -> int:
        """Rows written by the successful steps whose name starts with ``prefix``."""
        return sum(o.records for o in self.outcomes.values() if o.succeeded and o.step.startswith(prefix))

    def status(self, prefix: str = "") -> str:
        ended = [o for o in self.outcomes.values() if o.step.startswith(prefix)]
        return SUCCESS if all(o.succeeded for o in ended) else PARTIAL
