"""Row rules and uniqueness rules of one table, checked in one pass."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame

from tradewind.functions.sql import aggregate, long_form, text

log = logging.getLogger(__name__)

RESULT_SCHEMA = "table_name string, rule_name string, failed_count bigint, passed boolean"


@dataclass(frozen=True)
class Rule:
    """``predicate`` must not be false in any row; NULL counts as fine, as in SQL's CHECK."""

    name: str
    predicate: str

    def failures(self) -> str:
        return f"count_if(NOT ({self.predicate}))"


@dataclass(frozen=True)
class UniqueRule:
    """``key`` must not repeat; all NULLs together are one value."""

    name: str
    key: str

    def failures(self) -> str:
        return f"COUNT(*) - COUNT(DISTINCT {self.key}) - coalesce(MAX(CAST({self.key} IS NULL AS INT)), 0)"


AnyRule = Rule | UniqueRule


def _counted(
    df: DataFrame, rules: Sequence[AnyRule], more: Mapping[str, str] | None = None
) -> tuple[list[AnyRule], DataFrame]:
    """Failure counts of the rules that fit the schema; analysis only, no job.

    All rules are tried together first; only when that fails is each looked at alone.
    """

    def totals(chosen: Sequence[AnyRule]) -> DataFrame:
        counts = {f"rule_{rules.index(rule)}": rule.failures() for rule in chosen}
        return aggregate(df, [], {**counts, **(more or {})} or {"none": "0"})

    try:
        return list(rules), totals(rules)
    except (AnalysisException, ParseException):
        valid = []
        for rule in rules:
            try:
                totals([rule])
                valid.append(rule)
            except (AnalysisException, ParseException) as error:
                log.warning("rule %s cannot be checked: %s", rule.name, error)
        return valid, totals(valid)


def check_rules(df: DataFrame, table: str, rules: Sequence[AnyRule]) -> DataFrame:
    """One row per rule: table_name, rule_name, failed_count, passed.

    All rules share one scan and one aggregation. A rule that does not fit the schema is reported
    as failed with " (error)" after its name and no count; it does not spoil the others.
    """
    valid, totals = _counted(df, rules)

    def verdict(place: int, rule: AnyRule) -> dict[str, str]:
        known = rule in valid
        failed = f"rule_{place}" if known else "CAST(NULL AS BIGINT)"
        return {
            "table_name": text(table),
            "rule_name": text(rule.name if known else f"{rule.name} (error)"),
            "failed_count": f"CAST({failed} AS BIGINT)",
            "passed": f"coalesce({failed} = 0, false)",
        }

    return long_form(totals, [verdict(place, rule) for place, rule in enumerate(rules)])


def counts_and_scores(df: DataFrame, table: str, rules: Sequence[AnyRule]) -> DataFrame:
    """table_name, record_count, quality_score: rows and the share of passed rules in percent, from one pass."""
    valid, totals = _counted(df, rules, {"record_count": "COUNT(*)"})
    passed = " + ".join(f"IF(rule_{place} = 0, 1, 0)" for place, rule in enumerate(rules) if rule in valid) or "0"
    score = f"round(({passed}) / {len(rules)} * 100, 1)"
    return totals.selectExpr(f"{text(table)} AS table_name", "record_count", f"{score} AS quality_score")


def check_rules_now(df: DataFrame, table: str, rules: Sequence[AnyRule]) -> DataFrame:
    """Like ``check_rules``, run at once; a rule that fails on the data is isolated as well.

    Only when the shared pass fails is each rule given a job of its own.
    """
    spark = df.sparkSession
    try:
        rows = check_rules(df, table, rules).collect()
    except PySparkException:
        rows = []
        for rule in rules:
            try:
                rows += check_rules(df, table, [rule]).collect()
            except PySparkException as error:
                log.warning("rule %s failed on %s: %s", rule.name, table, error)
                rows.append((table, f"{rule.name} (error)", None, False))
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def row_metrics(df: DataFrame, rules: Sequence[AnyRule], prefix: str = "rule") -> dict[str, str]:
    """name -> aggregate of the row rules that fit the schema: failure counts a write of ``df`` can take on its way.

    Rules on uniqueness aren't among them: distinct values can't be counted on the way.
    """
    rows = [rule for rule in rules if isinstance(rule, Rule)]
    valid, _ = _counted(df, rows)
    return {f"{prefix}_{rules.index(rule)}": rule.failures() for rule in valid}


def settled_rules(stored: DataFrame, table: str, rules: Sequence[AnyRule], counts: Mapping[str, int] | None, prefix: str = "rule") -> DataFrame:
    """The verdicts of ``check_rules_now`` from what the write of the table counted (``row_metrics``).

    Only the rules on uniqueness look at the stored table, at their own column. Without ``counts`` all rules do.
    """
    if counts is None:
        return check_rules_now(stored, table, rules)
    rows = []
    for place, rule in enumerate(rules):
        if isinstance(rule, UniqueRule):
            rows += check_rules_now(stored, table, [rule]).collect()
        elif (failed := counts.get(f"{prefix}_{place}")) is not None:
            rows.append((table, rule.name, int(failed), failed == 0))
        else:
            rows.append((table, f"{rule.name} (error)", None, False))
    return stored.sparkSession.createDataFrame(rows, RESULT_SCHEMA)


def quality_scores(results: DataFrame) -> DataFrame:
    """Share of passed rules per table in percent, one decimal."""
    return aggregate(
        results,
        ["table_name"],
        {
            "rules_total": "COUNT(*)",
            "rules_passed": "count_if(passed)",
            "quality_score": "round(count_if(passed) / COUNT(*) * 100, 1)",
        },
    )


class QualityError(AssertionError):
    """A required rule does not hold."""


def require(results: DataFrame) -> None:
    """Raise if any rule failed; reads the verdicts (a handful of rows), not the data."""
    failed = results.filter("NOT passed").orderBy("table_name", "rule_name").collect()
    if failed:
        raise QualityError("; ".join(f"{r.table_name}.{r.rule_name}: {r.failed_count} rows" for r in failed))
