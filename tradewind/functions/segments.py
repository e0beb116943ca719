"""Labels from numbers: ordered ladders of thresholds as CASE expressions.

All ladders keep SQL's handling of NULL: a NULL input matches no rung and takes ``other``.
"""

from __future__ import annotations

from collections.abc import Iterable

from tradewind.functions.sql import text

Rung = tuple[float, str]


def _ladder(value: str, comparison: str, rungs: Iterable[Rung], other: str) -> str:
    cases = " ".join(f"WHEN {value} {comparison} {_number(edge)} THEN {text(label)}" for edge, label in rungs)
    return f"CASE {cases} ELSE {text(other)} END"


def _number(edge: float) -> str:
    return f"{edge!r}D" if isinstance(edge, float) else str(edge)


def below(value: str, rungs: Iterable[Rung], other: str) -> str:
    """First label whose edge lies above the value."""
    return _ladder(value, "<", rungs, other)


def up_to(value: str, rungs: Iterable[Rung], other: str) -> str:
    """First label whose edge is reached or lies above the value."""
    return _ladder(value, "<=", rungs, other)


def at_least(value: str, rungs: Iterable[Rung], positive: str, other: str) -> str:
    """First label whose edge the value reaches, ``positive`` for any smaller value above zero."""
    return f"CASE WHEN {value} > 0 THEN {_ladder(value, '>=', rungs, positive)} ELSE {text(other)} END"
