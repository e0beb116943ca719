"""Dates: names, seasons and month keys."""

from __future__ import annotations

from datetime import date

from tradewind.functions.sql import array_of, text

# Names as the reports spell them, in calendar order.
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)
SEASON_MONTHS = (("Winter", (12, 1, 2)), ("Spring", (3, 4, 5)), ("Summer", (6, 7, 8)))
LAST_SEASON = "Fall"


def day(value: date) -> str:
    """Date literal."""
    return f"DATE '{value.isoformat()}'"


def _pick(names: tuple[str, ...], number: str) -> str:
    """Name at a position counted from 1; the last name for NULL or a position out of range."""
    return f"coalesce(get({array_of(names)}, {number} - 1), {text(names[-1])})"


def day_name(day_of_week: str) -> str:
    """Name of a weekday counted from 1 = Sunday."""
    return _pick(DAY_NAMES, day_of_week)


def month_name(month: str) -> str:
    return _pick(MONTH_NAMES, month)


def season(month: str) -> str:
    cases = " ".join(
        f"WHEN {month} IN ({', '.join(map(str, months))}) THEN {text(name)}" for name, months in SEASON_MONTHS
    )
    return f"CASE {cases} ELSE {text(LAST_SEASON)} END"


def year_month(year: str, month: str) -> str:
    """``YYYY-MM``."""
    return f"concat(CAST({year} AS STRING), '-', lpad(CAST({month} AS STRING), 2, '0'))"


def days_until(as_of: date, column: str) -> str:
    """Days from a date to the day the run counts as today."""
    return f"datediff({day(as_of)}, {column})"


def month_mask(month: str) -> str:
    """The calendar months of a group as a twelve-bit mask; masks of parts combine into that of the whole."""
    return f"bit_or(shiftleft(1, {month}))"


def months_in_masks(mask: str) -> str:
    """Number of different calendar months over all masks of a group (no distinct shuffle)."""
    return f"CAST(bit_count(bit_or({mask})) AS BIGINT)"
