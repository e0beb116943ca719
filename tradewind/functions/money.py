"""Money: exact sums that do not depend on the order in which rows arrive.

A sum of doubles changes in its last digits with the partitioning, so two runs over the same
table can disagree; a sum of wide decimals is exact but several times slower. Amounts are turned into whole
millionths (64-bit integers) and added up as two integer sums, of whole units and of the rest, which neither
round nor overflow; the total becomes a double once, at the end. Six decimals hold every amount in cents, tenths
of cents and the usual unit prices; ``off_scale`` tells the amounts that they don't hold, to be counted and reported.
"""

from __future__ import annotations

SCALE = 6
SPLIT = 10**SCALE


def micros(amount: str) -> str:
    """Nearest whole number of millionths."""
    return f"floor({amount} * {SPLIT} + 0.5D)"


def off_scale(amount: str) -> str:
    """True for an amount that needs more than six decimals, or is too large to be kept as 64-bit millionths.

    A double holds about 16 digits: from 10^9 on its own error is beyond six decimals and isn't held against it.
    """
    error = f"abs({amount} * {SPLIT} - floor({amount} * {SPLIT} + 0.5D))"
    return f"(abs({amount}) >= 9.0e12D OR (abs({amount}) < 1.0e9D AND {error} > 0.001D + abs({amount}) * 1.0e-8D))"


def micros_sum(amount: str) -> str:
    """Millionths of one fine-grained group (an order line, a customer's day), to be added up further."""
    return f"SUM({micros(amount)})"


def total_of_micros(whole: str) -> str:
    """Amount, as a double, of a column of whole millionths added up over any number of rows."""
    units, rest = f"SUM({whole} DIV {SPLIT})", f"SUM({whole} % {SPLIT})"
    return f"CAST(CAST({units} + {rest} DIV {SPLIT} AS DECIMAL(26,6)) + CAST({rest} % {SPLIT} AS DECIMAL(26,6)) / {SPLIT} AS DOUBLE)"


def money_sum(amount: str) -> str:
    return total_of_micros(micros(amount))


def money_avg(amount: str) -> str:
    """Mean of the non-NULL values; NULL where there is none."""
    return f"{money_sum(amount)} / NULLIF(COUNT({amount}), 0)"


def ratio(part: str, whole: str) -> str:
    """``part / whole``; 0 where ``whole`` is NULL or not above zero."""
    return f"CASE WHEN {whole} > 0 THEN {part} / {whole} ELSE 0.0D END"


def percent(part: str, whole: str, digits: int = 2) -> str:
    return f"ROUND({ratio(part, whole)} * 100, {digits})"
