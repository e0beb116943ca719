"""Text clean-up and key digests."""

from __future__ import annotations

from collections.abc import Sequence

NULL_MARK = "∅"


def title(column: str) -> str:
    """Trimmed, each word with a capital first letter and lower case after it."""
    return f"initcap(trim({column}))"


def dimension(parts: str, position: int) -> str:
    """First run of digits of one part, as a number; NULL where the part or the digits are missing."""
    return f"try_cast(regexp_extract(get({parts}, {position}), '([0-9]+)', 1) AS DOUBLE)"


def record_hash(columns: Sequence[str]) -> str:
    """32-bit Murmur3 of the joined row. NULLs are skipped, so ('a', NULL) equals (NULL, 'a')."""
    return f"hash(concat_ws('|', {', '.join(f'CAST(`{c}` AS STRING)' for c in columns)}))"


def record_md5(columns: Sequence[str]) -> str:
    """Row digest in which a NULL keeps its place."""
    marked = ", ".join(f"coalesce(CAST(`{c}` AS STRING), '{NULL_MARK}')" for c in columns)
    return f"md5(CAST(concat_ws('|', {marked}) AS BINARY))"


def plain_number(number: str) -> str:
    """A number with two decimals as text, without trailing zeros but with one decimal kept."""
    return f"regexp_replace(CAST(CAST({number} AS DECIMAL(38,2)) AS STRING), '([.][0-9]+?)0+$', '$1')"
