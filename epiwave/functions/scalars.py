"""Scalar building blocks as Spark SQL expressions.

Every function takes SQL text (a column name or any expression) and returns SQL
text, so blocks nest freely and a whole projection reaches the JVM as a few
strings. ``columns`` turns a mapping of such texts into DataFrame columns.

A missing value is always NULL, never NaN: Spark orders NaN above every number
and treats it as equal to itself, which would break the comparisons below.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_TEXT = r"^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$"


def columns(texts: Mapping[str, str]) -> dict[str, Column]:
    return {name: F.expr(text) for name, text in texts.items()}


def quoted(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def parse_date(x: str, formats: Sequence[str] = ("M/d/yyyy", "yyyy-MM-dd")) -> str:
    """Text -> date by the first matching format, NULL when none matches."""
    tries = ", ".join(f"try_to_timestamp(trim({x}), {quoted(f)})" for f in formats)
    return f"CAST(coalesce({tries}) AS DATE)"


def scrub_nonfinite(x: str) -> str:
    """NaN and both infinities -> NULL."""
    return f"CASE WHEN abs({x}) < double('Infinity') THEN {x} END"


def parse_number(x: str) -> str:
    """Text -> double; anything that is not a plain decimal number becomes NULL."""
    number = f"try_cast(trim({x}) AS DOUBLE)"
    return f"CASE WHEN CAST({x} AS STRING) RLIKE '{NUMBER_TEXT}' THEN {scrub_nonfinite(number)} END"


def fill_zero(x: str) -> str:
    """Truncated towards zero into a long; missing and beyond the range of a long -> 0."""
    return f"coalesce(try_cast({x} AS BIGINT), 0L)"


def week_start(t: str) -> str:
    """Monday of the week that holds ``t``."""
    return f"CAST(date_trunc('week', {t}) AS DATE)"


def bucket_start(t: str, bucket: str) -> str:
    return week_start(t) if bucket == "week" else f"CAST({t} AS DATE)"


def days_between(later: str, earlier: str) -> str:
    return f"datediff({later}, {earlier})"


def next_week(d: str) -> str:
    return f"date_add({d}, 7)"


def round_half_even(x: str, digits: int = 2) -> str:
    """Half-even rounding of the scaled double (not of its decimal expansion)."""
    return f"(rint({x} * 1e{digits}D) / 1e{digits}D)"


def null_if_zero(x: str) -> str:
    return f"nullif({x}, 0)"


def ratio(a: str, b: str) -> str:
    """a / b, NULL when b is 0 or either side is missing."""
    return f"({a} / {null_if_zero(b)})"


def case_fatality(cases: str, deaths: str) -> str:
    """Deaths per hundred cases with two digits; 0.0 without cases."""
    return f"CASE WHEN {cases} > 0 THEN {round_half_even(f'{deaths} / {cases} * 100D')} ELSE 0D END"


def clip_lower(x: str, low: str = "0") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest({x}, {low}) END"


def clip_range(x: str, low: str, high: str) -> str:
    """Clamp into [low, high]; NULL stays NULL although least/greatest skip NULLs."""
    return f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {low}), {high}) END"


def fixed_decimals(x: str, digits: int) -> str:
    """Number -> text with a fixed number of decimals."""
    return f"format_string('%.{digits}f', CAST({x} AS DOUBLE))"


def argmax_label(scores: str, labels: Sequence[str]) -> str:
    """Label at the (first) largest entry of an array of class scores."""
    names = ", ".join(map(quoted, labels))
    return f"element_at(array({names}), CAST(array_position({scores}, array_max({scores})) AS INT))"
