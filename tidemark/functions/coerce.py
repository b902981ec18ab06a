"""Number and time coercions. They differ on purpose between consumers; see each docstring."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
SPECIAL_TEXT = r"(?i)^[+-]?(inf|infinity|nan)$"
INTEGER_TEXT = r"^[+-]?\d+$"
NUMERIC_KIND = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def instant(value) -> Column:
    """An evaluation instant given as text, datetime or column."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def seconds(value: float) -> Column:
    return F.expr(f"make_dt_interval(0, 0, 0, {value:.6f})")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000.0)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def number_from_text(text: Column) -> Column:
    """Text to DOUBLE; anything that is not a plain number is NULL (``1d`` and blanks included)."""
    bare = strip(text)
    special = F.regexp_replace(F.lower(bare), r"^[+-](?=nan)", "")
    return (
        F.when(bare.rlike(NUMBER_TEXT), bare.try_cast("double"))
        .when(bare.rlike(SPECIAL_TEXT), special.try_cast("double"))
    )


def part(payload: Column, path: str) -> Column:
    return F.try_variant_get(payload, path, "variant")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def text_of(payload: Column, path: str) -> Column:
    """Scalar or nested value as text; JSON null and a missing key are both NULL."""
    return F.try_variant_get(payload, path, "string")


def string_only(payload: Column, path: str) -> Column:
    """The value when it is a JSON string, else NULL."""
    return F.when(kind(part(payload, path)) == "STRING", text_of(payload, path))


def boolean_only(payload: Column, path: str) -> Column:
    """The value when it is a JSON boolean, else NULL."""
    return F.when(kind(part(payload, path)) == "BOOLEAN", F.try_variant_get(payload, path, "boolean"))


def number_only(payload: Column, path: str) -> Column:
    """The value when it is a JSON number; booleans and numeric strings are NULL."""
    return F.when(kind(part(payload, path)).rlike(NUMERIC_KIND), F.try_variant_get(payload, path, "double"))


def measure(payload: Column, path: str) -> Column:
    """JSON number or numeric text; booleans are NULL. Used by history, projection and threshold scans."""
    value_kind = kind(part(payload, path))
    return F.when(value_kind.rlike(NUMERIC_KIND), F.try_variant_get(payload, path, "double")).when(
        value_kind == "STRING", number_from_text(text_of(payload, path))
    )


def rule_measure(payload: Column, path: str) -> Column:
    """As ``measure``, but booleans count as 1.0 and 0.0. Used by the lifecycle rules."""
    flag = F.try_variant_get(payload, path, "boolean").cast("double")
    return F.when(kind(part(payload, path)) == "BOOLEAN", flag).otherwise(measure(payload, path))


def integer_measure(payload: Column, path: str) -> Column:
    """Integer text only: ``4.9`` is NULL here instead of failing the query."""
    text = strip(text_of(payload, path))
    return F.when(text.rlike(INTEGER_TEXT), text.try_cast("int"))


def whole(value: Column) -> Column:
    """Truncate toward zero; NaN and infinities are NULL."""
    return value.try_cast("bigint")


def finite(value: Column) -> Column:
    """The number when it is finite, else NULL. NaN sorts above infinity, so one comparison excludes both."""
    number = value.cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def not_blank(text: Column) -> Column:
    """True when the text has something other than spaces; never NULL."""
    return F.coalesce(F.trim(text) != "", F.lit(False))


# A full date, alone or with a time of day and an offset.
ISO_TEXT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$"


def source_time(text: Column) -> Column:
    """ISO text to an instant; text without an offset is UTC.

    A full date is asked for: a time alone would become that time of the day the query runs on, a year alone its first day.
    """
    return F.when(text.rlike(ISO_TEXT), text.try_cast("timestamp"))


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator / denominator)


def percent(part_value: Column, total: Column) -> Column:
    """Share in percent, NULL unless the total is positive."""
    return F.when(total > 0, part_value / total * F.lit(100.0))
