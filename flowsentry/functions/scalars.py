"""Small column expressions used across operators and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SEVERITIES

GRANULARITIES = ("hour", "day")

# Accepted text forms of a moment, tried in this order (fixed values).
DATETIME_FORMATS = (
    ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("yyyy-MM-dd HH:mm", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$"),
    ("yyyy-MM-dd", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("yyyy-MM-dd'T'HH:mm:ss", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"),
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}Z$"),
)


def us(ts: Column) -> Column:
    """Epoch microseconds."""
    return F.unix_micros(ts)


def from_us(micros: Column) -> Column:
    return F.timestamp_micros(micros)


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def hours_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / F.lit(3600.0)


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def is_weekend(ts: Column) -> Column:
    """Saturday or Sunday (Monday is 0)."""
    return F.weekday(ts) >= 5


def time_bucket(ts: Column, granularity: str) -> Column:
    if granularity not in GRANULARITIES:
        raise ValueError(f"Unsupported granularity: {granularity}")
    return F.date_trunc(granularity, ts)


def period_label(start: Column, end: Column) -> Column:
    pattern = "yyyy-MM-dd HH:mm"
    return F.concat(F.date_format(start, pattern), F.lit(" to "), F.date_format(end, pattern))


def parse_datetime(text: Column, strict: bool = False) -> Column:
    """First matching format wins; otherwise null, or an error when `strict`."""
    tries = [F.when(text.rlike(shape), F.try_to_timestamp(_padded(text), F.lit(fmt)))
             for fmt, shape in DATETIME_FORMATS]
    parsed = F.coalesce(*tries)
    if not strict:
        return parsed
    return F.when(parsed.isNotNull() | text.isNull(), parsed).otherwise(
        F.raise_error(F.concat(F.lit("Unable to parse datetime: "), text)).cast("timestamp"))


def _padded(text: Column) -> Column:
    # one-digit fields are accepted, so put the missing zero in front of them
    return F.regexp_replace(text, r"(?<!\d)(\d)(?!\d)", "0$1")


def severity_rank(severity: Column) -> Column:
    """Low 1 … Critical 4; null for anything else."""
    ranks = F.create_map(*[F.lit(x) for i, s in enumerate(SEVERITIES) for x in (s, i + 1)])
    return ranks[severity]


def ratio_guarded(numerator: Column, denominator: Column) -> Column:
    """numerator / max(1, denominator)."""
    return numerator / F.greatest(F.lit(1.0), denominator.cast("double"))


def percent_of(part: Column, whole: Column) -> Column:
    """part / whole × 100, zero for an empty whole."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def fixed(x: Column, digits: int, half_up: bool = False) -> Column:
    """`x` as text with 1 to 3 decimals, rounded from its exact binary value.

    0.15 is a little less than it looks and becomes 0.1; a true half such as 0.25 goes to the even
    digit, or up with `half_up`. Spark's own rounding works on the shortest decimal text instead.
    """
    power = 10 ** digits
    size = F.abs(x)
    whole = F.floor(size)
    # the fraction in units of 2^-61, and its product with the power in two halves of 31 and 30 bits
    units = ((size - whole) * F.lit(float(1 << 61))).cast("long")
    low = units.bitwiseAND(F.lit((1 << 30) - 1)) * power
    high = F.shiftright(units, 30) * power + F.shiftright(low, 30)
    rest = high.bitwiseAND(F.lit((1 << 31) - 1))
    tail = low.bitwiseAND(F.lit((1 << 30) - 1))
    digit = F.shiftright(high, 31)
    at_half = (rest == (1 << 30)) & (tail == 0)
    up = (rest >= (1 << 30)) & ~at_half
    up = up | at_half if half_up else up | (at_half & (digit % 2 == 1))
    n = whole * power + digit + up.cast("long")
    body = F.concat(F.floor(n / power).cast("string"), F.lit("."),
                    F.lpad((n % power).cast("string"), digits, "0"))
    return F.when(x < 0, F.concat(F.lit("-"), body)).otherwise(body)


def round2(x: Column) -> Column:
    """Two decimals, rounded from the exact binary value."""
    return fixed(x, 2).cast("double")


def words(category: Column) -> Column:
    """snake_case to words."""
    return F.regexp_replace(category, "_", " ")


def _trimmed(x: Column, digits: int) -> Column:
    # fixed decimals, then the trailing zeros (and a bare point) removed
    return F.regexp_replace(fixed(x, digits, half_up=True), r"\.?0+$", "")


def human_bytes(n: Column, digits: int = 2, units: tuple[str, ...] = ("B", "KB", "MB", "GB", "TB")) -> Column:
    """1024-based size with at most `digits` decimals, e.g. `1.5 KB`; steps stop at the last unit."""
    value = n.cast("double")
    step = reduce(
        lambda acc, i: F.when(value >= float(1024 ** i), F.lit(i)).otherwise(acc),
        range(1, len(units)), F.lit(0))
    scaled = value / F.pow(F.lit(1024.0), step)
    body = F.when(step == 0, F.format_string("%d", n.cast("long"))).otherwise(_trimmed(scaled, digits))
    return F.concat(body, F.lit(" "), F.element_at(F.array(*[F.lit(u) for u in units]), step + 1))


def short_number(n: Column) -> Column:
    """1.2M / 3.4K / plain digits."""
    return F.when(n >= 1_000_000, F.concat(fixed(n / 1e6, 1, half_up=True), F.lit("M"))) \
        .when(n >= 1_000, F.concat(fixed(n / 1e3, 1, half_up=True), F.lit("K"))) \
        .otherwise(n.cast("long").cast("string"))


def kilobytes(n: Column) -> Column:
    """Whole KB, halves up."""
    return F.floor(n / 1024 + 0.5)
