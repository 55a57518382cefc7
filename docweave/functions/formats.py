"""Column functions that write values in a fixed form or check one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.text import collapse


def without_controls(col: Column) -> Column:
    """Text without control characters other than tab and line ends."""
    return F.regexp_replace(col, r"[\p{Cc}&&[^\t\r\n]]", "")


def note_code(col: Column) -> Column:
    """The upper-case code before the first colon of a note; null without a colon or a code."""
    return F.when(F.contains(col, F.lit(":")), F.nullif(F.upper(collapse(F.split_part(col, F.lit(":"), F.lit(1)))), F.lit("")))


def dong(col: Column) -> Column:
    """A whole amount with dots between thousands and the dong sign."""
    return F.concat(F.translate(F.format_number(col.cast("long"), 0), ",", "."), F.lit(" ₫"))


def day_first(col: Column) -> Column:
    """A date as day/month/year."""
    return F.date_format(col, "dd/MM/yyyy")


def utc_stamp(col: Column) -> Column:
    """A timestamp in UTC with microseconds and Z, whatever the session's zone."""
    return F.date_format(col.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def is_zoned(col: Column) -> Column:
    """Whether a text is a valid timestamp that names its zone."""
    form = F.rlike(col, F.lit(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d{1,6})?(?:Z|[+-]\d\d:\d\d)$"))
    return F.coalesce(form & F.try_to_timestamp(F.substring(col, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull(), F.lit(False))


def within_scale(col: Column, digits: int) -> Column:
    """Whether a number has no more than ``digits`` decimals, judged on its first eight."""
    exact = col.cast("decimal(28,8)")
    return exact == F.round(exact, digits)


def pixels(points: Column, dpi: int) -> Column:
    """Pixels needed for a length in points (72 an inch)."""
    return F.ceil(points * dpi / F.lit(72.0)).cast("long")


def unit(position: Column, whole: Column) -> Column:
    """A position as a share of the whole, kept within 0 and 1, six digits; null if the whole is 0."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(position.cast("double"), whole.cast("double")))), 6)


def numbered(prefix: str, number: Column, width: int) -> Column:
    """A sequential id such as ``line-0001``; longer numbers keep all digits."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))
