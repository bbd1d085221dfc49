"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MONTHS, QUESTION_PATTERNS

TOKEN = r"[\p{L}\p{N}_]+"


def all_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def tokenize(text: Column, cap: int = 64) -> Column:
    """The first distinct tokens of a text, in lower case, in order of appearance."""
    return F.slice(F.array_distinct(all_tokens(text)), 1, cap)


def long_tokens(text: Column, longer_than: int = 2) -> Column:
    return F.array_distinct(F.filter(all_tokens(text), lambda t: F.length(t) > longer_than))


def long_words(text: Column, longer_than: int = 2) -> Column:
    """The words of a text, cut at white space and in lower case, of more than so many characters."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: F.length(w) > longer_than)


def overlap(a: Column, b: Column) -> Column:
    """Share of the smaller set of long tokens that the other has too; 0 if either is empty."""
    x, y = long_tokens(a), long_tokens(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def day_of(ms: Column) -> Column:
    """The UTC date of epoch milliseconds, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / F.lit(86_400_000)).cast("int"))


def hour_of(ms: Column) -> Column:
    return F.pmod(F.floor(ms / F.lit(3_600_000)), F.lit(24))


def time_bucket(ms: Column) -> Column:
    """Calendar year, ISO week, weekday (Monday 0) and quarter of the day's 24 hours, as a seed."""
    day = day_of(ms)
    return F.concat(
        F.year(day).cast("string"), F.lit("-W"), F.weekofyear(day).cast("string"), F.lit("-"),
        F.weekday(day).cast("string"), F.lit("-"), F.floor(hour_of(ms) / 4).cast("string"),
    )


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def month_label(ms: Column) -> Column:
    day = day_of(ms)
    return F.concat(F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day)), F.lit(" "), F.year(day).cast("string"))


def day_label(ms: Column) -> Column:
    return F.concat(F.dayofmonth(day_of(ms)).cast("string"), F.lit(" "), month_label(ms))


def iso_date(ms: Column) -> Column:
    return F.date_format(day_of(ms), "yyyy-MM-dd")


def iso_time(ms: Column) -> Column:
    """UTC date and time to the second, whatever the session's time zone."""
    rest = F.floor(F.pmod(ms, F.lit(86_400_000)) / 1000)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(iso_date(ms), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest % 3600 / 60)), F.lit(":"), two(rest % 60), F.lit("Z"))


def percent(share: Column) -> Column:
    """A share as a whole percentage, halves to the even number."""
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def question_type(question: Column) -> Column:
    """The first question type one of whose patterns the text holds; unknown if none. Null gives unknown."""
    found = None
    for name, patterns in QUESTION_PATTERNS:
        held = question.rlike("(?iuU)" + "|".join(patterns))
        found = F.when(held, name) if found is None else found.when(held, name)
    return found.otherwise("unknown")
