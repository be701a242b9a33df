"""Times, bits and small arithmetic as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the days, Monday first, English and German, long and short.
DAYS = (
    ("monday", "mon", "montag", "mo"),
    ("tuesday", "tue", "dienstag", "di"),
    ("wednesday", "wed", "mittwoch", "mi"),
    ("thursday", "thu", "donnerstag", "do"),
    ("friday", "fri", "freitag", "fr"),
    ("saturday", "sat", "samstag", "sa"),
    ("sunday", "sun", "sonntag", "so"),
)


def seconds_of_day(text: Column) -> Column:
    """Seconds after midnight of HH:mm or HH:mm:ss; null for anything else."""
    part = lambda k: F.try_element_at(F.split(F.trim(text), ":"), F.lit(k)).try_cast("int")
    ok = F.trim(text).rlike(r"^\d{1,2}:\d{2}(:\d{2})?$")
    return F.when(ok, part(1) * 3600 + part(2) * 60 + F.coalesce(part(3), F.lit(0)))


def weekday(text: Column) -> Column:
    """0 (Monday) to 6 of a day's name in any listed form, null for other text."""
    name = F.lower(F.trim(text))
    out = F.lit(None).cast("int")
    for k, names in enumerate(DAYS):
        out = F.when(name.isin(*names), k).otherwise(out)
    return out


def seconds_of_week(day: Column, time: Column) -> Column:
    """Seconds since Monday midnight."""
    return weekday(day) * 86400 + seconds_of_day(time)


def next_power_of_two(x: Column) -> Column:
    """Least power of two that is at least x (x >= 1)."""
    down = F.expr("1L") * F.pow(F.lit(2.0), F.floor(F.log2(x.cast("double")))).cast("long")
    return F.when(down >= x, down).otherwise(down * 2)


def previous_power_of_two(x: Column) -> Column:
    """Greatest power of two that is at most x (x >= 1)."""
    return F.pow(F.lit(2.0), highest_bit(x)).cast("long")


def parsed(text: Column, kind: str) -> Column:
    """A number of SQL type ``kind`` from its whole text, null if it is none or overflows."""
    return text.try_cast(kind)


def member(text: Column, names: dict[str, int]) -> Column:
    """Value of an enumeration by name, null for unknown names."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), text)


def highest_bit(x: Column) -> Column:
    """Index of the highest set bit, -1 for 0."""
    return F.when(x == 0, F.lit(-1)).otherwise(F.length(F.bin(x.cast("long"))) - 1).cast("int")


def lowest_bit(x: Column) -> Column:
    """Index of the lowest set bit, -1 for 0."""
    return F.when(x == 0, F.lit(-1)).otherwise(F.length(F.bin(x.bitwiseAND(-x).cast("long"))) - 1).cast("int")


def highest_differing_bit(a: Column, b: Column) -> Column:
    return highest_bit(a.bitwiseXOR(b))
