"""Column functions on names, keys and dates written as text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "_"


def joined(columns: Iterable[str], separator: str = SEPARATOR) -> Column:
    """The columns as text with a separator between; a null is written nan."""
    return F.concat_ws(separator, *(F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns))


def join_present(values: Column, separator: str = SEPARATOR) -> Column:
    """The elements of an array as text, nulls left out; null for an empty array."""
    return F.when(F.size(values) > 0, F.array_join(F.transform(values, lambda x: x.cast("string")), separator))


def join_all(values: Column, separator: str = SEPARATOR) -> Column:
    """The elements of an array as text, a null written None."""
    return F.array_join(F.transform(values, lambda x: x.cast("string")), separator, "None")


def is_float(text: Column) -> Column:
    """Whether a text passes for a number: digits, or digits, any one character, digits; white space at the ends never does."""
    return (text == F.trim(text)) & (text.rlike("^[0-9]*$") | text.rlike("^[0-9]*.[0-9]*$"))


def reordered(values: Column, order: Column) -> Column:
    """The elements at the positions in `order`, counted from 1; 0 is the last."""
    return F.transform(order, lambda i: F.element_at(values, F.when(i == 0, -1).otherwise(i)))


def pixel_diameter(area: Column) -> Column:
    return F.sqrt(4 * area / F.pi())


#: Fixed patterns: birth and death dates, and ages in days.
LIFE = r"B(\d\d-\d\d-\d{4})_D(\d\d-\d\d-\d{4})"
DAYS = r"(\d?\d?\d) ?(day)s?"


def age_days(text: Column) -> Column:
    """Age in days of a text with birth and death dates (month-day-year) or with a number of days; null for any other."""
    date = lambda k: F.try_to_timestamp(F.regexp_extract(text, LIFE, k), F.lit("MM-dd-yyyy")).cast("date")
    life = F.when(text.rlike(LIFE), F.date_diff(date(2), date(1)))
    return F.coalesce(life, F.when(text.rlike(DAYS), F.regexp_extract(text, DAYS, 1).cast("int")))


def age_text(text: Column) -> Column:
    """`<n> days` where the text holds an age, else the text as it is."""
    return F.coalesce(F.concat(age_days(text).cast("string"), F.lit(" days")), text)


def well_index(row: Column, column: Column) -> Column:
    return row * 1000 + column


def padded_well(row: Column, column: Column) -> Column:
    """Row and column with two digits each, as one number; null where one has more."""
    return F.when((row < 100) & (column < 100), row * 100 + column)


def row_letter(well: Column) -> Column:
    return F.chr(F.lit(64) + F.floor(well / 1000))
