"""Raw text to typed columns; every function maps a Column to a Column."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CATEGORY, DATE, FLOAT, INT, STRING

# Texts that stand for a missing value, compared in lower case.
NULL_TOKENS = ("", "na", "null", "none", "nan")

# Shapes of date texts and their formats, in order of preference (day first).
DATE_FORMATS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-dd-MM"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
)

_NUMERIC_SHAPE = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Every character that counts as blank at the ends of a text.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                           0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column | str) -> Column:
    """Trim every Unicode blank; trim() alone would leave no-break spaces."""
    return F.trim(_col(c), F.lit(BLANKS))


def once(value: Column, body) -> Column:
    """body(value) with the value computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def clean_text(c: Column | str) -> Column:
    return once(strip(_col(c).cast("string")), lambda text: F.when(~F.lower(text).isin(*NULL_TOKENS), text))


def number_from_text(text: Column) -> Column:
    """Decimal comma and group blanks; text that is no number becomes null, also in ANSI mode."""
    return once(F.translate(text, ",\u00a0 ", "."), lambda digits: F.when(digits.rlike(_NUMERIC_SHAPE), digits.try_cast("double")))


def parse_float(c: Column | str) -> Column:
    return number_from_text(clean_text(c))


def parse_amount(c: Column | str) -> Column:
    """As parse_float, without the list of null texts."""
    return number_from_text(_col(c).cast("string"))


def parse_int(c: Column | str) -> Column:
    return F.bround(parse_float(c), 0).try_cast("bigint")


def parse_date(c: Column | str) -> Column:
    """The first format of the text's shape that gives a day; shapes decide, so most texts try one or two formats."""

    def by_shape(text: Column) -> Column:
        tries = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt)).cast("date")) for shape, fmt in DATE_FORMATS]
        return F.coalesce(*tries)

    return once(clean_text(c), by_shape)


PARSERS = {
    STRING: clean_text,
    CATEGORY: clean_text,
    FLOAT: parse_float,
    INT: parse_int,
    DATE: parse_date,
}


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip().upper() for name in df.columns])


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
