"""Conversions and tests on register cells.

All of them are total: text that cannot be converted becomes NULL instead of failing the job, so
they are safe under ANSI mode.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

YES = "Yes"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
EXCEL_EPOCH = "1899-12-30"
EXCEL_LAST_SERIAL = 2_958_465  # 9999-12-31
EXCEL_FALSE_LEAP_DAY = 60  # 1900-02-29, which did not exist
# Day before month, as the headers announce it; a month may be a name.
DATE_FORMATS = (
    "yyyy-M-d", "yyyy/M/d", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy",
    "d-MMM-yyyy", "d/MMM/yyyy",
)


def if_na(condition: Column, yes: Column, no: Column) -> Column:
    """Three-valued if: an unknown condition gives NULL, not the ``no`` branch."""
    return F.when(condition, yes).when(~condition, no)


def to_number(c: Column) -> Column:
    """Text to double; NULL for anything that is not a plain decimal number.

    The pattern goes first because the JVM parser also takes ``NaN`` and type suffixes (``12d``),
    and because a failed parse costs more than a failed match.
    """
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def number_column(df: DataFrame, name: str) -> Column:
    """A column as a number: numeric columns as they are, others parsed."""
    c = F.col(f"`{name}`")
    return c if isinstance(df.schema[name].dataType, NumericType) else to_number(c)


def parse_numbers(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Parse the listed columns once, so that later expressions compare plain doubles."""
    return df.withColumns({name: number_column(df, name) for name in names})


def is_positive(df: DataFrame, name: str) -> Column:
    """Quantity above zero, compared as a number and never as text; NULL where not a number."""
    return number_column(df, name) > 0


def is_value(c: Column, value: str, ignore_case: bool = False) -> Column:
    """Cell equals a literal; ``ignore_case`` serves registers whose text was lowered."""
    if ignore_case:
        return F.lower(c) == value.lower()
    return c == value


def is_yes(df: DataFrame, name: str, ignore_case: bool = False) -> Column:
    """A service cell is Yes; columns that are already parsed to booleans are taken as they are."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, BooleanType):
        return c
    return is_value(c, YES, ignore_case)


def parse_yes(df: DataFrame, names: Iterable[str], ignore_case: bool = False) -> DataFrame:
    """Parse the listed service columns to booleans once; missing cells stay NULL."""
    return df.withColumns({name: is_yes(df, name, ignore_case) for name in names})


def excel_date(c: Column) -> Column:
    """Spreadsheet day serial to date.

    Serials before the false leap day are one day off in the spreadsheet's own calendar; the leap
    day itself and serials outside the calendar are NULL.
    """
    day = F.floor(to_number(c))
    valid = day.between(1, EXCEL_LAST_SERIAL) & (day != EXCEL_FALSE_LEAP_DAY)
    shift = F.when(day < EXCEL_FALSE_LEAP_DAY, 1).otherwise(0)
    return F.date_add(F.lit(EXCEL_EPOCH).cast("date"), F.when(valid, day + shift).cast("int"))


def text_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """Text to date by the first format that fits; NULL when none does."""
    text = F.initcap(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def cell_date(c: Column) -> Column:
    """A date cell of a sheet: a day serial, or else text in one of the known formats."""
    return F.coalesce(excel_date(c), text_date(c))


def is_unread_date(c: Column) -> Column:
    """The cell holds something, and it is no date that can be read."""
    return F.coalesce((F.trim(c) != "") & cell_date(c).isNull(), F.lit(False))


def concat_na(*cols: Column) -> Column:
    """Paste cells together; a missing cell contributes the text ``NA``."""
    return F.concat(*[F.coalesce(c.cast("string"), F.lit("NA")) for c in cols])


def run_date_label(run_date: Column) -> Column:
    """Two-digit-year label used in dated output names."""
    return F.date_format(run_date, "yy-MM-dd")
