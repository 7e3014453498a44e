"""Value repair on a consolidated register: one projection over the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions import STATUS_INTENDED, cell_date, is_unread_date, place_from_code, recode, text_date
from rollbook.functions.recodes import PLACE_CODES, REGION_CODES, SEX_CODES
from rollbook.operators.columns import lower_text, starts_with, swap_where
from rollbook.operators.dates import read_dates

# Prefixes of columns with the status at each visit, and of date cells.
STATUS_PREFIXES = ("hiv_status", "hiv_care_outcome")
DATE_PREFIX = "date_of_next_appointment"


@dataclass(frozen=True)
class Swap:
    """Two columns that the named region enters the wrong way round."""

    region: str
    a: str
    b: str


# Regions whose registers have columns exchanged.
REGISTER_SWAPS = (
    Swap("LER", "sr_name", "county"),
    Swap("UER", "sr_name", "county"),
    Swap("WKR", "kp_type", "kp_unique_identifier"),
)


def repair_values(
    df: DataFrame,
    swaps: Sequence[Swap] = REGISTER_SWAPS,
    lower: Sequence[str] = ("sr_name", "kp_name"),
    status: str = "hiv_status_at_enrollment",
    status_map: Mapping[str, str] = STATUS_INTENDED,
    text_dates: Sequence[str] = (),
    vote_by: Sequence[str] | None = None,
) -> DataFrame:
    """Swap, lower, recode and convert the columns that regions enter differently.

    The listed columns and the monthly status columns are lowered, not the other monthly cells,
    which are tested for ``Yes`` later on. Dates of next appointments, one or one a month, are day
    serials or text; ``text_dates`` are columns that hold dates as text. ``unread_dates`` counts
    the cells that are neither. Given ``vote_by``, the columns vote for how their dates are read, in each group
    of those columns (``operators.dates``): a number is then a date only in a column of serials.
    """
    if vote_by is not None:
        df = read_dates(df, [*starts_with(df, DATE_PREFIX), *text_dates], vote_by)
        text_dates = ()
    for swap in swaps:
        df = swap_where(df, F.col("region") == swap.region, swap.a, swap.b)
    monthly = [c for c in starts_with(df, *STATUS_PREFIXES) if c != status]
    df = lower_text(df, [*lower, *monthly])
    df = df.withColumns(
        {
            "region": recode(F.col("region"), REGION_CODES),
            "sex": recode(F.col("sex"), SEX_CODES),
            status: recode(F.col(status), status_map),
            **{c: cell_date(F.col(f"`{c}`")) for c in starts_with(df, DATE_PREFIX) if vote_by is None},
            **{c: text_date(F.col(c)) for c in text_dates},
            "county": place_from_code(F.col("kp_unique_identifier"), F.col("county"), PLACE_CODES),
        }
    )
    return df.withColumn("county", F.upper("county"))


def unread_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, n_unread) of raw date columns: cells that hold something, but no date."""
    counted = df.agg(
        *[F.count_if(is_unread_date(F.col(f"`{c}`"))).alias(f"n{i}") for i, c in enumerate(columns)]
    )
    cells = [
        F.struct(F.lit(c).alias("variable"), F.col(f"n{i}").alias("n_unread"))
        for i, c in enumerate(columns)
    ]
    return counted.select(F.inline(F.array(*cells)))
