"""Date cells of sheets in which regions mix day serials, day-first and month-first dates.

How an ambiguous cell is read is decided by its column (in each file or region): cells that only one reading admits
vote. A day above twelve shows the order of day and month; a number in the range of the register's years shows day serials.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from rollbook.functions.values import excel_date, text_date, to_number

SLASHED = r"^\s*(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\s*$"
MONTH_FIRST = ("M/d/yyyy", "M-d-yyyy", "M.d.yyyy")


@dataclass(frozen=True)
class SerialRange:
    """Day serials that can be dates of the register; other numbers are no dates."""

    first: str = "1950-01-01"
    last: str = "2049-12-31"

    def holds(self, cell: Column) -> Column:
        return excel_date(cell).between(F.lit(self.first).cast("date"), F.lit(self.last).cast("date"))


def _readings(cell: Column, serials: SerialRange) -> dict[str, Column]:
    """Which single reading a cell admits, if it admits one only."""
    first, second = (F.regexp_extract(cell, SLASHED, i).try_cast("int") for i in (1, 2))
    return {
        "serial": F.coalesce(serials.holds(cell), F.lit(False)),
        "day_first": F.coalesce(first.between(13, 31) & second.between(1, 12), F.lit(False)),
        "month_first": F.coalesce(first.between(1, 12) & second.between(13, 31), F.lit(False)),
    }


def date_votes(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), serials: SerialRange = SerialRange()
) -> DataFrame:
    """(by..., variable, serial, day_first, month_first): cells of each text column that admit one reading only.

    One aggregate over all columns; a row for each group and column.
    """
    votes = [
        F.count_if(vote).alias(f"{name}{i}")
        for i, c in enumerate(columns)
        for name, vote in _readings(F.col(f"`{c}`"), serials).items()
    ]
    counted = df.groupBy(*[F.col(f"`{b}`") for b in by]).agg(*votes)
    cells = [
        F.struct(F.lit(c).alias("variable"), *[F.col(f"{name}{i}").alias(name) for name in ("serial", "day_first", "month_first")])
        for i, c in enumerate(columns)
    ]
    return counted.select(*[F.col(f"`{b}`") for b in by], F.inline(F.array(*cells)))


def voted_date(cell: Column, serial: Column, day_first: Column, month_first: Column, serials: SerialRange) -> Column:
    """A cell as a date, ambiguous ones as the votes of their column say; NULL if it is none.

    A number is a day serial if the column has serials at all and the number is in their range. Days come before months
    unless more cells show the opposite; a cell that admits one order only is read in that order all the same.
    """
    either = F.coalesce(text_date(cell), *[F.try_to_date(F.trim(cell), f) for f in MONTH_FIRST])
    turned = F.coalesce(*[F.try_to_date(F.trim(cell), f) for f in MONTH_FIRST], text_date(cell))
    text = F.when(month_first > day_first, turned).otherwise(either)
    return F.when(to_number(cell).isNotNull(), F.when((serial > 0) & serials.holds(cell), excel_date(cell))).otherwise(text)


def read_dates(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), serials: SerialRange = SerialRange()
) -> DataFrame:
    """Text columns as dates, each read as its own cells (in each group of ``by``) vote; date columns stay.

    Two passes: one counts the votes, whose table has a row a group and joins by its size.
    """
    texts = [c for c in columns if not isinstance(df.schema[c].dataType, DateType)]
    if not texts:
        return df
    votes = date_votes(df, texts, by, serials)
    vote = F.struct("serial", "day_first", "month_first")
    per = votes.groupBy(*[F.col(f"`{b}`").alias(f"_by{i}") for i, b in enumerate(by)]).agg(
        *[F.max(F.when(F.col("variable") == c, vote)).alias(f"_vote{i}") for i, c in enumerate(texts)]
    )
    if by:
        same = F.lit(True)
        for i, b in enumerate(by):
            same &= F.col(f"`{b}`").eqNullSafe(F.col(f"_by{i}"))
        joined = df.join(per, same, "left")
    else:
        row = per.first()
        known = {i: tuple(row[f"_vote{i}"] or (0, 0, 0)) for i in range(len(texts))}
        joined = df.withColumns(
            {
                f"_vote{i}": F.struct(*[F.lit(n).alias(k) for n, k in zip(v, ("serial", "day_first", "month_first"))])
                for i, v in known.items()
            }
        )
    read = {
        c: voted_date(F.col(f"`{c}`"), *[F.col(f"_vote{i}.{k}") for k in ("serial", "day_first", "month_first")], serials)
        for i, c in enumerate(texts)
    }
    return joined.withColumns(read).select(*[F.col(f"`{c}`") for c in df.columns])


def unread_cells(df: DataFrame, read: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """(variable, n_unread): filled cells of ``df`` that are no date in ``read``, rows matched by ``key``."""
    after = read.select(F.col(f"`{key}`").alias("_key"), *[F.col(f"`{c}`").alias(f"_read{i}") for i, c in enumerate(columns)])
    both = df.join(after, F.col(f"`{key}`").eqNullSafe(F.col("_key")))
    counted = both.agg(
        *[
            F.count_if((F.trim(F.col(f"`{c}`")) != "") & F.col(f"_read{i}").isNull()).alias(f"n{i}")
            for i, c in enumerate(columns)
        ]
    )
    cells = [F.struct(F.lit(c).alias("variable"), F.col(f"n{i}").alias("n_unread")) for i, c in enumerate(columns)]
    return counted.select(F.inline(F.array(*cells)))
