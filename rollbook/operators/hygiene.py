"""Empty rows, empty columns, blank keys and date-order checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_nonblank(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is neither NULL nor blank."""
    return df.filter(F.col(key) != "")


def keep_missing(df: DataFrame, column: str) -> DataFrame:
    """Rows where a column is NULL."""
    return df.filter(F.col(column).isNull())


def date_order_errors(df: DataFrame, earlier: str, later: str) -> DataFrame:
    """Rows where the date that should come first lies after the other one."""
    return df.filter(F.col(earlier) > F.col(later))


def drop_empty_rows(df: DataFrame, lineage: Sequence[str] = ()) -> DataFrame:
    """Drop rows that are NULL in every column; lineage columns do not count as content."""
    content = [c for c in df.columns if c not in set(lineage)]
    return df.dropna(how="all", subset=[f"`{c}`" for c in content])


def _value_counts(df: DataFrame) -> Column:
    return F.array(*[F.count(F.col(f"`{c}`")) for c in df.columns])


def empty_columns(frames: Sequence[DataFrame]) -> list[list[str]]:
    """Names of the all-NULL columns of each frame: one job, one small row per frame."""
    counted = [
        df.agg(F.lit(i).alias("frame"), _value_counts(df).alias("n")) for i, df in enumerate(frames)
    ]
    rows = {r["frame"]: r["n"] for r in reduce(DataFrame.unionAll, counted).collect()}
    return [
        [c for c, n in zip(df.columns, rows[i]) if n == 0] for i, df in enumerate(frames)
    ]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop the columns that are NULL in every row."""
    return df.drop(*[F.col(f"`{c}`") for c in empty_columns([df])[0]])
