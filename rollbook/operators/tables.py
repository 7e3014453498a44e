"""Frequency tables. A missing value is a level of its own."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOTAL = "Total"
NA_LEVEL = "NA_"
OTHER = "other_levels"


def one_way(df: DataFrame, column: str) -> DataFrame:
    """Count, share of all rows and share of rows with a value, per level, in level order."""
    n = F.count(F.lit(1)).alias("n")
    levels = df.groupBy(column).agg(n)
    known = F.when(F.col(column).isNotNull(), F.col("n"))
    return levels.select(
        column,
        "n",
        (F.col("n") / levels.agg(F.sum("n")).scalar()).alias("percent"),
        (known / levels.agg(F.sum(known)).scalar()).alias("valid_percent"),
    ).orderBy(F.col(column).asc_nulls_last())


def percent_label(share: Column, n: Column) -> Column:
    """``12.35% (321)``; ties at the second digit go to the even neighbour."""
    return F.format_string("%.2f%% (%d)", F.bround(share * 100, 2), n)


def one_way_percent(df: DataFrame, column: str) -> DataFrame:
    """One-way table with the share as a rounded percentage and as a printed label."""
    return one_way(df, column).select(
        column,
        "n",
        F.bround(F.col("percent") * 100, 2).alias("pct"),
        percent_label(F.col("percent"), F.col("n")).alias("label"),
    )


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows per pair of values."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def _level(value: str | None) -> str:
    return NA_LEVEL if value is None else value


def two_way(
    df: DataFrame, rows: str, columns: str, values: Sequence[str | None]
) -> DataFrame:
    """Contingency table with one column per listed value; None counts the missing ones.

    Rows with any other value count in ``other_levels``, so no row is left out.
    """
    cells = [F.count_if(F.col(columns).eqNullSafe(v)).alias(_level(v)) for v in values]
    listed = reduce(Column.__or__, [F.col(columns).eqNullSafe(v) for v in values], F.lit(False))
    cells.append(F.count_if(~listed).alias(OTHER))
    return df.groupBy(rows).agg(*cells).orderBy(F.col(rows).asc_nulls_last())


def two_way_cube(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pair counts with both margins, long. Margins carry the label Total.

    Margins are told from missing values by the grouping flag, and are built from the pair counts,
    so the expansion to four grouping sets runs on the small table.
    """
    label = lambda c: F.when(F.grouping(c) == 1, TOTAL).otherwise(F.col(c)).alias(f"{c}_level")
    return (
        pair_counts(df, a, b)
        .cube(a, b)
        .agg(
            label(a),
            label(b),
            F.sum("n").alias("total"),
            F.grouping_id().cast("int").alias("margin"),
        )
        .select(f"{a}_level", f"{b}_level", "margin", F.col("total").alias("n"))
    )


def two_way_totals(
    df: DataFrame, rows: str, columns: str, values: Sequence[str | None]
) -> DataFrame:
    """Contingency table with a total row and a total column, to which the cells add up.

    Rows with a value that is not listed count in ``other_levels``.
    """
    cell = lambda v: F.when(F.col(columns).eqNullSafe(v), F.col("n")).otherwise(0)
    listed = reduce(Column.__or__, [F.col(columns).eqNullSafe(v) for v in values], F.lit(False))
    other = F.when(~listed, F.col("n")).otherwise(0)
    return (
        pair_counts(df, rows, columns)
        .rollup(rows)
        .agg(
            F.grouping(rows).alias("is_total"),
            *[F.sum(cell(v)).alias(_level(v)) for v in values],
            F.sum(other).alias(OTHER),
            F.sum("n").alias("total"),
        )
        .select(
            F.when(F.col("is_total") == 1, TOTAL).otherwise(F.col(rows)).alias(rows),
            *[f"`{_level(v)}`" for v in values],
            OTHER,
            "total",
            F.col("is_total").cast("int").alias("is_total"),
        )
        .orderBy("is_total", F.col(rows).asc_nulls_last())
    )
