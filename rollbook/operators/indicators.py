"""Service indicators: counts over a register or over each of its groups.

Each report is one scan and one aggregate. Groups combine before the shuffle, so a region that
holds most rows costs no more than the others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.values import YES, is_positive, is_value, is_yes
from rollbook.operators import blocks
from rollbook.operators.blocks import Package
from rollbook.operators.columns import starts_with


def count_rows(
    df: DataFrame, conditions: Mapping[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """Rows that meet each condition; unknown does not count, and an empty group gives 0."""
    return df.groupBy(*by).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def value_conditions(
    df: DataFrame, *prefixes: str, value: str = YES, ignore_case: bool = False
) -> dict[str, Column]:
    """One condition per column with a prefix: the cell equals the value."""
    names = starts_with(df, *prefixes)
    if value == YES:
        return {c: is_yes(df, c, ignore_case) for c in names}
    return {c: is_value(F.col(c), value, ignore_case) for c in names}


def positive_conditions(df: DataFrame, *prefixes: str) -> dict[str, Column]:
    return {c: is_positive(df, c) for c in starts_with(df, *prefixes)}


def count_value(
    df: DataFrame,
    *prefixes: str,
    value: str = YES,
    by: Sequence[str] = (),
    ignore_case: bool = False,
) -> DataFrame:
    """For each column with a prefix, the cells equal to a literal."""
    conditions = value_conditions(df, *prefixes, value=value, ignore_case=ignore_case)
    return count_rows(df, conditions, by)


def count_positive(df: DataFrame, *prefixes: str, by: Sequence[str] = ()) -> DataFrame:
    """For each column with a prefix, the quantities above zero."""
    return count_rows(df, positive_conditions(df, *prefixes), by)


def packed_counts(
    df: DataFrame, groups: Mapping[str, Mapping[str, Column]], by: Sequence[str] = ()
) -> DataFrame:
    """Several sets of counts in one row, each set packed into one struct column."""
    return df.groupBy(*by).agg(
        *[
            F.struct(*[F.count_if(c).alias(name) for name, c in conditions.items()]).alias(group)
            for group, conditions in groups.items()
        ]
    )


def service_education_condoms(
    df: DataFrame, package: Package = Package(), by: Sequence[str] = ()
) -> DataFrame:
    """Monthly STI, peer and risk counts in one struct, condom counts in another."""
    return packed_counts(
        df,
        {
            "peer_education": value_conditions(df, package.sti, package.peer, package.risk),
            "condoms_distributed": positive_conditions(df, package.condoms),
        },
        by,
    )


def any_month_conditions(
    df: DataFrame, package: Package = Package(), ignore_case: bool = False
) -> dict[str, Column]:
    return {
        "sti_any": blocks.any_yes(df, package.sti, ignore_case),
        "peer_any": blocks.any_yes(df, package.peer, ignore_case),
        "risk_any": blocks.any_yes(df, package.risk, ignore_case),
        "condoms_any": blocks.any_positive(df, package.condoms),
    }


def package_conditions(
    df: DataFrame, package: Package = Package(), ignore_case: bool = False
) -> dict[str, Column]:
    """The four readings of the package indicator."""
    flags = blocks.package_flags(df, package, ignore_case)
    return {
        "package_any_month": blocks.package_any_month(df, package, ignore_case),
        "package_same_month": blocks.package_same_month(df, package, ignore_case),
        "package_from_flags": blocks.package_from_flags(flags),
        "aligned_any": blocks.aligned_months(df, package, ignore_case) >= 1,
    }


def nonzero_columns(counts: DataFrame) -> DataFrame:
    """A one-row count result as (column_name, n), without the columns that counted nothing."""
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("n")) for c in counts.columns
    ]
    return counts.select(F.inline(F.array(*cells))).filter(F.col("n") > 0)


def keep_nonzero_columns(counts: DataFrame) -> DataFrame:
    """The same selection kept wide; reads the one-row result to choose the columns."""
    row = counts.first()
    return counts.select(*[f"`{c}`" for c in counts.columns if row[c] and row[c] > 0])
