"""Row-wise work over repeated monthly blocks (``service22``, ``service75``, ``service128``)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.values import (
    YES,
    if_na,
    is_positive,
    is_yes,
    number_column,
    parse_numbers,
)


@dataclass(frozen=True)
class Package:
    """Column prefixes of the four services in the defined package."""

    sti: str = "screened_for_stis"
    peer: str = "received_peer_education"
    risk: str = "provided_with_risk_reduction_couselling"
    condoms: str = "condoms_distributed_nmbr"


def block_columns(df: DataFrame, prefix: str) -> list[str]:
    """The monthly columns of one service, ordered by their numeric suffix."""
    pattern = re.compile(rf"{re.escape(prefix)}(\d+)", re.IGNORECASE)
    found = [(int(m[1]), c) for c in df.columns if (m := pattern.fullmatch(c))]
    if not found:
        raise ValueError(f"no monthly columns start with {prefix!r}")
    return [c for _, c in sorted(found)]


def aligned_blocks(df: DataFrame, prefixes: Sequence[str]) -> list[tuple[str, ...]]:
    """Monthly columns of several services, paired month by month. Month counts must agree."""
    blocks = [block_columns(df, p) for p in prefixes]
    if len({len(b) for b in blocks}) > 1:
        raise ValueError(f"services differ in months: {dict(zip(prefixes, map(len, blocks)))}")
    return list(zip(*blocks))


def any_of(conditions: Sequence[Column]) -> Column:
    """Three-valued OR over months."""
    return reduce(Column.__or__, conditions)


def any_yes(df: DataFrame, prefix: str, ignore_case: bool = False) -> Column:
    return any_of([is_yes(df, c, ignore_case) for c in block_columns(df, prefix)])


def any_positive(df: DataFrame, prefix: str) -> Column:
    return any_of([is_positive(df, c) for c in block_columns(df, prefix)])


def count_months(conditions: Sequence[Column]) -> Column:
    """Number of months where a condition holds; unknown months do not count."""
    return reduce(Column.__add__, [F.coalesce(c.cast("bigint"), F.lit(0)) for c in conditions])


def months_yes(df: DataFrame, prefix: str, ignore_case: bool = False) -> Column:
    """Months in which a service is Yes."""
    return count_months([is_yes(df, c, ignore_case) for c in block_columns(df, prefix)])


def months_positive(df: DataFrame, prefix: str) -> Column:
    """Months in which a quantity is above zero."""
    return count_months([is_positive(df, c) for c in block_columns(df, prefix)])


def any_flag(df: DataFrame, prefix: str, ignore_case: bool = False) -> Column:
    """Yes if any month is Yes, No if all are known and none is, else NULL."""
    return if_na(any_yes(df, prefix, ignore_case), F.lit(YES), F.lit("No"))


def quantity_total(df: DataFrame, prefix: str, skip_null: bool = False) -> Column:
    """Sum over the months if any is above zero, else 0.

    The sum is strict: one month that is not a number makes it NULL. ``skip_null`` sums the known
    months instead.
    """
    months = [number_column(df, c) for c in block_columns(df, prefix)]
    if skip_null:
        months = [F.coalesce(m, F.lit(0.0)) for m in months]
    return if_na(any_of([m > 0 for m in months]), reduce(Column.__add__, months), F.lit(0.0))


def parse_package(df: DataFrame, package: Package = Package()) -> DataFrame:
    """The register with the quantities of the package parsed to numbers, once per cell."""
    return parse_numbers(df, block_columns(df, package.condoms))


def package_any_month(
    df: DataFrame, package: Package = Package(), ignore_case: bool = False
) -> Column:
    """STI screening, peer or risk education, and condoms, each in any month."""
    educated = any_yes(df, package.peer, ignore_case) | any_yes(df, package.risk, ignore_case)
    return (
        any_yes(df, package.sti, ignore_case) & educated & any_positive(df, package.condoms)
    )


def package_same_month(
    df: DataFrame, package: Package = Package(), ignore_case: bool = False
) -> Column:
    """The whole package inside one month."""
    blocks = aligned_blocks(df, [package.sti, package.risk, package.peer, package.condoms])
    yes = lambda c: is_yes(df, c, ignore_case)
    return any_of(
        [
            yes(sti) & (yes(risk) | yes(peer)) & is_positive(df, condoms)
            for sti, risk, peer, condoms in blocks
        ]
    )


def aligned_months(
    df: DataFrame, package: Package = Package(), ignore_case: bool = False
) -> Column:
    """Months with (STI and peer education) or (risk counselling and condoms)."""
    blocks = aligned_blocks(df, [package.sti, package.peer, package.risk, package.condoms])
    yes = lambda c: is_yes(df, c, ignore_case)
    return count_months(
        [
            (yes(sti) & yes(peer)) | (yes(risk) & is_positive(df, condoms))
            for sti, peer, risk, condoms in blocks
        ]
    )


def package_flags(
    df: DataFrame, package: Package = Package(), ignore_case: bool = False
) -> dict[str, Column]:
    """Derived per-client columns behind the flag form of the package indicator."""
    return {
        "received_peer_education": any_flag(df, package.peer, ignore_case),
        "rssh": any_flag(df, package.risk, ignore_case),
        "screened_sti": any_flag(df, package.sti, ignore_case),
        "condom_distributed": quantity_total(df, package.condoms),
    }


def package_from_flags(flags: Mapping[str, Column]) -> Column:
    """The package indicator on derived flags; differs from the raw form by the strict sum."""
    return (
        (flags["screened_sti"] == YES)
        & ((flags["received_peer_education"] == YES) | (flags["rssh"] == YES))
        & (flags["condom_distributed"] > 0)
    )


def blocks_to_long(df: DataFrame, ids: Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    """One row per client, service and month; ``month`` is the rank of the column suffix."""
    cells = [
        F.struct(
            F.lit(prefix).alias("metric"), F.lit(month).alias("month"), F.col(c).alias("value")
        )
        for prefix in prefixes
        for month, c in enumerate(block_columns(df, prefix), start=1)
    ]
    return df.select(*ids, F.inline(F.array(*cells)))
