"""Projections: keeping, dropping, lowering and swapping columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rollbook.functions.values import if_na

# Prefixes of the dashboard columns.
DASHBOARD_PREFIXES = (
    "county", "region", "sr_name", "age", "sex", "peer_educator", "hiv_status_at_enrollment",
    "received_peer_education", "tested_for_hiv", "screened_for_stis", "condoms_distributed_nmbr",
    "screened_for_tb", "provided_with_risk_reduction_couselling", "initiated_on_prep",
)
# The prefix that the dashboard of one register has besides.
NEEDLE_PREFIX = "needles_and_syringes_distributed_nmbr"
NEEDLE_DASHBOARD_PREFIXES = (*DASHBOARD_PREFIXES, NEEDLE_PREFIX)


def starts_with(df: DataFrame, *prefixes: str) -> list[str]:
    """Column names with one of the prefixes, in frame order, ignoring case."""
    wanted = tuple(p.lower() for p in prefixes)
    return [c for c in df.columns if c.lower().startswith(wanted)]


def select_prefixes(
    df: DataFrame, prefixes: Sequence[str] = DASHBOARD_PREFIXES, anchored: bool = True
) -> DataFrame:
    """Keep columns by prefix list.

    ``anchored=False`` reproduces the unbracketed pattern ``^a|b|c``, where only the first prefix
    has to start the name and the others match anywhere.
    """
    alternatives = "|".join(prefixes)
    pattern = re.compile(f"^(?:{alternatives})" if anchored else f"^{alternatives}")
    return df.select(*[f"`{c}`" for c in df.columns if pattern.search(c)])


def lower_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Lower-case all text columns, or the listed ones."""
    chosen = set(df.columns if columns is None else columns)
    return df.select(
        *[
            F.lower(f"`{f.name}`").alias(f.name)
            if f.name in chosen and isinstance(f.dataType, StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def swap_where(df: DataFrame, condition: Column, a: str, b: str, na: str = "keep") -> DataFrame:
    """Exchange two columns on the rows that meet a condition.

    Where the condition is unknown the row stays as it is (``na="keep"``) or both cells become
    NULL (``na="blank"``). Both outputs read the old values, since they are set in one projection.
    """
    if na == "keep":
        pick = lambda other, own: F.when(condition, other).otherwise(own)
    elif na == "blank":
        pick = lambda other, own: if_na(condition, other, own)
    else:
        raise ValueError(f"na must be 'keep' or 'blank', not {na!r}")
    return df.withColumns({a: pick(F.col(b), F.col(a)), b: pick(F.col(a), F.col(b))})
