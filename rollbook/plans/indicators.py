"""Indicator report: every service count of a register in one scan and one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions import parse_numbers, parse_yes
from rollbook.operators import indicators as ind
from rollbook.operators.blocks import Package, parse_package
from rollbook.operators.columns import NEEDLE_PREFIX, starts_with

# Prefixes of services counted as Yes per month.
YES_SERVICES = (
    "received_peer_education",
    "provided_with_risk_reduction_couselling",
    "screened_for_stis",
    "screened_for_tb",
    "tested_for_hiv",
    "initiated_on_prep",
    "received_clinical_services",
)
NEEDLES_PER_NEED = "received_needles_and_syringes_per_need"
STATUS_PREFIX = "hiv_status"


def indicator_report(
    df: DataFrame,
    by: Sequence[str] = ("region",),
    package: Package = Package(),
    ignore_case: bool = False,
) -> DataFrame:
    """Clients, any-month services, the package indicators and all monthly counts, per group."""
    services = starts_with(df, *YES_SERVICES, package.sti, package.peer, package.risk)
    df = parse_numbers(df, starts_with(df, package.condoms, NEEDLE_PREFIX))
    df = parse_yes(df, services, ignore_case)
    named = lambda conditions, tag: {f"{c}_{tag}": cond for c, cond in conditions.items()}
    value = lambda *p, v: ind.value_conditions(df, *p, value=v, ignore_case=ignore_case)
    return ind.count_rows(
        df,
        {
            "clients": F.lit(True),
            **ind.any_month_conditions(df, package, ignore_case),
            **ind.package_conditions(df, package, ignore_case),
            **named(value(*YES_SERVICES, v="Yes"), "yes"),
            **named(value(NEEDLES_PER_NEED, v="No"), "no"),
            **named(value(STATUS_PREFIX, v="known positive"), "known_positive"),
            **named(ind.positive_conditions(df, package.condoms, NEEDLE_PREFIX), "positive"),
        },
        by,
    )


def package_report(
    df: DataFrame, by: Sequence[str] = ("region",), package: Package = Package()
) -> DataFrame:
    """Clients who got the full package in one month, and under the looser readings."""
    df = parse_package(df, package)
    conditions = {"clients": F.lit(True), **ind.package_conditions(df, package)}
    return ind.count_rows(df, conditions, by)
