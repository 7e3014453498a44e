"""Queries on service indicators and monthly blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.operators import blocks, indicators
from rollbook.operators.blocks import Package
from rollbook.operators.columns import NEEDLE_PREFIX
from rollbook.plans.indicators import NEEDLES_PER_NEED, STATUS_PREFIX, YES_SERVICES
from workload.catalog import (
    ALIGNED_MONTHS,
    CONDOMS,
    NEEDLES,
    PACKAGE_ANY,
    PACKAGE_FLAGS,
    PACKAGE_SAME,
    PEER,
    RISK,
    STI,
    any_positive,
    any_yes,
    count_where,
    flag,
    months,
    number,
    query,
    strict_total,
)
from workload.register import COLUMNS, register

PACKAGE = Package()


def _yes_counts(*services: str) -> str:
    return ", ".join(f"{count_where(f"{c} = 'Yes'")} AS {c}" for s in services for c in months(s))


def _positive_counts(*services: str) -> str:
    return ", ".join(
        f"{count_where(f'{number(c)} > 0')} AS {c}" for s in services for c in months(s)
    )


@query(f"SELECT {_yes_counts(*YES_SERVICES)} FROM register")
def ind_count_yes(spark, sf_dir):
    return indicators.count_value(register(spark, sf_dir), *YES_SERVICES)


_STATUS_COLUMNS = [c for c in COLUMNS if c.startswith("hiv_status")]


@query(
    "SELECT "
    + ", ".join(f"{count_where(f"{c} = 'No'")} AS {c}" for c in months(NEEDLES_PER_NEED))
    + ", "
    + ", ".join(f"{count_where(f"{c} = 'known positive'")} AS {c}" for c in _STATUS_COLUMNS)
    + " FROM register"
)
def ind_count_value(spark, sf_dir):
    df = register(spark, sf_dir)
    return indicators.count_rows(
        df,
        {
            **indicators.value_conditions(df, NEEDLES_PER_NEED, value="No"),
            **indicators.value_conditions(df, STATUS_PREFIX, value="known positive"),
        },
    )


@query(f"SELECT {_positive_counts(CONDOMS, NEEDLES)} FROM register")
def ind_count_positive(spark, sf_dir):
    return indicators.count_positive(register(spark, sf_dir), CONDOMS, NEEDLE_PREFIX)


@query(f"SELECT {_yes_counts(PEER, STI, RISK)}, {_positive_counts(CONDOMS)} FROM register")
def ind_packed_struct(spark, sf_dir):
    packed = indicators.service_education_condoms(register(spark, sf_dir))
    return packed.select("peer_education.*", "condoms_distributed.*")


@query(
    f"SELECT {count_where(any_yes(STI))} AS sti_any, {count_where(any_yes(PEER))} AS peer_any, "
    f"{count_where(any_yes(RISK))} AS risk_any, {count_where(any_positive(CONDOMS))} AS condoms_any "
    "FROM register"
)
def ind_any_month(spark, sf_dir):
    df = register(spark, sf_dir)
    return indicators.count_rows(df, indicators.any_month_conditions(df))


@query(f"SELECT region, {count_where(PACKAGE_ANY)} AS jan_to_march FROM register GROUP BY region")
def ind_package_any_month(spark, sf_dir):
    df = blocks.parse_package(register(spark, sf_dir))
    return indicators.count_rows(df, {"jan_to_march": blocks.package_any_month(df)}, ["region"])


@query(f"SELECT region, {count_where(PACKAGE_SAME)} AS jan_to_march FROM register GROUP BY region")
def ind_package_same_month(spark, sf_dir):
    df = blocks.parse_package(register(spark, sf_dir))
    return indicators.count_rows(df, {"jan_to_march": blocks.package_same_month(df)}, ["region"])


@query(f"SELECT region, count(*) AS n FROM register WHERE {PACKAGE_FLAGS} GROUP BY region")
def ind_defined_package_flags(spark, sf_dir):
    df = blocks.parse_package(register(spark, sf_dir))
    flags = blocks.package_flags(df)
    flagged = df.withColumns(flags)
    reached = flagged.filter(blocks.package_from_flags({c: F.col(c) for c in flags}))
    return reached.groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT region, {count_where(f'{ALIGNED_MONTHS} >= 1')} AS n FROM register GROUP BY region")
def ind_aligned_any(spark, sf_dir):
    df = blocks.parse_package(register(spark, sf_dir))
    return indicators.count_rows(df, {"n": blocks.aligned_months(df) >= 1}, ["region"])


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {count_where(f'{number(c)} > 0')} AS n FROM register"
        for c in months(NEEDLES)
    )
)
def agg_nonzero_columns(spark, sf_dir):
    df = register(spark, sf_dir)
    counts = indicators.count_positive(df, NEEDLE_PREFIX, "remarks")
    return indicators.nonzero_columns(counts)


# ---- row-wise ---------------------------------------------------------------------------------


def _month_count(tests) -> str:
    return " + ".join(f"coalesce(CAST({t} AS BIGINT), 0)" for t in tests)


def _yes_months(service: str) -> str:
    return _month_count(f"({c} = 'Yes')" for c in months(service))


@query(
    f"SELECT sno, {_yes_months(STI)} AS screened_for_sti_count, "
    f"{_yes_months(PEER)} AS peer_education_count, "
    f"{_yes_months(RISK)} AS risk_reduction_counseling_count, "
    + _month_count(f"({number(c)} > 0)" for c in months(CONDOMS))
    + " AS condoms_distributed_count FROM register"
)
def row_month_counts(spark, sf_dir):
    df = register(spark, sf_dir)
    return df.select(
        "sno",
        blocks.months_yes(df, PACKAGE.sti).alias("screened_for_sti_count"),
        blocks.months_yes(df, PACKAGE.peer).alias("peer_education_count"),
        blocks.months_yes(df, PACKAGE.risk).alias("risk_reduction_counseling_count"),
        blocks.months_positive(df, PACKAGE.condoms).alias("condoms_distributed_count"),
    )


@query(f"SELECT sno, {ALIGNED_MONTHS} AS either_condition_count FROM register")
def row_aligned_blocks(spark, sf_dir):
    df = blocks.parse_package(register(spark, sf_dir))
    return df.select("sno", blocks.aligned_months(df).alias("either_condition_count"))


@query(
    f"SELECT sno, {flag(PEER)} AS received_peer_education, {flag(RISK)} AS rssh, "
    f"{flag(STI)} AS screened_sti FROM register"
)
def row_any_flag(spark, sf_dir):
    df = register(spark, sf_dir)
    return df.select(
        "sno",
        blocks.any_flag(df, PACKAGE.peer).alias("received_peer_education"),
        blocks.any_flag(df, PACKAGE.risk).alias("rssh"),
        blocks.any_flag(df, PACKAGE.sti).alias("screened_sti"),
    )


_FILLED = [f"coalesce({number(c)}, 0.0)" for c in months(CONDOMS)]


@query(
    f"SELECT sno, {strict_total(CONDOMS)} AS condom_distributed, "
    f"CASE WHEN {' OR '.join(f'{m} > 0' for m in _FILLED)} THEN {' + '.join(_FILLED)} ELSE 0.0 END "
    "AS condoms_known FROM register"
)
def row_quantity_total(spark, sf_dir):
    df = blocks.parse_package(register(spark, sf_dir))
    return df.select(
        "sno",
        blocks.quantity_total(df, PACKAGE.condoms).alias("condom_distributed"),
        blocks.quantity_total(df, PACKAGE.condoms, skip_null=True).alias("condoms_known"),
    )


_LONG = (STI, PEER, RISK, CONDOMS)


@query(
    " UNION ALL ".join(
        f"SELECT sno, '{s}' AS metric, CAST({i} AS INT) AS month, {c} AS value FROM register"
        for s in _LONG
        for i, c in enumerate(months(s), 1)
    )
)
def row_blocks_to_long(spark, sf_dir):
    return blocks.blocks_to_long(register(spark, sf_dir), ["sno"], _LONG)
