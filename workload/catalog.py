"""Registry of queries, and SQL text shared by their oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from workload.register import columns_of, with_register

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str


CATALOG: dict[str, Query] = {}


def query(sql: str, register: bool = True) -> Callable[[Run], Run]:
    """Register a function under its own name, with its oracle text.

    The text may use the view ``register`` unless ``register=False``.
    """

    def add(run: Run) -> Run:
        CATALOG[run.__name__] = Query(run, with_register(sql) if register else sql)
        return run

    return add


def names(*columns: str) -> str:
    return ", ".join(f'"{c}"' for c in columns)


def number(column: str) -> str:
    return f"TRY_CAST({column} AS DOUBLE)"


def count_where(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def months(service: str) -> list[str]:
    return columns_of(service)


def any_yes(service: str) -> str:
    return "(" + " OR ".join(f"{c} = 'Yes'" for c in months(service)) + ")"


def any_positive(service: str) -> str:
    return "(" + " OR ".join(f"{number(c)} > 0" for c in months(service)) + ")"


STI = "screened_for_stis"
PEER = "received_peer_education"
RISK = "provided_with_risk_reduction_couselling"
CONDOMS = "condoms_distributed_nmbr"
NEEDLES = "needles_and_syringes_distributed_nmbr"
PACKAGE_ANY = f"{any_yes(STI)} AND ({any_yes(PEER)} OR {any_yes(RISK)}) AND {any_positive(CONDOMS)}"
_ALIGNED = list(zip(months(STI), months(PEER), months(RISK), months(CONDOMS)))
PACKAGE_SAME = " OR ".join(
    f"({s} = 'Yes' AND ({r} = 'Yes' OR {p} = 'Yes') AND {number(c)} > 0)" for s, p, r, c in _ALIGNED
)
ALIGNED_MONTHS = " + ".join(
    f"coalesce(CAST((({s} = 'Yes' AND {p} = 'Yes') OR ({r} = 'Yes' AND {number(c)} > 0)) AS BIGINT), 0)"
    for s, p, r, c in _ALIGNED
)


def flag(service: str) -> str:
    test = any_yes(service)
    return f"CASE WHEN {test} THEN 'Yes' WHEN NOT {test} THEN 'No' END"


def strict_total(service: str) -> str:
    total = " + ".join(number(c) for c in months(service))
    test = any_positive(service)
    return f"CASE WHEN {test} THEN {total} WHEN NOT {test} THEN 0.0 END"


PACKAGE_FLAGS = (
    f"({flag(STI)}) = 'Yes' AND (({flag(PEER)}) = 'Yes' OR ({flag(RISK)}) = 'Yes') "
    f"AND ({strict_total(CONDOMS)}) > 0"
)
