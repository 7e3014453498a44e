"""The register view: one client row per order, from orders, customer, nation and region.

The tables have no missing cells, so modulo rules put NULL, blank and bad text in. Each expression
uses only functions that Spark SQL and DuckDB share, so the same text serves both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.session import tune_for_wide_rows

REGIONS = ("COR", "LER", "NRR", "UER", "WKR")
KEY = "o.o_orderkey"

COLUMNS: dict[str, str] = {
    "sno": KEY,
    "region": "CASE r.r_name WHEN 'AFRICA' THEN 'COR' WHEN 'AMERICA' THEN 'LER' "
    "WHEN 'ASIA' THEN 'NRR' WHEN 'EUROPE' THEN 'UER' ELSE 'WKR' END",
    "county": "n.n_name",
    "sr_name": "c.c_mktsegment",
    "kp_type": f"CASE WHEN {KEY} % 97 = 0 THEN '' WHEN {KEY} % 89 = 0 THEN NULL "
    f"WHEN {KEY} % 4 = 0 THEN 'FSW' WHEN {KEY} % 4 = 1 THEN 'MSM' "
    f"WHEN {KEY} % 4 = 2 THEN 'PWID' ELSE 'TG' END",
    "kp_unique_identifier": f"CASE WHEN {KEY} % 101 = 0 THEN NULL ELSE "
    "concat(lpad(CAST(c.c_nationkey AS VARCHAR(2)), 2, '0'), '_', "
    "CAST(o.o_custkey AS VARCHAR(10))) END",
    "kp_name": "CASE WHEN o.o_custkey % 31 = 0 THEN NULL ELSE c.c_name END",
    "peer_educator": f"concat('PE_', CAST({KEY} % 40 AS VARCHAR(3)))",
    "sex": f"CASE {KEY} % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'MALE' WHEN 2 THEN 'Female' "
    "ELSE NULL END",
    "age": f"CASE WHEN {KEY} % 53 = 0 THEN 'n/a' WHEN {KEY} % 59 = 0 THEN NULL "
    f"WHEN {KEY} % 61 = 0 THEN '140' ELSE CAST(18 + o.o_custkey % 50 AS VARCHAR(3)) END",
    "yob": f"CASE WHEN {KEY} % 59 = 0 THEN NULL "
    "ELSE CAST(2006 - o.o_custkey % 50 AS VARCHAR(4)) END",
    "hiv_status_at_enrollment": f"CASE {KEY} % 10 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' "
    "WHEN 2 THEN 'Unknown' WHEN 3 THEN 'Uknown' WHEN 4 THEN 'Known positive' "
    "WHEN 5 THEN 'known Positive' WHEN 6 THEN 'unknown' WHEN 7 THEN 'Known Positive' "
    "WHEN 8 THEN 'Negative' ELSE NULL END",
    "date_of_first_contact": f"CASE WHEN {KEY} % 47 = 0 THEN NULL "
    f"ELSE DATE '2023-01-01' + CAST({KEY} % 300 AS INT) END",
    "date_of_enrolment": f"CASE WHEN {KEY} % 43 = 0 THEN NULL "
    f"ELSE DATE '2023-01-01' + CAST({KEY} % 300 + {KEY} % 11 - 2 AS INT) END",
    "date_of_next_appointment": f"CASE WHEN {KEY} % 41 = 0 THEN 'TBD' "
    f"WHEN {KEY} % 37 = 0 THEN NULL ELSE CAST(45292 + {KEY} % 180 AS VARCHAR(10)) END",
    "remarks": "CAST(NULL AS VARCHAR(10))",
}

# Service, then per month: column suffix, modulus, Yes below, missing from.
YES_BLOCKS = {
    "received_peer_education": ((22, 11, 3, 10), (75, 13, 4, 11), (128, 17, 5, 15)),
    "screened_for_stis": ((61, 19, 6, 17), (114, 23, 7, 20), (167, 29, 9, 26)),
    "provided_with_risk_reduction_couselling": (
        (68, 31, 9, 27), (121, 37, 11, 33), (174, 41, 12, 36),
    ),
    "screened_for_tb": ((63, 43, 13, 38), (116, 47, 14, 41), (169, 53, 16, 47)),
    "tested_for_hiv": ((50, 59, 18, 52), (103, 61, 18, 54), (156, 67, 20, 59)),
    "initiated_on_prep": ((56, 71, 21, 62), (109, 73, 22, 64), (162, 79, 24, 70)),
    "received_clinical_services": ((70, 83, 25, 73), (123, 89, 27, 78), (176, 97, 29, 85)),
    "received_needles_and_syringes_per_need": (
        (47, 101, 30, 89), (100, 103, 31, 91), (153, 107, 32, 94),
    ),
}
# Per month: column suffix, modulus, zero below, missing from; a multiple is the text none.
QUANTITY_BLOCKS = {
    "condoms_distributed_nmbr": ((46, 109, 54, 96), (99, 113, 56, 99), (152, 127, 64, 112)),
    "needles_and_syringes_distributed_nmbr": (
        (48, 131, 66, 115), (101, 137, 68, 121), (154, 139, 70, 122),
    ),
}
STATUS_SUFFIXES = (51, 104, 157)

for _service, _months in YES_BLOCKS.items():
    for _suffix, _mod, _yes, _missing in _months:
        COLUMNS[f"{_service}{_suffix}"] = (
            f"CASE WHEN {KEY} % {_mod} < {_yes} THEN 'Yes' "
            f"WHEN {KEY} % {_mod} >= {_missing} THEN NULL ELSE 'No' END"
        )
for _service, _months in QUANTITY_BLOCKS.items():
    for _suffix, _mod, _zero, _missing in _months:
        COLUMNS[f"{_service}{_suffix}"] = (
            f"CASE WHEN {KEY} % {_mod} = 0 THEN 'none' WHEN {KEY} % {_mod} < {_zero} THEN '0' "
            f"WHEN {KEY} % {_mod} >= {_missing} THEN NULL ELSE CAST({KEY} % {_mod} AS VARCHAR(10)) END"
        )
for _suffix in STATUS_SUFFIXES:
    COLUMNS[f"hiv_status{_suffix}"] = (
        f"CASE ({KEY} + {_suffix}) % 4 WHEN 0 THEN 'known positive' WHEN 1 THEN 'negative' "
        "WHEN 2 THEN NULL ELSE 'unknown' END"
    )


# The columns in use, declared so that no job has to infer them.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register as a lazy DataFrame. Columns that a query does not use are never computed.

    Customers are resolved to their region before orders join them, so that a region filter
    shrinks the customer side first. The join strategy is left to the optimizer's size checks and
    to adaptive skew splitting.
    """
    tune_for_wide_rows(spark)
    orders = table(spark, sf_dir, "orders").alias("o")
    customer = table(spark, sf_dir, "customer").alias("c")
    nation = table(spark, sf_dir, "nation").alias("n")
    region = table(spark, sf_dir, "region").alias("r")
    places = nation.join(region, F.expr("n.n_regionkey = r.r_regionkey"))
    clients = customer.join(places, F.expr("c.c_nationkey = n.n_nationkey"))
    return orders.join(clients, F.expr("o.o_custkey = c.c_custkey")).select(
        *[F.expr(text).alias(name) for name, text in COLUMNS.items()]
    )


def columns_of(*services: str) -> list[str]:
    """Monthly columns of the named services, in view order."""
    return [c for c in COLUMNS if c.startswith(services) and c[-1].isdigit()]


def with_register(query: str, columns: Sequence[str] | None = None) -> str:
    """SQL text with the view as the CTE ``register``."""
    chosen = COLUMNS if columns is None else {c: COLUMNS[c] for c in columns}
    select = ",\n  ".join(f"{text} AS {name}" for name, text in chosen.items())
    return (
        f"WITH register AS (\n  SELECT {select}\n  FROM orders o\n"
        "  JOIN customer c ON c.c_custkey = o.o_custkey\n"
        "  JOIN nation n ON n.n_nationkey = c.c_nationkey\n"
        f"  JOIN region r ON r.r_regionkey = n.n_regionkey\n)\n{query}"
    )
