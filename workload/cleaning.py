"""Queries on headers, projections, filters, repeated keys, stacking and value repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook import functions as fn
from rollbook.functions.recodes import REGION_CODES, SEX_CODES
from rollbook.operators import columns, dupes, headers, hygiene, stack
from workload.catalog import months, names, query
from workload.register import COLUMNS, REGIONS, register, table

ID_COLUMNS = [c for c in COLUMNS if not c[-1].isdigit()]
THIRD_MONTH = [c for c in COLUMNS if c.endswith(("128", "167", "174", "152"))]
KEY, ORDER = ["kp_unique_identifier"], ["sno"]


def ids(spark, sf_dir):
    return register(spark, sf_dir).select(*ID_COLUMNS)


# ---- headers ----------------------------------------------------------------------------------

RAW_HEADERS = {
    "sno": "S/No.",
    "region": "Region",
    "kp_unique_identifier": "KP Unique Identifier (SR/Client initials/Typology/Hotspot/PE code/Client no)",
    "kp_name": "KP's Name(3 names & nickname)",
    "date_of_enrolment": "Date of enrolment (dd/mm/yyyy)",
    "hiv_status_at_enrollment": "HIV status - at  Enrollment",
    "tested_for_hiv50": "Tested for HIV",
    "tested_for_hiv103": "Tested for HIV",
    "tested_for_hiv156": "Tested for HIV",
    "condoms_distributed_nmbr46": "% condomsDistributed #",
}
CLEANED = (
    "s_no", "region", "kp_unique_identifier_sr_client_initials_typology_hotspot_pe_code_client_no",
    "k_ps_name_3_names_nickname", "date_of_enrolment_dd_mm_yyyy", "hiv_status_at_enrollment",
    "tested_for_hiv", "tested_for_hiv_2", "tested_for_hiv_3",
    "percent_condoms_distributed_number",
)


def renamed_sql(columns, new) -> str:
    return ", ".join(f'{c} AS "{n}"' for c, n in zip(columns, new))


@query(f"SELECT {renamed_sql(RAW_HEADERS, CLEANED)} FROM register")
def hdr_clean_names(spark, sf_dir):
    raw = register(spark, sf_dir).select(*RAW_HEADERS).toDF(*RAW_HEADERS.values())
    return headers.clean_names(raw)


REPEATED_HEADERS = {
    "sno": "SNo",
    "received_peer_education22": "Received peer education",
    "screened_for_stis61": "Screened for STIs",
    "received_peer_education75": "Received peer education",
    "screened_for_stis114": "Screened for STIs",
    "remarks": "",
}
POSITIONED = (
    "sno", "received_peer_education2", "screened_for_stis3", "received_peer_education4",
    "screened_for_stis5", "6",
)


@query(f"SELECT {renamed_sql(REPEATED_HEADERS, POSITIONED)} FROM register")
def hdr_unique_names(spark, sf_dir):
    raw = register(spark, sf_dir).select(*REPEATED_HEADERS).toDF(*REPEATED_HEADERS.values())
    return headers.repair_names(headers.unique_names(raw))


CHAIN_HEADERS = {
    "sno": "S No:",
    "kp_type": "KP_Type",
    "date_of_first_contact": "Date of First-Contact (dd/mm/yyyy)",
    "sex": 'Sex "as\\recorded"',
    "tested_for_hiv50": "Complete Sessions?",
    "age": "Age <years>",
}
CHAINED = (
    "s_no", "kp_type", "date_of_first_contact_ddmmyyyy", "sex_asrecorded", "complete_sessions",
    "age_years",
)


@query(f"SELECT {renamed_sql(CHAIN_HEADERS, CHAINED)} FROM register")
def hdr_rule_chain(spark, sf_dir):
    raw = register(spark, sf_dir).select(*CHAIN_HEADERS).toDF(*CHAIN_HEADERS.values())
    return headers.repair_names(raw, headers.TRACKER_RULES)


EXPORT_SOURCE = (
    "kp_unique_identifier", "date_of_next_appointment", "kp_name", "date_of_first_contact",
    "date_of_enrolment", "sno",
)
RENAMED = (
    "kp_unique_identifier", "date_of_next_appointment", "kp_name", "date_of_first_contact",
    "date_of_enrollment", "sno",
)


@query(f"SELECT {renamed_sql(EXPORT_SOURCE, RENAMED)} FROM register")
def proj_rename(spark, sf_dir):
    raw = register(spark, sf_dir).select(*EXPORT_SOURCE)
    return headers.rename_columns(raw.toDF(*headers.EXPORT_RENAMES, "sno"), headers.EXPORT_RENAMES)


@query(f"SELECT {names(*ID_COLUMNS)} FROM register")
def proj_positional_rename(spark, sf_dir):
    other = ids(spark, sf_dir).toDF(*[f"column {i}" for i in range(len(ID_COLUMNS))])
    return headers.rename_by_position(other, ID_COLUMNS)


@query(
    "SELECT column_name, n_values FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n_values FROM register" for c in THIRD_MONTH
    )
    + ") d"
)
def schema_diff(spark, sf_dir):
    left = register(spark, sf_dir)
    return headers.schema_diff(left, left.drop(*THIRD_MONTH))


# ---- projections ------------------------------------------------------------------------------


@query(f"SELECT {names(*[c for c in ID_COLUMNS if c != 'remarks'])} FROM register")
def proj_drop(spark, sf_dir):
    return ids(spark, sf_dir).drop("remarks")


@query("SELECT sr_name, kp_unique_identifier, date_of_first_contact FROM register")
def proj_select(spark, sf_dir):
    return register(spark, sf_dir).select("sr_name", "kp_unique_identifier", "date_of_first_contact")


DASHBOARD = [c for c in COLUMNS if c.startswith(columns.DASHBOARD_PREFIXES)]


@query(f"SELECT {names(*DASHBOARD)} FROM register")
def proj_prefix_select(spark, sf_dir):
    df = register(spark, sf_dir).withColumnRenamed("kp_name", "name_at_age_15")
    return columns.select_prefixes(df)


@query(f"SELECT {names(*DASHBOARD)}, kp_name AS name_at_age_15 FROM register")
def proj_prefix_select_as_written(spark, sf_dir):
    df = register(spark, sf_dir).withColumnRenamed("kp_name", "name_at_age_15")
    return columns.select_prefixes(df, anchored=False)


@query(f"SELECT {names(*[c for c in COLUMNS if c != 'remarks'])} FROM register")
def hyg_empty_cols(spark, sf_dir):
    return hygiene.drop_empty_columns(register(spark, sf_dir))


_KEEP_CASE = {"sno", "date_of_first_contact", "date_of_enrolment"}


@query(
    "SELECT "
    + ", ".join(c if c in _KEEP_CASE else f"lower({c}) AS {c}" for c in ID_COLUMNS)
    + " FROM register"
)
def val_lower_all(spark, sf_dir):
    return columns.lower_text(ids(spark, sf_dir))


def _some_regions_unknown(spark, sf_dir):
    df = register(spark, sf_dir).select(
        "sno", "region", "county", "sr_name", "kp_type", "kp_unique_identifier"
    )
    return df.withColumn("region", F.expr("CASE WHEN sno % 67 = 0 THEN NULL ELSE region END"))


_UNKNOWN = (
    "SELECT {} FROM (SELECT * REPLACE (CASE WHEN sno % 67 = 0 THEN NULL ELSE region END AS region) "
    "FROM register) u"
)


def _swapped(region: str, a: str, b: str) -> str:
    return (
        f"CASE WHEN region = '{region}' THEN {b} ELSE {a} END AS {a}, "
        f"CASE WHEN region = '{region}' THEN {a} ELSE {b} END AS {b}"
    )


@query(
    _UNKNOWN.format(
        "sno, region, "
        + _swapped("LER", "sr_name", "county")
        + ", "
        + _swapped("WKR", "kp_type", "kp_unique_identifier")
    )
)
def val_conditional_swap(spark, sf_dir):
    df = _some_regions_unknown(spark, sf_dir)
    df = columns.swap_where(df, F.col("region") == "LER", "sr_name", "county")
    return columns.swap_where(df, F.col("region") == "WKR", "kp_type", "kp_unique_identifier")


@query(
    _UNKNOWN.format(
        "sno, region, "
        "CASE WHEN region = 'COR' THEN county WHEN region <> 'COR' THEN sr_name END AS sr_name, "
        "CASE WHEN region = 'COR' THEN sr_name WHEN region <> 'COR' THEN county END AS county"
    )
)
def val_conditional_swap_na(spark, sf_dir):
    df = _some_regions_unknown(spark, sf_dir).select("sno", "region", "sr_name", "county")
    return columns.swap_where(df, F.col("region") == "COR", "sr_name", "county", na="blank")


# ---- filters ----------------------------------------------------------------------------------


@query(f"SELECT {names(*ID_COLUMNS)} FROM register WHERE kp_type <> ''")
def flt_nonblank(spark, sf_dir):
    return hygiene.keep_nonblank(ids(spark, sf_dir), "kp_type")


@query(f"SELECT {names(*ID_COLUMNS)} FROM register WHERE date_of_enrolment IS NULL")
def flt_missing_date(spark, sf_dir):
    return hygiene.keep_missing(ids(spark, sf_dir), "date_of_enrolment")


@query(f"SELECT {names(*ID_COLUMNS)} FROM register WHERE date_of_first_contact > date_of_enrolment")
def flt_date_order_error(spark, sf_dir):
    return hygiene.date_order_errors(
        ids(spark, sf_dir), "date_of_first_contact", "date_of_enrolment"
    )


@query(f"SELECT {names(*ID_COLUMNS)} FROM register WHERE sno % 500 <> 0")
def hyg_empty_rows(spark, sf_dir):
    df = ids(spark, sf_dir)
    emptied = df.select(
        "sno",
        *[F.when(F.col("sno") % 500 != 0, F.col(c)).alias(c) for c in ID_COLUMNS if c != "sno"],
    )
    return hygiene.drop_empty_rows(emptied, lineage=["sno"])


# ---- repeated keys ----------------------------------------------------------------------------


def _ranked(keys: str, keep: str) -> str:
    return (
        f"SELECT {names(*ID_COLUMNS)} FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY {keys} ORDER BY sno) AS place FROM register) d WHERE {keep}"
    )


@query(_ranked("kp_unique_identifier", "place > 1"))
def dup_later_rows(spark, sf_dir):
    return dupes.later_rows(ids(spark, sf_dir), KEY, ORDER)


@query(_ranked("kp_unique_identifier", "place = 1"))
def dup_keep_first(spark, sf_dir):
    return dupes.first_rows(ids(spark, sf_dir), KEY, ORDER)


@query(
    f"SELECT dupe_count, {names(*ID_COLUMNS)} FROM (SELECT *, count(*) OVER "
    "(PARTITION BY kp_unique_identifier) AS dupe_count FROM register) d WHERE dupe_count > 1"
)
def dup_get_dupes(spark, sf_dir):
    return dupes.get_dupes(ids(spark, sf_dir), KEY, ORDER)


@query(_ranked("kp_name, kp_unique_identifier", "place > 1"))
def dup_composite_key(spark, sf_dir):
    return dupes.later_rows(ids(spark, sf_dir), ["kp_name", "kp_unique_identifier"], ORDER)


@query(_ranked("kp_name", "place > 1"))
def dup_by_name(spark, sf_dir):
    return dupes.later_rows(ids(spark, sf_dir), ["kp_name"], ORDER)


LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_REST = [
    "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]


@query(
    f"SELECT {names(*LINE_KEY, *LINE_REST)} FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY {names(*LINE_KEY)} ORDER BY {names(*LINE_REST)}) AS place FROM lineitem) d "
    "WHERE place > 1",
    register=False,
)
def dup_lineitem_later_rows(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*LINE_KEY, *LINE_REST)
    return dupes.later_rows(df, LINE_KEY, [*LINE_REST, *LINE_KEY])


# ---- stacking ---------------------------------------------------------------------------------

_RANK = "CASE region " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(REGIONS, 1)) + " END"


@query(f"SELECT {names(*ID_COLUMNS)}, {_RANK} AS source_rank, sno AS row_in_source FROM register")
def set_stack_regions(spark, sf_dir):
    df = ids(spark, sf_dir)
    slices = []
    for rank, region in enumerate(REGIONS, start=1):
        own = df.filter(F.col("region") == region).toDF(*[f"{region} {c}" for c in ID_COLUMNS])
        named = headers.rename_by_position(own, ID_COLUMNS)
        slices.append(stack.with_lineage(named, rank, "sno"))
    return stack.stack(slices)


_PEER = months("received_peer_education")


@query(
    f"SELECT sno, region, {names(*_PEER[:2])}, "
    f"CASE WHEN region <> 'LER' THEN {_PEER[2]} END AS {_PEER[2]} FROM register"
)
def set_bind_rows(spark, sf_dir):
    df = register(spark, sf_dir).select("sno", "region", *_PEER)
    shorter = df.filter(F.col("region") == "LER").drop(_PEER[2])
    return stack.bind_rows([df.filter(F.col("region") != "LER"), shorter])


# ---- values -----------------------------------------------------------------------------------


@query(
    "SELECT sno, peer_educator, CASE WHEN sex = 'Male' THEN 'MALE' WHEN sex <> 'Male' THEN sex END "
    "AS sex, CASE WHEN kp_type = 'TG' THEN 'yes' WHEN kp_type <> 'TG' THEN 'no' END AS is_tg "
    "FROM register"
)
def sca_if_na(spark, sf_dir):
    male, tg = F.col("sex") == "Male", F.col("kp_type") == "TG"
    return register(spark, sf_dir).select(
        "sno",
        "peer_educator",
        fn.if_na(male, F.lit("MALE"), F.col("sex")).alias("sex"),
        fn.if_na(tg, F.lit("yes"), F.lit("no")).alias("is_tg"),
    )


@query(
    "SELECT sno, age, TRY_CAST(age AS DOUBLE) AS age_number, "
    "TRY_CAST(condoms_distributed_nmbr46 AS DOUBLE) AS condoms FROM register"
)
def sca_to_number(spark, sf_dir):
    return register(spark, sf_dir).select(
        "sno",
        "age",
        fn.to_number(F.col("age")).alias("age_number"),
        fn.to_number(F.col("condoms_distributed_nmbr46")).alias("condoms"),
    )


@query("SELECT sno, upper(lower(county)) AS county FROM register")
def val_upper_county(spark, sf_dir):
    lowered = columns.lower_text(register(spark, sf_dir).select("sno", "county"))
    return lowered.withColumn("county", F.upper("county"))


@query(
    "SELECT sno, kp_unique_identifier, CASE WHEN substring(kp_unique_identifier, 1, 2) = '05' "
    "THEN 'LAMU' WHEN substring(kp_unique_identifier, 1, 2) <> '05' THEN county END AS county "
    "FROM register"
)
def val_prefix_to_county(spark, sf_dir):
    df = register(spark, sf_dir).select("sno", "kp_unique_identifier", "county")
    place = fn.place_from_code(F.col("kp_unique_identifier"), F.col("county"))
    return df.withColumn("county", place)


@query(
    "SELECT sno, coalesce(kp_name, 'NA') || coalesce(kp_unique_identifier, 'NA') AS kp_uniq "
    "FROM register"
)
def sca_concat_na(spark, sf_dir):
    pasted = fn.concat_na(F.col("kp_name"), F.col("kp_unique_identifier"))
    return register(spark, sf_dir).select("sno", pasted.alias("kp_uniq"))


@query(
    "SELECT sno, date_of_next_appointment AS serial, CASE WHEN "
    "TRY_CAST(date_of_next_appointment AS DOUBLE) IS NOT NULL THEN DATE '1899-12-30' + "
    "CAST(floor(TRY_CAST(date_of_next_appointment AS DOUBLE)) AS INT) END AS next_appointment "
    "FROM register"
)
def sca_excel_date(spark, sf_dir):
    serial = F.col("date_of_next_appointment")
    return register(spark, sf_dir).select(
        "sno", serial.alias("serial"), fn.excel_date(serial).alias("next_appointment")
    )


@query(
    "SELECT o_orderkey AS sno, CAST(o_orderdate AS DATE) AS from_timestamp, "
    "CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS from_text "
    "FROM orders",
    register=False,
)
def sca_to_date(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    text = F.expr(
        "CASE WHEN o_orderkey % 41 = 0 THEN 'TBD' "
        "WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'yyyy/MM/dd') "
        "ELSE date_format(o_orderdate, 'yyyy-MM-dd') END"
    )
    return orders.select(
        F.col("o_orderkey").alias("sno"),
        F.to_date("o_orderdate").alias("from_timestamp"),
        fn.text_date(text).alias("from_text"),
    )


@query(
    "SELECT o_orderkey AS sno, strftime(CAST(o_orderdate AS DATE), '%y-%m-%d') AS run_date "
    "FROM orders",
    register=False,
)
def sca_run_date(spark, sf_dir):
    label = fn.run_date_label(F.to_date("o_orderdate")).alias("run_date")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sno"), label)


@query(
    "SELECT sno, CASE WHEN region = 'NRR' THEN 'NRR' ELSE region END AS region, "
    "CASE WHEN sex = 'Male' THEN 'MALE' ELSE sex END AS sex FROM register"
)
def val_recode_literal(spark, sf_dir):
    df = register(spark, sf_dir).select("sno", "region", "sex")
    long_name = F.when(F.col("region") == "NRR", "North Rift Region").otherwise(F.col("region"))
    return df.withColumn("region", long_name).select(
        "sno",
        fn.recode(F.col("region"), REGION_CODES).alias("region"),
        fn.recode(F.col("sex"), SEX_CODES).alias("sex"),
    )


def status_sql(known: str, unknown: str) -> str:
    s = "hiv_status_at_enrollment"
    return (
        f"CASE WHEN {s} IN ('positive', 'negative') THEN upper({s}[1]) || substring({s}, 2) "
        f"WHEN {s} = 'unknown' THEN 'Unknown' WHEN {s} IN ('Unknown', 'Uknown') THEN '{unknown}' "
        f"WHEN lower({s}) = 'known positive' THEN '{known}' ELSE {s} END"
    )


@query(
    "SELECT sno, hiv_status_at_enrollment AS entered, "
    f"{status_sql('Known Positive', 'Unknown')} AS status FROM register"
)
def val_recode_status(spark, sf_dir):
    entered = F.col("hiv_status_at_enrollment")
    return register(spark, sf_dir).select(
        "sno", entered.alias("entered"), fn.recode(entered, fn.STATUS_INTENDED).alias("status")
    )


@query(
    "SELECT sno, hiv_status_at_enrollment AS entered, "
    f"{status_sql('Known Positve', 'Unknown ')} AS status FROM register"
)
def val_recode_status_as_written(spark, sf_dir):
    entered = F.col("hiv_status_at_enrollment")
    return register(spark, sf_dir).select(
        "sno", entered.alias("entered"), fn.recode(entered, fn.STATUS_AS_WRITTEN).alias("status")
    )
