"""Queries for the whole jobs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from rollbook.operators import headers
from rollbook.operators.columns import NEEDLE_DASHBOARD_PREFIXES, starts_with
from rollbook.plans.consolidate import RegionalSource, consolidate
from rollbook.plans.extracts import dashboard_extract, tracker_extract
from rollbook.plans.indicators import (
    NEEDLES_PER_NEED,
    YES_SERVICES,
    indicator_report,
    package_report,
)
from rollbook.operators.dates import read_dates
from rollbook.plans.quality import MAX_AGE, quality_report, save_with_quality, tracker_check
from rollbook.plans.registers import FSW, MSM, PWID, TG, consolidate_records, consolidate_sheets
from rollbook.plans.repair import DATE_PREFIX, repair_values, unread_dates
from rollbook.sources.files import load_snapshot, save_snapshot
from rollbook.sources.records import land_records
from rollbook.sources.sheets import land_sheets, open_sheets
from rollbook.sources.workspace import new_path
from workload.catalog import (
    CATALOG,
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
    months,
    names,
    number,
    query,
)
from workload.cleaning import DASHBOARD, ID_COLUMNS, status_sql
from workload.files import SHEET_COLUMNS, SHEET_WIDTH, as_text, sheet_header, write_sheets
from workload.register import COLUMNS, REGIONS, register

# ---- consolidation ----------------------------------------------------------------------------

_CONTENT = [c for c in SHEET_COLUMNS if c not in ("sno", "remarks")]
_RANK = "CASE region " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(REGIONS, 1)) + " END"


def _regional_sources(spark, sf_dir):
    """One slice per region under headers of its own, each to be repaired differently."""
    df = register(spark, sf_dir).select(*SHEET_COLUMNS)
    styles = {
        "COR": (lambda c: c.replace("_", " ").title(), None),
        "LER": (lambda c: f"{c.replace('_', '-').upper()}.", headers.REGISTER_RULES),
        "NRR": (lambda c: f'"{c.replace("_", " ")}"', headers.EXPORT_RULES),
        "UER": (lambda c: f"({c.replace('_', '/ ')})", headers.REGISTER_RULES),
        "WKR": (lambda c: f"WKR: {c}", None),
    }
    for region in REGIONS:
        style, rules = styles[region]
        raw = [c if c == "sno" else style(c) for c in SHEET_COLUMNS]
        own = df.filter(F.col("region") == region).toDF(*raw)
        yield RegionalSource(region, own, "sno", rules)


@query(
    f"SELECT {names(*_CONTENT)}, {_RANK} AS source_rank, sno AS row_in_source FROM register "
    "WHERE kp_type <> ''"
)
def job_consolidate(spark, sf_dir):
    return consolidate(list(_regional_sources(spark, sf_dir)), key="kp_type")


_SPARSE = {"COR": "kp_name", "LER": "yob", "WKR": "county"}


def _without(region: str, column: str) -> str:
    return f"CASE WHEN region = '{region}' THEN NULL ELSE {column} END"


@query(
    "SELECT "
    + ", ".join(
        next((f"{_without(r, c)} AS {c}" for r, empty in _SPARSE.items() if empty == c), c)
        for c in _CONTENT
    )
    + f", {_RANK} AS source_rank, sno AS row_in_source FROM register WHERE kp_type <> ''"
)
def job_consolidate_sparse(spark, sf_dir):
    """Three regions with an empty column each, every time another one."""
    sources = []
    for source in _regional_sources(spark, sf_dir):
        if source.name in _SPARSE:
            raw = source.frame.columns[SHEET_COLUMNS.index(_SPARSE[source.name])]
            emptied = source.frame.withColumn(raw, F.lit(None).cast(source.frame.schema[raw].dataType))
            source = replace(source, frame=emptied)
        sources.append(source)
    return consolidate(sources, key="kp_type")


_TG_RANK = "CASE region " + " ".join(
    f"WHEN '{sheet.region}' THEN {i}" for i, sheet in enumerate(TG.sheets, 1)
) + " END"


@query(
    f"SELECT {', '.join(as_text(c) for c in SHEET_COLUMNS)}, {_TG_RANK} AS source_rank "
    "FROM register WHERE kp_type <> ''"
)
def job_register_from_sheets(spark, sf_dir):
    """Each region's rows go out as sheets with that region's preamble, and come back as one."""
    df = register(spark, sf_dir).select(*SHEET_COLUMNS)
    landed = {}
    for sheet in TG.sheets:
        source = new_path(spark, f"sheets-{sheet.region}")
        titles = [f"Title {i}" for i in range(sheet.preamble)]
        own = df.filter(F.col("region") == sheet.region)
        write_sheets(own, source, titles, sheet_header(df.columns))
        out = new_path(spark, f"landed-{sheet.region}")
        landed[sheet.region] = land_sheets(spark, source, SHEET_WIDTH, out)
    return consolidate_sheets(TG, landed).drop("row_in_source")


@query(
    f"SELECT {', '.join(as_text(c) for c in SHEET_COLUMNS)}, {_TG_RANK} AS source_rank "
    "FROM register WHERE kp_type <> ''"
)
def src_sheet_header_variants(spark, sf_dir):
    """Files of five regions in one folder under different headers: other orders, other spellings, other title rows."""
    df = register(spark, sf_dir).select(*SHEET_COLUMNS)
    source = new_path(spark, "sheets")
    for i, sheet in enumerate(TG.sheets):
        own = df.filter(F.col("region") == sheet.region)
        columns = df.columns if sheet.region == TG.layout else df.columns[::-1] if i % 2 else sorted(df.columns)
        header = sheet_header(columns)
        if i % 2 and sheet.region != TG.layout:
            header = [h.upper() for h in header]
        titles = [f'"Title {i}\nof the region"' for i in range(min(2, sheet.preamble))]
        write_sheets(own.select(*columns), f"{source}/{sheet.region}", titles, header)
    landed = land_records(spark, f"{source}/*", new_path(spark, "records"))
    region = F.regexp_extract("source_file", "/([A-Z]+)/[^/]*$", 1)
    return consolidate_records(TG, landed, region).drop("row_in_source")


# ---- repair -----------------------------------------------------------------------------------

_REPAIR_COLUMNS = [c for c in ID_COLUMNS if c != "remarks"]
_SERIAL = number("date_of_next_appointment")
_REPAIRED = {
    "sr_name": "lower(sr_name)",
    "kp_name": "lower(kp_name)",
    "sex": "CASE WHEN sex = 'Male' THEN 'MALE' ELSE sex END",
    "hiv_status_at_enrollment": status_sql("Known Positive", "Unknown"),
    "date_of_next_appointment": f"CASE WHEN {_SERIAL} IS NOT NULL THEN DATE '1899-12-30' + "
    f"CAST(floor({_SERIAL}) AS INT) END",
    "county": "upper(CASE WHEN substring(kp_unique_identifier, 1, 2) = '05' THEN 'LAMU' "
    "WHEN substring(kp_unique_identifier, 1, 2) <> '05' THEN county END)",
}


@query(
    "SELECT "
    + ", ".join(f"{_REPAIRED.get(c, c)} AS {c}" for c in _REPAIR_COLUMNS)
    + " FROM register"
)
def job_repair_values(spark, sf_dir):
    """Regions with exchanged columns come in exchanged, and one under its long name."""
    exchanged = {
        "region": "CASE WHEN region = 'NRR' THEN 'North Rift Region' ELSE region END",
        "county": "CASE WHEN region IN ('LER', 'UER') THEN sr_name ELSE county END",
        "sr_name": "CASE WHEN region IN ('LER', 'UER') THEN county ELSE sr_name END",
        "kp_type": "CASE WHEN region = 'WKR' THEN kp_unique_identifier ELSE kp_type END",
        "kp_unique_identifier": "CASE WHEN region = 'WKR' THEN kp_type ELSE kp_unique_identifier END",
    }
    df = register(spark, sf_dir).select(*_REPAIR_COLUMNS)
    return repair_values(df.withColumns({c: F.expr(text) for c, text in exchanged.items()}))


# ---- from sheets to indicators ----------------------------------------------------------------

_SERIAL_MONTHS = ("73", "126")
_CHAIN = [
    "kp_type", "kp_unique_identifier", "region", "county", "sr_name", "kp_name", "sex",
    "hiv_status_at_enrollment", *months(PEER), *months(STI), *months(RISK), *months(CONDOMS),
    *months(NEEDLES), *[c for c in COLUMNS if c.startswith("hiv_status") and c[-1].isdigit()],
]
_CHAIN_HEADERS = {
    "kp_unique_identifier": "KP Unique Identifier\r\n(SR/Client Initials/Typology/Hotspot/PE Code/Client No)",
    **{
        f"next{m}": f"Date of Next Appointment\r\ndd-mm-yyyy (e.g. 02 May 2018){m}"
        for m in _SERIAL_MONTHS
    },
}
_HALF = {"COR": "region = 'COR' AND sno % 2 = 1", "NER": "region = 'COR' AND sno % 2 = 0"}


def _chain_frame(spark, sf_dir):
    """The register as regions send it: columns exchanged, statuses capitalised, dates in three ways."""
    df = register(spark, sf_dir)
    number_ = F.col("date_of_next_appointment").try_cast("int")
    day = F.date_add(F.lit("1899-12-30").cast("date"), number_)
    cell = (
        F.when(number_.isNull(), F.col("date_of_next_appointment"))
        .when(F.col("sno") % 3 == 0, number_.cast("string"))
        .when(F.col("sno") % 3 == 1, F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.date_format(day, "dd/MM/yyyy"))
    )
    exchanged = {
        "county": "CASE WHEN region IN ('LER', 'UER') THEN sr_name ELSE county END",
        "sr_name": "CASE WHEN region IN ('LER', 'UER') THEN county ELSE sr_name END",
        "kp_type": "CASE WHEN region = 'WKR' THEN kp_unique_identifier ELSE kp_type END",
        "kp_unique_identifier": "CASE WHEN region = 'WKR' THEN kp_type ELSE kp_unique_identifier END",
    }
    status = [c for c in _CHAIN if c.startswith("hiv_status") and c[-1].isdigit()]
    return df.withColumns({c: F.expr(text) for c, text in exchanged.items()}).withColumns(
        {**{c: F.initcap(c) for c in status}, **{f"next{m}": cell for m in _SERIAL_MONTHS}}
    )


def _chain(register_, spark, sf_dir):
    """Sheets of every region, landed, consolidated, repaired and counted."""
    df, landed = _chain_frame(spark, sf_dir), {}
    regions = {sheet.region for sheet in register_.sheets}
    for sheet in register_.sheets:
        where = _HALF.get(sheet.region) if "NER" in regions else None
        own = df.filter(where or F.col("region") == sheet.region)
        if sheet.keep_first:  # one row a client, so that the first is the only one
            client = F.concat_ws("_", F.coalesce("kp_unique_identifier", F.lit("00")), "sno")
            own = own.withColumn("kp_unique_identifier", client)
        own = own.select(*_CHAIN, *[f"next{m}" for m in _SERIAL_MONTHS], F.lit("x").alias("a"))
        own = own if "a" in sheet.drop else own.drop("a")
        head = [_CHAIN_HEADERS.get(c, c.replace("_", " ").capitalize()) for c in own.columns]
        if sheet.region == "WKR":
            head[head.index("Sex")] = "Gender"
        source = new_path(spark, f"chain-{sheet.region}")
        write_sheets(own, source, [f"Title {i}" for i in range(sheet.preamble)], head)
        landed[sheet.region] = land_sheets(
            spark, source, len(head), new_path(spark, f"chain-landed-{sheet.region}")
        )
    snapshot = new_path(spark, "chain-snapshot")
    save_snapshot(repair_values(consolidate_sheets(register_, landed)), snapshot)
    repaired = load_snapshot(spark, snapshot)
    dates = starts_with(repaired, DATE_PREFIX)
    read = repaired.groupBy("region").agg(
        *[F.count(f"`{c}`").alias(f"dates{m}") for c, m in zip(dates, _SERIAL_MONTHS)],
        F.max(f"`{dates[0]}`").alias("last_date"),
    )
    return indicator_report(repaired).join(read, "region")


_CHAIN_COUNTS = {
    "sti_any": any_yes(STI),
    "peer_any": any_yes(PEER),
    "risk_any": any_yes(RISK),
    "condoms_any": any_positive(CONDOMS),
    "package_any_month": PACKAGE_ANY,
    "package_same_month": PACKAGE_SAME,
    "package_from_flags": PACKAGE_FLAGS,
    "aligned_any": f"{ALIGNED_MONTHS} >= 1",
    **{f"{c}_yes": f"{c} = 'Yes'" for s in (PEER, RISK, STI) for c in months(s)},
    **{
        f"{c}_known_positive": f"{'lower(' + c + ')' if c[-1].isdigit() else c} = 'known positive'"
        for c in _CHAIN if c.startswith("hiv_status")
    },
    **{f"{c}_positive": f"{number(c)} > 0" for s in (CONDOMS, NEEDLES) for c in months(s)},
    **{f"dates{m}": f"{number('date_of_next_appointment')} IS NOT NULL" for m in _SERIAL_MONTHS},
}
CHAIN_SQL = (
    "SELECT region, count(*) AS clients, "
    + ", ".join(f"{count_where(text)} AS {name}" for name, text in _CHAIN_COUNTS.items())
    + f", max(DATE '1899-12-30' + CAST({number('date_of_next_appointment')} AS INT)) AS last_date "
    "FROM register WHERE CASE WHEN region = 'WKR' THEN coalesce(kp_unique_identifier, '') "
    "ELSE coalesce(kp_type, '') END <> '' GROUP BY region"
)


@query(CHAIN_SQL)
def job_chain_msm(spark, sf_dir):
    return _chain(MSM, spark, sf_dir)


@query(CHAIN_SQL)
def job_chain_fsw(spark, sf_dir):
    return _chain(FSW, spark, sf_dir)


@query(CHAIN_SQL)
def job_chain_pwid(spark, sf_dir):
    return _chain(PWID, spark, sf_dir)


@query(CHAIN_SQL)
def job_chain_tg(spark, sf_dir):
    return _chain(TG, spark, sf_dir)


@query(
    "SELECT 'date_of_next_appointment' AS variable, "
    + count_where(f"date_of_next_appointment <> '' AND {_SERIAL} IS NULL")
    + " AS n_unread FROM register"
)
def job_unread_dates(spark, sf_dir):
    return unread_dates(register(spark, sf_dir), ["date_of_next_appointment"])


# ---- quality ----------------------------------------------------------------------------------


def _line(section: str, variable: str, statistic: str, value: str, source: str = "register") -> str:
    return (
        f"SELECT '{section}' AS section, '{variable}' AS variable, '{statistic}' AS statistic, "
        f"round(CAST({value} AS DOUBLE), 6) AS value FROM {source}"
    )


_GROUPS = "(SELECT count(*) AS n FROM register GROUP BY kp_unique_identifier) g"
_AGE = number("age")


@query(
    " UNION ALL ".join(
        [
            _line("register", "all", "rows", "count(*)"),
            _line("check", "kp_type", "blank", count_where("kp_type IS NULL OR kp_type = ''")),
            _line("check", "date_of_first_contact", "after_enrolment",
                  count_where("date_of_first_contact > date_of_enrolment")),
            _line("check", "age", "above_limit", count_where(f"{_AGE} > {MAX_AGE}")),
            *[_line("missing", c, "n_miss", f"count(*) - count({c})") for c in COLUMNS],
            _line("repeats", "kp_unique_identifier", "repeated_keys", count_where("n > 1"), _GROUPS),
            _line("repeats", "kp_unique_identifier", "rows_of_repeated_keys",
                  "sum(n) FILTER (WHERE n > 1)", _GROUPS),
            _line("repeats", "kp_unique_identifier", "later_rows", "sum(n - 1)", _GROUPS),
            *[
                _line("numbers", c, statistic, text.format(number(c)))
                for c in ("age", "yob")
                for statistic, text in {
                    "min": "min({})", "q1": "quantile_cont({}, 0.25)",
                    "median": "quantile_cont({}, 0.5)", "mean": "avg({})",
                    "q3": "quantile_cont({}, 0.75)", "max": "max({})",
                }.items()
            ],
        ]
    )
)
def job_quality_report(spark, sf_dir):
    report = quality_report(
        register(spark, sf_dir),
        key="kp_unique_identifier",
        type_column="kp_type",
        first_contact="date_of_first_contact",
        enrolment="date_of_enrolment",
    )
    return report.withColumn("value", F.round("value", 6))


_REPORT_TEXTS = ("county", "peer_educator", "kp_name")


@query(
    CATALOG["job_quality_report"].sql
    + " UNION ALL "
    + " UNION ALL ".join(
        [
            *[
                _line("text", c, statistic, text.format(c))
                for c in _REPORT_TEXTS
                for statistic, text in {
                    "complete_rate": "count({0}) / CAST(count(*) AS DOUBLE)",
                    "min_length": "min(length({0}))", "max_length": "max(length({0}))",
                    "empty": "count(*) FILTER (WHERE {0} = '')",
                    "whitespace": "count(*) FILTER (WHERE {0} <> '' AND trim({0}) = '')",
                    "n_unique": "count(DISTINCT {0})",
                }.items()
            ],
            *[
                f"SELECT 'level' AS section, '{c}' AS variable, coalesce({c}, 'NA') AS statistic, "
                f"CAST(count(*) AS DOUBLE) AS value FROM register GROUP BY {c}"
                for c in ("kp_type", "sex")
            ],
        ]
    ),
    register=False,
)
def job_quality_snapshot(spark, sf_dir):
    """The whole report, with text profiles and levels, observed while the snapshot is written."""
    found = save_with_quality(
        register(spark, sf_dir), new_path(spark, "quality-snapshot"), "2024-05-21", "kp_unique_identifier", ["sno"],
        "kp_type", "date_of_first_contact", "date_of_enrolment", levels=("kp_type", "sex"), texts=_REPORT_TEXTS,
    )
    return found.report.withColumn("value", F.round("value", 6))


@query(
    "SELECT r.kp_unique_identifier, g.n AS dupe_count, r.sno, r.county FROM register r JOIN "
    "(SELECT kp_unique_identifier AS k, count(*) AS n FROM register GROUP BY 1 HAVING count(*) > 1) g "
    "ON r.kp_unique_identifier IS NOT DISTINCT FROM g.k"
)
def job_quality_listed_repeats(spark, sf_dir):
    """The listed rows of repeated keys, read from the snapshot that the report was taken of."""
    found = save_with_quality(
        register(spark, sf_dir).select("sno", "kp_unique_identifier", "county", "kp_type", "age", "yob",
                                       "date_of_first_contact", "date_of_enrolment"),
        new_path(spark, "quality-snapshot"), "2024-05-21", "kp_unique_identifier", ["sno"],
        "kp_type", "date_of_first_contact", "date_of_enrolment",
    )
    return found.repeats.select("kp_unique_identifier", "dupe_count", "sno", "county")


# Cells of one appointment column: serials in three regions (numbers beyond their years are no dates), month first in one,
# day first in one.
_MIXED = (
    "CASE WHEN sno % 11 = 0 THEN '2018' WHEN sno % 13 = 0 THEN '5' "
    "WHEN region = 'NRR' THEN (1 + sno % 12) || '/' || (1 + sno % 28) || '/2024' "
    "WHEN region = 'UER' THEN (1 + sno % 28) || '/' || (1 + sno % 12) || '/2024' "
    "ELSE CAST(45292 + sno % 180 AS VARCHAR(10)) END"
)
_DAY = "CAST('2024-' || lpad(CAST(1 + sno % 12 AS VARCHAR(2)), 2, '0') || '-' || lpad(CAST(1 + sno % 28 AS VARCHAR(2)), 2, '0') AS DATE)"


@query(
    "SELECT sno, CASE WHEN sno % 11 = 0 OR sno % 13 = 0 THEN NULL "
    f"WHEN region IN ('NRR', 'UER') THEN {_DAY} "
    "ELSE DATE '1899-12-30' + CAST(45292 + sno % 180 AS INT) END AS appointment FROM register"
)
def fn_voted_dates(spark, sf_dir):
    """One column with serials, month-first and day-first dates by region, and numbers that are no dates."""
    df = register(spark, sf_dir).select("sno", "region", F.expr(_MIXED).alias("appointment"))
    return read_dates(df, ["appointment"], by=["region"]).select("sno", "appointment")



# ---- indicators -------------------------------------------------------------------------------

_PACKAGE_COUNTS = {
    "package_any_month": PACKAGE_ANY,
    "package_same_month": PACKAGE_SAME,
    "package_from_flags": PACKAGE_FLAGS,
    "aligned_any": f"{ALIGNED_MONTHS} >= 1",
}
_STATUS = [c for c in COLUMNS if c.startswith("hiv_status")]
_ALL_COUNTS = {
    "sti_any": any_yes(STI),
    "peer_any": any_yes(PEER),
    "risk_any": any_yes(RISK),
    "condoms_any": any_positive(CONDOMS),
    **_PACKAGE_COUNTS,
    **{f"{c}_yes": f"{c} = 'Yes'" for s in YES_SERVICES for c in months(s)},
    **{f"{c}_no": f"{c} = 'No'" for c in months(NEEDLES_PER_NEED)},
    **{f"{c}_known_positive": f"{c} = 'known positive'" for c in _STATUS},
    **{f"{c}_positive": f"{number(c)} > 0" for s in (CONDOMS, NEEDLES) for c in months(s)},
}


def _counts(conditions: dict[str, str]) -> str:
    cells = ", ".join(f"{count_where(text)} AS {name}" for name, text in conditions.items())
    return f"SELECT region, count(*) AS clients, {cells} FROM register GROUP BY region"


@query(_counts(_ALL_COUNTS))
def job_indicators(spark, sf_dir):
    return indicator_report(register(spark, sf_dir))


@query(_counts(_PACKAGE_COUNTS))
def job_package_report(spark, sf_dir):
    return package_report(register(spark, sf_dir))


# ---- extracts ---------------------------------------------------------------------------------

_EXPORT_HEADERS = {
    "kp_unique_identifier": "KP Unique Identifier\r\n(SR/Client Initials/Typology/Hotspot/PE Code/Client No)",
    "date_of_next_appointment": "Date of Next Appointment\r\ndd-mm-yyyy (e.g. 02 May 2018)126",
    "kp_name": "KP's Name(3 names & nickname)",
    "date_of_first_contact": "Date of First Contact (DD/MM/YYYY)",
    "date_of_enrolment": "Date of Enrolment (DD/MM/YYYY)",
}


@query(f"SELECT {names(*DASHBOARD)} FROM register WHERE kp_type <> ''")
def job_dashboard_extract(spark, sf_dir):
    raw = [_EXPORT_HEADERS.get(c, c.replace("_", " ").capitalize()) for c in COLUMNS]
    df = register(spark, sf_dir).toDF(*raw)
    return dashboard_extract(df, headers.EXPORT_RENAMES, path=new_path(spark, "dashboard"))


_NEEDLE_DASHBOARD = [c for c in COLUMNS if c.startswith(NEEDLE_DASHBOARD_PREFIXES)]


@query(f"SELECT {names(*_NEEDLE_DASHBOARD)} FROM register WHERE kp_type <> ''")
def job_dashboard_extract_needles(spark, sf_dir):
    raw = [_EXPORT_HEADERS.get(c, c.replace("_", " ").capitalize()) for c in COLUMNS]
    df = register(spark, sf_dir).toDF(*raw)
    path = new_path(spark, "dashboard")
    return dashboard_extract(df, headers.EXPORT_RENAMES, prefixes=NEEDLE_DASHBOARD_PREFIXES, path=path)


_TRACKER = {
    "region": "Region",
    "date_of_first_contact": "Start-Date:",
    "date_of_enrolment": "End Date",
    "age": "Age",
    "sex": 'Sex"',
    "received_peer_education22": "Completed all sessions status (complete/not complete)",
    "county": "County",
}


@query(
    "SELECT region, date_of_first_contact AS start_date, date_of_enrolment AS end_date, age, sex, "
    "received_peer_education22 AS complete_sessions FROM register"
)
def job_tracker_extract(spark, sf_dir):
    df = register(spark, sf_dir).select(*_TRACKER).toDF(*_TRACKER.values())
    return tracker_extract(df, path=new_path(spark, "tracker"))


_TRACKED = ["region", "kp_name", "date_of_first_contact", "date_of_enrolment", "age", "sex"]
_NAMES = "(SELECT count(*) AS n FROM register GROUP BY kp_name) g"


@query(
    " UNION ALL ".join(
        [
            *[_line("missing", c, "n_miss", f"count(*) - count({c})") for c in _TRACKED],
            _line("repeats", "kp_name", "repeated_keys", count_where("n > 1"), _NAMES),
            _line("repeats", "kp_name", "rows_of_repeated_keys", "sum(n) FILTER (WHERE n > 1)", _NAMES),
            _line("repeats", "kp_name", "later_rows", "sum(n - 1)", _NAMES),
        ]
    )
)
def job_tracker_check(spark, sf_dir):
    """A tracker sheet below title rows: landed, opened, and checked by name."""
    source = new_path(spark, "tracker-sheet")
    head = [f"{c.replace('_', ' ').capitalize()}:" for c in _TRACKED]
    write_sheets(register(spark, sf_dir).select(*_TRACKED), source, ["Tracker", "Quarter 1"], head)
    landed = land_sheets(spark, source, len(head), new_path(spark, "tracker-landed"))
    opened = open_sheets(landed, skip=2, anchor="KP name").select(*[f"`{h}`" for h in head])
    return tracker_check(headers.repair_names(opened, headers.TRACKER_RULES), "kp_name")
