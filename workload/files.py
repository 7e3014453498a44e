"""Queries that write files from the register and read them back."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.operators import headers
from rollbook.sources import files, sheets
from rollbook.sources.workspace import new_path
from workload.catalog import CONDOMS, PEER, RISK, STI, months, names, query
from workload.cleaning import ID_COLUMNS
from workload.register import register

SHEET_COLUMNS = [*ID_COLUMNS, *months(PEER), *months(STI), *months(RISK), *months(CONDOMS)]
SHEET_TITLES = ["Cohort register", "Quarter,1", '"Entered by\nthe field team"']
SHEET_WIDTH = 40
SHEET_HEADERS = {
    "kp_type": "KP_Type",
    "kp_unique_identifier": "KP Unique Identifier\r\n(SR/Client Initials/Typology/Hotspot/PE Code/Client No)",
    "date_of_enrolment": "Date of Enrolment (DD/MM/YYYY)",
    "date_of_first_contact": "Date of First-Contact (DD/MM/YYYY)",
}
SHEET_RENAMES = {
    old: new for old, new in headers.REGISTER_RENAMES.items() if new in SHEET_HEADERS
}
FIRST_IN_TASK = 1 << 33  # monotonically increasing ids restart at multiples of this


def write_sheets(df: DataFrame, path: str, titles: list[str], header: list[str]) -> None:
    """One sheet per task: title rows, a header that may hold line breaks, then the rows as CSV."""
    buffer = io.StringIO()
    csv.writer(buffer, lineterminator="").writerow(header)
    line = F.to_csv(F.struct(*[f"`{c}`" for c in df.columns]))
    top = [F.lit(text) for text in [*titles, buffer.getvalue()]]
    is_first = F.monotonically_increasing_id() % FIRST_IN_TASK == 0
    lines = df.select(line.alias("line"), is_first.alias("is_first"))
    with_top = F.when(F.col("is_first"), F.array(*top, "line")).otherwise(F.array("line"))
    lines.select(F.explode(with_top).alias("value")).write.text(path)


def sheet_header(columns: Sequence[str]) -> list[str]:
    return [SHEET_HEADERS.get(c, c.replace("_", " ").capitalize()) for c in columns]


def as_text(column: str) -> str:
    return f"nullif(CAST({column} AS VARCHAR), '') AS {column}"


@query(f"SELECT {', '.join(as_text(c) for c in SHEET_COLUMNS)} FROM register")
def src_sheet_landing(spark, sf_dir):
    df = register(spark, sf_dir).select(*SHEET_COLUMNS)
    source, landing = new_path(spark, "sheets"), new_path(spark, "landed")
    write_sheets(df, source, SHEET_TITLES, sheet_header(df.columns))
    landed = sheets.land_sheets(spark, source, width=SHEET_WIDTH, out=landing)
    opened = sheets.open_sheets(landed, anchor="KP_Type")
    opened = opened.drop("source_file", "row_in_sheet", "row_id")
    return headers.rename_columns(headers.repair_names(opened), SHEET_RENAMES)


@query(f"SELECT {names(*ID_COLUMNS)} FROM register")
def src_csv_roundtrip(spark, sf_dir):
    df = register(spark, sf_dir).select(*ID_COLUMNS)
    path = new_path(spark, "csv")
    files.write_csv(df, path, compress=True)
    return files.read_csv(spark, path, df.schema)


_BROKEN = "kp_type || chr(10) || 'a \"b\", c' || chr(13) || chr(10) || county"
_CELLS = {
    "kp_name": f"CASE WHEN sno % 3 = 0 THEN {_BROKEN} ELSE kp_name END",
    "peer_educator": "CASE WHEN sno % 5 = 0 THEN '' ELSE peer_educator END",
}


@query(
    "SELECT "
    + ", ".join(f"{_CELLS.get(c, c)} AS {c}" for c in ID_COLUMNS)
    + " FROM register"
)
def src_csv_roundtrip_line_breaks(spark, sf_dir):
    """Cells with line breaks, quotes, commas, blanks and missing values."""
    df = register(spark, sf_dir).select(*ID_COLUMNS)
    df = df.withColumns({c: F.expr(text) for c, text in _CELLS.items()})
    path = new_path(spark, "csv")
    files.write_csv(df, path)
    return files.read_csv(spark, path, df.schema)


@query(f"SELECT {names(*SHEET_COLUMNS)}, '24-05-21' AS run_date FROM register")
def sink_snapshot(spark, sf_dir):
    df = register(spark, sf_dir).select(*SHEET_COLUMNS)
    path = new_path(spark, "snapshot")
    files.save_snapshot(df, path, run_date="2024-05-21", partition_by=["region"])
    return files.load_snapshot(spark, path)


@query(
    f"SELECT {names(*SHEET_COLUMNS)}, '24-05-20' AS run_date FROM register WHERE region <> 'COR' "
    f"UNION ALL SELECT {names(*SHEET_COLUMNS)}, '24-05-21' AS run_date FROM register WHERE region <> 'UER'"
)
def sink_snapshot_two_dates(spark, sf_dir):
    """Two dates saved in turn, the second once more with other regions: both load, and the second is the later one."""
    df = register(spark, sf_dir).select(*SHEET_COLUMNS)
    path = new_path(spark, "snapshot")
    files.save_snapshot(df.where("region <> 'COR'"), path, run_date="2024-05-20", partition_by=["region"])
    files.save_snapshot(df, path, run_date="2024-05-21", partition_by=["region"])
    files.save_snapshot(df.where("region <> 'UER'"), path, run_date="2024-05-21", partition_by=["region"])
    return files.load_snapshot(spark, path)


_FOREIGN = "CASE WHEN sno % 4 = 0 THEN 'two' || chr(13) || chr(10) || 'lines, \"' || county || '\"' ELSE county END"


@query(
    "SELECT " + ", ".join(f"{_FOREIGN} AS county" if c == "county" else c for c in ID_COLUMNS) + " FROM register"
)
def src_csv_foreign_line_ends(spark, sf_dir):
    """Rows that end in CR LF or LF, also within one file, with line breaks of both kinds inside cells."""
    df = register(spark, sf_dir).select(*ID_COLUMNS).withColumn("county", F.expr(_FOREIGN))
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", *[quote(F.coalesce(F.col(c).cast("string"), F.lit("NA"))) for c in df.columns])
    ended = F.when(F.col("sno") % 3 == 0, F.concat(line, F.lit("\r"))).otherwise(line)
    header = F.lit(",".join(df.columns) + "\r")
    is_first = F.monotonically_increasing_id() % FIRST_IN_TASK == 0
    lines = df.select(ended.alias("line"), is_first.alias("is_first")).select(
        F.explode(F.when(F.col("is_first"), F.array(header, "line")).otherwise(F.array("line"))).alias("value")
    )
    path = new_path(spark, "csv")
    lines.write.text(path)
    return files.read_csv(spark, path, df.schema)


@query(
    f"SELECT {names(*SHEET_COLUMNS)}, 'register_24-05-21' AS export FROM register WHERE kp_type <> ''"
)
def sink_dated_export(spark, sf_dir):
    """The cleaned register as a dated spreadsheet export (CSV, compressed), read back from its file."""
    df = register(spark, sf_dir).select(*SHEET_COLUMNS).where("kp_type <> ''")
    path = files.export_csv(df, new_path(spark, "exports"), "register", "2024-05-21")
    return files.read_csv(spark, path, df.schema).withColumn("export", F.lit(path.rsplit("/", 1)[1]))
