"""CSV, snapshots and landed sheets."""

import glob
import gzip
import os

import pytest
from pyspark.sql import functions as F

from rollbook.sources import files, sheets, workspace

HEADER = '"SNo","KP_Type","Note\r\n(dd/mm)","Visit","Visit",\n'


def write(folder, name, body, titles="Cohort register\n,,,,\n", header=HEADER):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.csv", "w", newline="") as f:
        f.write(titles + header + body)


@pytest.fixture
def sheet_folder(tmp_path):
    folder = str(tmp_path / "sheets")
    write(folder, "a", '1,FSW,"two\nlines",Yes,,\n2,,"say ""hi""", No ,Yes,\n')
    write(folder, "b", "3,MSM,  ,Yes,Yes,\n", titles="Another title,,\n,,\n")
    return folder


@pytest.mark.parametrize("find", [{"skip": 2}, {"anchor": "KP_Type"}, {"anchor": "kp type", "skip": 5}])
def test_sheets_land_as_text(spark, tmp_path, sheet_folder, find):
    landed = sheets.land_sheets(spark, sheet_folder, width=8, out=str(tmp_path / "landed"))
    opened = sheets.open_sheets(landed, **find)
    names = ["SNo", "KP_Type", "Note\n(dd/mm)", "Visit...4", "Visit...5"]
    plain = [c.replace("\r\n", "\n") for c in opened.columns]
    assert plain == [*names, "source_file", "row_in_sheet", "row_id"]
    assert {t for _, t in opened.dtypes[:-2]} == {"string"}
    got = {r["SNo"]: tuple(r)[1:5] + (r["row_in_sheet"],) for r in opened.collect()}
    assert got == {
        "1": ("FSW", "two\nlines", "Yes", None, 1),
        "2": (None, 'say "hi"', "No", "Yes", 2),
        "3": ("MSM", None, "Yes", "Yes", 1),
    }


def test_sheets_with_other_headers_are_refused(spark, tmp_path, sheet_folder):
    write(sheet_folder, "c", "4,TG\n", header="SNo,KP_Type\n")
    landed = sheets.land_sheets(spark, sheet_folder, width=8, out=str(tmp_path / "landed"))
    with pytest.raises(ValueError, match="no header row in common"):
        sheets.open_sheets(landed, anchor="KP_Type")


def test_sheets_without_a_header_are_refused(spark, tmp_path, sheet_folder):
    write(sheet_folder, "c", "4,TG\n", header="SNo,Type\n")
    landed = sheets.land_sheets(spark, sheet_folder, width=8, out=str(tmp_path / "landed"))
    with pytest.raises(ValueError, match="some sheets have no header row"):
        sheets.open_sheets(landed, anchor="KP_Type")


@pytest.mark.parametrize("extra", [1, 2, 5])
@pytest.mark.parametrize("filler", ["", "x"])
def test_no_cell_is_lost_beyond_the_width(spark, tmp_path, extra, filler):
    os.makedirs(tmp_path / "wide")
    line = ",".join(["3", "4", *[filler] * (extra - 1), "LOST"])
    (tmp_path / "wide" / "a.csv").write_text(f"A,B\n1,2\n{line}\n")
    with pytest.raises(Exception):
        sheets.land_sheets(spark, str(tmp_path / "wide"), width=2, out=str(tmp_path / "landed"))


def test_blank_lines_above_the_header(spark, tmp_path):
    os.makedirs(tmp_path / "s")
    (tmp_path / "s" / "a.csv").write_text("Title\n\n\nKP Type,No\nFSW,1\nMSM,2\n")
    landed = sheets.land_sheets(spark, str(tmp_path / "s"), width=3, out=str(tmp_path / "landed"))
    opened = sheets.open_sheets(landed, skip=3, anchor="KP Type")
    assert sorted(r["No"] for r in opened.collect()) == ["1", "2"]
    with pytest.raises(ValueError, match="above the header"):
        sheets.open_sheets(landed, skip=0, anchor="KP Type")


def test_rows_that_end_in_both_ways(spark, tmp_path):
    """A header with a line break as its first row, and rows that end in CR LF."""
    os.makedirs(tmp_path / "s")
    (tmp_path / "s" / "a.csv").write_bytes(b'"KP\r\nType",No\r\nFSW,"1"\r\nMSM,2\r\n')
    landed = sheets.land_sheets(spark, str(tmp_path / "s"), width=2, out=str(tmp_path / "landed"))
    got = sheets.open_sheets(landed, anchor="KP Type").select("No").collect()
    assert sorted(r["No"] for r in got) == ["1", "2"]


@pytest.mark.parametrize("width", [6, 8])
def test_cells_beyond_the_header_are_refused(spark, tmp_path, sheet_folder, width):
    write(sheet_folder, "c", "4,TG,,,,stray\n")
    landed = sheets.land_sheets(spark, sheet_folder, width=width, out=str(tmp_path / "landed"))
    opened = sheets.open_sheets(landed, skip=2)
    with pytest.raises(Exception, match="right of its header"):
        opened.select("SNo").collect()


def test_a_cell_equals_the_anchor_but_for_case_and_marks(spark):
    cells = ["KP Type", " kp-type ", "(KP\n\nTYPE)", "KPTYPE", "kp type2", "type kp", "İkp_type", "kp", "", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = df.where(sheets.equals_anchor(F.col("c"), "KP Type")).collect()
    assert [r.c for r in got] == cells[:3]
    assert [r.c for r in df.where(sheets._plain(F.col("c")) == "kp_type").collect()] == cells[:3]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, None, "", "x\ny"), (None, 2.5, 'a "b", c', None), (3, 0.5, "NA?", "\r\n")], "i int, d double, s string, t string"
    )
    path = str(tmp_path / "csv")
    files.write_csv(df, path, compress=True)
    parts = glob.glob(f"{path}/*.csv.gz")
    assert parts
    text = "".join(gzip.open(p, "rt").read() for p in parts)
    assert "1,NA," in text and "NA,2.5," in text
    key = lambda r: str(r)
    assert sorted(files.read_csv(spark, path, df.schema).collect(), key=key) == sorted(
        df.collect(), key=key
    )
    assert files.read_csv(spark, path).dtypes == df.dtypes


def test_a_cut_record_fails_when_files_are_split(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b\nc")], "i int, s string")
    path = str(tmp_path / "csv")
    files.write_csv(df, path)
    assert sorted(map(tuple, files.read_csv(spark, path, df.schema).collect())) == [(1, "a"), (2, "b\nc")]
    with pytest.raises(Exception):
        files.read_csv(spark, path, df.schema, line_breaks=False).collect()


def test_foreign_csv_blanks(spark, tmp_path):
    (tmp_path / "f.csv").write_text("n,s\n1,a\nNA,\n,NA\n")
    got = [tuple(r) for r in files.read_csv(spark, str(tmp_path / "f.csv")).collect()]
    assert got == [(1, "a"), (None, ""), (None, None)]


def test_snapshot_is_filed_by_run_date_and_region(spark, tmp_path):
    path = str(tmp_path / "snap")
    df = spark.range(100).withColumn("region", F.when(F.col("id") < 90, "A").otherwise("B"))
    files.save_snapshot(df, path, run_date="2024-05-21", partition_by=["region"])
    assert sorted(os.listdir(f"{path}/run_date=24-05-21"))[:2] == ["region=A", "region=B"]
    got = files.load_snapshot(spark, path)
    assert got.filter("region = 'A'").count() == 90
    assert got.select("run_date").distinct().collect()[0][0] == "24-05-21"
    assert "PartitionFilters: [isnotnull(region" in (
        got.filter("region = 'A'")._jdf.queryExecution().executedPlan().toString()
    )


def test_working_tables_go_to_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    a, b = workspace.new_path(spark, "x"), workspace.new_path(spark, "x")
    assert a != b and a.startswith(folder)
