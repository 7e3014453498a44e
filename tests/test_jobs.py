"""Whole jobs, plan checks, and the known counts of the register view."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from rollbook.operators import blocks, dupes, hygiene, indicators, tables
from rollbook.plans import registers
from rollbook.plans.consolidate import RegionalSource, align, consolidate
from rollbook.plans.extracts import tracker_extract
from rollbook.plans.indicators import indicator_report
from rollbook.plans.repair import repair_values
from rollbook.sources.sheets import land_sheets
from workload.register import REGIONS, register

SF_DIR = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


@pytest.fixture(scope="module")
def view(spark):
    return register(spark, SF_DIR)


def final_plan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def test_consolidate_aligns_by_position(spark):
    a = spark.createDataFrame(
        [(2, "x", None, "1"), (1, None, None, None), (3, "", None, "2")],
        "n int, `KP Type` string, empty string, `Age (years)` string",
    )
    b = spark.createDataFrame([(7, "y", "3")], "n int, type string, years string")
    got = consolidate([RegionalSource("A", a, "n"), RegionalSource("B", b, "n")], key="kp_type")
    assert got.columns == ["kp_type", "age_years", "source_rank", "row_in_source"]
    assert sorted(map(tuple, got.collect())) == [("x", "1", 1, 2), ("y", "3", 2, 7)]


def test_columns_never_shift(spark):
    """Two regions with the same headers and different empty columns keep their cells in place."""
    columns = "n int, kp_type string, yob string, remarks string, empty string"
    a = spark.createDataFrame([(1, "x", "1990", None, None)], columns)
    b = spark.createDataFrame([(1, "y", None, "ok", None), (2, "z", None, "fine", None)], columns)
    got = consolidate([RegionalSource("A", a, "n"), RegionalSource("B", b, "n")])
    assert got.columns == ["kp_type", "yob", "remarks", "source_rank", "row_in_source"]
    assert sorted(tuple(r)[:3] for r in got.collect()) == [
        ("x", "1990", None), ("y", None, "ok"), ("z", None, "fine"),
    ]


def test_alignment():
    assert align(["a", "q", "c"], ["a", "b", "c"]) == {"a": "a", "b": "q", "c": "c"}
    assert align(["c", "b", "a"], ["a", "b", "c"]) == {"a": "a", "b": "b", "c": "c"}
    assert align(["a", "c"], ["a", "b", "c"], layout_empty=["b"]) == {"a": "a", "c": "c"}
    assert align(["a", "e", "c"], ["a", "c"], empty=["e"]) == {"a": "a", "c": "c"}
    with pytest.raises(ValueError, match="cannot take"):
        align(["a", "c", "q"], ["a", "b", "c"])


def test_statuses_count_the_same_in_any_case(spark):
    rows = [("COR", "Known Positive", "known positive"), ("COR", "KNOWN POSITIVE", "x"), ("COR", None, "Negative")]
    df = spark.createDataFrame(rows, "region string, hiv_status51 string, hiv_status104 string")
    df = df.selectExpr(
        "*", *[f"CAST(NULL AS STRING) AS {c}" for c in (
            "county", "sr_name", "kp_type", "kp_unique_identifier", "kp_name", "sex", "hiv_status_at_enrollment",
            "date_of_next_appointment", "screened_for_stis61", "received_peer_education22",
            "provided_with_risk_reduction_couselling68", "condoms_distributed_nmbr46",
        )]
    )
    counted = indicator_report(repair_values(df)).first()
    assert (counted.hiv_status51_known_positive, counted.hiv_status104_known_positive) == (2, 1)


def test_consolidate_refuses_another_column_count(spark):
    a = spark.createDataFrame([(1, "x", "y")], "n int, t string, u string")
    sources = [RegionalSource("A", a, "n"), RegionalSource("B", a.drop("u"), "n")]
    with pytest.raises(ValueError, match="cannot take"):
        consolidate(sources)


def test_consolidate_keeps_first_rows_and_takes_the_layout_of_another_source(spark):
    a = spark.createDataFrame([(2, "x", "p"), (1, "x", "q"), (3, "y", "r")], "n int, t string, u string")
    b = spark.createDataFrame([(1, "x", "s")], "n int, `Type` string, `Unit no` string")
    sources = [RegionalSource("A", a, "n", keep_first=["kind"]), RegionalSource("B", b, "n")]
    got = consolidate(sources, layout="B", renames={"type": "kind"})
    assert got.columns == ["kind", "unit_no", "source_rank", "row_in_source"]
    assert sorted(map(tuple, got.collect())) == [("x", "q", 1, 1), ("x", "s", 2, 1), ("y", "r", 1, 3)]


@pytest.mark.parametrize("name, n_regions", [("MSM", 5), ("FSW", 6), ("PWID", 6), ("TG", 5)])
def test_register_definitions(name, n_regions):
    spec = registers.REGISTERS[name]
    regions = [sheet.region for sheet in spec.sheets]
    assert len(set(regions)) == n_regions and spec.layout in regions


def test_register_from_landed_sheets(spark, tmp_path):
    """The FSW register from small files: preambles, a dropped column, first rows, blank keys."""
    head = '"KP_Type","KP Unique Identifier\r\n(SR/Client Initials/Typology/Hotspot/PE Code/Client No)"'
    landed = {}
    for sheet in registers.FSW.sheets:
        extra = ",A" if sheet.drop else ""
        cell = ",junk" if sheet.drop else ""
        lines = ["title"] * sheet.preamble + [head + extra]
        lines += [f"FSW,{sheet.region}1{cell}", f"FSW,{sheet.region}1{cell}", f",{sheet.region}2{cell}"]
        folder = tmp_path / sheet.region
        folder.mkdir()
        (folder / "s.csv").write_text("\n".join(lines) + "\n", newline="")
        landed[sheet.region] = land_sheets(spark, str(folder), 4, str(tmp_path / f"l{sheet.region}"))
    got = registers.consolidate_sheets(registers.FSW, landed)
    assert got.columns == ["kp_type", "kp_unique_identifier", "source_rank", "row_in_source"]
    found = sorted((r.source_rank, r.kp_unique_identifier) for r in got.collect())
    ranks = enumerate(registers.FSW.sheets, start=1)
    want = [(i, f"{s.region}1") for i, s in ranks for _ in range(1 if s.keep_first else 2)]
    assert found == want


def test_repair_restores_exchanged_columns_and_reads_dates(spark):
    columns = (
        "region string, county string, sr_name string, kp_type string, kp_unique_identifier string, "
        "kp_name string, sex string, hiv_status_at_enrollment string, "
        "date_of_next_appointment string, date_of_enrolment string"
    )
    rows = [
        ("LER", "Partner", "Nairobi", "FSW", "01_1", "Ann", "Male", "Uknown", "45413", "2024-01-02"),
        ("WKR", "Kisumu", "Partner", "02_2", "TG", None, None, "x", "TBD", "2024/01/02"),
        (None, "Lamu", "Partner", "TG", "05_3", "Bo", "Female", None, None, "soon"),
    ]
    got = repair_values(spark.createDataFrame(rows, columns), text_dates=["date_of_enrolment"])
    day, next_day = datetime.date(2024, 1, 2), datetime.date(2024, 5, 1)
    assert [tuple(r) for r in got.collect()] == [
        ("LER", "NAIROBI", "partner", "FSW", "01_1", "ann", "MALE", "Unknown", next_day, day),
        ("WKR", "KISUMU", "partner", "TG", "02_2", None, None, "x", None, day),
        (None, "LAMU", "partner", "TG", "05_3", "bo", "Female", None, None, None),
    ]


def test_tracker_with_a_question_mark(spark):
    names = ["Region", "Start Date", "End-Date", "Age", "Sex", "Complete Sessions?", "Other"]
    df = spark.createDataFrame([tuple("abcdefg")], ", ".join(f"c{i} string" for i in range(7)))
    got = tracker_extract(df.toDF(*names), renames={})
    assert tuple(got.first()) == tuple("abcdef")


@needs_tables
def test_known_counts(view):
    key, order = ["kp_unique_identifier"], ["sno"]
    assert hygiene.keep_nonblank(view, "kp_type").count() == 14_678
    assert hygiene.keep_missing(view, "date_of_enrolment").count() == 349
    errors = hygiene.date_order_errors(view, "date_of_first_contact", "date_of_enrolment")
    assert errors.count() == 2_608
    assert dupes.later_rows(view, key, order).count() == 13_499
    assert dupes.first_rows(view, key, order).count() == 1_501
    found = dupes.get_dupes(view, key, order)
    assert found.count() == 14_998
    assert found.agg(F.max("dupe_count")).first()[0] == 149
    assert dupes.later_rows(view, ["kp_name", *key], order).count() == 13_363
    services = indicators.count_rows(view, indicators.any_month_conditions(view)).first()
    assert tuple(services) == (10_099, 9_672, 9_707, 11_532)
    packages = indicators.count_rows(view, indicators.package_conditions(view)).first()
    assert packages.package_any_month == 6_890
    assert packages.package_from_flags == 4_900
    assert packages.aligned_any == 7_155
    assert tables.two_way_cube(view, "sr_name", "region").count() == 36


@needs_tables
def test_same_month_package_by_region(view):
    counted = indicators.count_rows(view, {"n": blocks.package_same_month(view)}, ["region"])
    got = {r["region"]: r["n"] for r in counted.collect()}
    assert got == dict(zip(REGIONS, (505, 534, 513, 502, 470)))


@needs_tables
def test_first_and_later_rows_make_up_the_register(view):
    key, order = ["kp_name"], ["sno"]
    parts = dupes.first_rows(view, key, order).unionByName(dupes.later_rows(view, key, order))
    assert parts.exceptAll(view).count() == 0 and parts.count() == view.count()


@needs_tables
def test_an_indicator_is_one_scan_of_few_columns_and_one_aggregate(view):
    plan = final_plan(indicators.count_rows(view, {"n": blocks.package_same_month(view)}, ["region"]))
    assert plan.count("FileScan parquet") == 4
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


@needs_tables
def test_a_region_filter_reaches_the_region_table(view):
    plan = final_plan(view.filter("region = 'COR'").select("sno"))
    scan = [line for line in plan.splitlines() if "Filter" in line and "r_name" in line]
    assert scan


@needs_tables
@pytest.mark.parametrize("name", ["dup_get_dupes", "prof_describe", "job_consolidate", "freq_one_way"])
def test_no_cross_join_and_no_python_in_plans(spark, name):
    import __spark_entry__ as contract

    plan = contract.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert operator not in plan
