"""Records read by many tasks, files under many headers, CSV of other platforms, dated snapshots."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from rollbook.plans import registers
from rollbook.sources import files, records, variants

CELLS = ["a", "", "x,y", "li\nne", 'q"q', "\r\n", 'é\n\n\n"z"', "cr\r", "﻿", "'"]


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of the given size; restores the session's."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]

    def use(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")

    yield use
    for k, v in zip(keys, before):
        spark.conf.set(k, v)


def write(folder, name, rows, ends, last=True):
    os.makedirs(folder, exist_ok=True)
    out = ""
    for i, row in enumerate(rows):
        buffer = io.StringIO()
        csv.writer(buffer, lineterminator=ends[i % len(ends)]).writerow(row)
        out += buffer.getvalue()
    with open(f"{folder}/{name}", "w", newline="", encoding="utf-8") as f:
        f.write(out if last else out.rstrip("\r\n"))


def random_rows(rng, n):
    rows = [[rng.choice([*CELLS, "long " * rng.randrange(40)]) for _ in range(rng.randrange(1, 6))] for _ in range(n)]
    return [r if r != [""] else ["k"] for r in rows]


@pytest.mark.parametrize("size", [40, 333, 1 << 27])
def test_records_of_any_range_size(spark, tmp_path, small_ranges, size):
    rng = random.Random(4)
    want = {}
    for name, ends, last in (("a.csv", ["\n"], True), ("b.csv", ["\r\n"], True), ("c.csv", ["\n", "\r\n"], False)):
        want[name] = random_rows(rng, 25)
        write(str(tmp_path / "in"), name, want[name], ends, last)
    small_ranges(size)
    got = records.land_records(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()
    for name, rows in want.items():
        own = sorted((r.row_id, r.cells) for r in got if r.source_file.endswith(name))
        assert own == list(enumerate(rows))


def test_a_cell_longer_than_many_ranges(spark, tmp_path, small_ranges):
    rows = [["a", "b"], ["x" * 500 + "\n" + "y\n" * 300, "1"], ["c", "d"]]
    write(str(tmp_path / "in"), "a.csv", rows, ["\n"])
    small_ranges(64)
    got = records.land_records(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()
    assert [r.cells for r in sorted(got, key=lambda r: r.row_id)] == rows


@pytest.mark.parametrize("sep", [",", "|"])
def test_plain_and_quoted_lines_side_by_side(spark, tmp_path, sep):
    """Lines without quotes are cut by Arrow, the others by the CSV reader; order, empty lines and marks stay."""
    lines = ["\ufeffa|b,c", "", ",", "x", '"q,|",1', "é,|z", "last,\r", "|", '"",']
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.csv").write_bytes("\n".join(lines).encode())
    got = records.land_records(spark, str(tmp_path / "in"), str(tmp_path / "out"), sep)
    parsed = list(csv.reader([x.removeprefix("\ufeff").removesuffix("\r") for x in lines], delimiter=sep))
    want = [(i, cells) for i, cells in enumerate(parsed) if cells]
    assert sorted((r.row_id, r.cells) for r in got.collect()) == want


def test_records_are_not_shuffled_to_find_their_place(spark, tmp_path):
    write(str(tmp_path / "in"), "a.csv", [["a", "b"], ["c", "d"]], ["\n"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = records.land_records(spark, str(tmp_path / "in"), str(tmp_path / "out"))
        plan = got._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_quote_left_open_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"c,d\ne,f\n')
    with pytest.raises(Exception, match="never closed"):
        records.land_records(spark, str(tmp_path / "a.csv"), str(tmp_path / "out")).collect()


@pytest.mark.parametrize("ends", [["\n"], ["\r\n"], ["\n", "\r\n"], ["\r\n", "\n"]])
def test_line_ends_give_equal_rows(spark, tmp_path, ends):
    rows = [["id", "name"], ["1", "a"], ["2", "two\r\nlines"], ["NA", "NA"], ["", ""], ["id", "name"]]
    write(str(tmp_path / "in"), "a.csv", rows, ends)
    got = files.read_csv(spark, str(tmp_path / "in"))
    assert got.dtypes == [("id", "string"), ("name", "string")]
    want = [("1", "a"), ("2", "two\r\nlines"), (None, None), ("", ""), ("id", "name")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    typed = files.read_csv(spark, str(tmp_path / "in"), got.selectExpr("cast(id as int) id", "name").schema)
    assert sorted((r.id for r in typed.collect()), key=repr) == sorted([1, 2, None, None, None], key=repr)


def test_kinds_are_inferred(spark, tmp_path):
    rows = [["i", "l", "d", "b", "day", "s", "none"], ["1", "3000000000", "0.5", "true", "2024-02-01", "x", "NA"]]
    write(str(tmp_path / "in"), "a.csv", [*rows, ["NA", "1", "2", "false", "NA", "1", ""]], ["\r\n"])
    kinds = dict(files.read_csv(spark, str(tmp_path / "in")).dtypes)
    assert list(kinds.values()) == ["int", "bigint", "double", "boolean", "date", "string", "string"]


def test_other_headers_and_torn_records_are_refused(spark, tmp_path):
    write(str(tmp_path / "in"), "a.csv", [["a", "b"], ["1", "2"]], ["\n"])
    with pytest.raises(ValueError, match="are not"):
        files.read_csv(spark, str(tmp_path / "in"), spark.createDataFrame([], "a int, c int").schema)
    write(str(tmp_path / "in"), "b.csv", [["b", "a"], ["1", "2"]], ["\n"])
    with pytest.raises(ValueError, match="are not"):
        files.read_csv(spark, str(tmp_path / "in"))
    write(str(tmp_path / "torn"), "a.csv", [["a", "b"], ["1"]], ["\n"])
    with pytest.raises(Exception, match="another length"):
        files.read_csv(spark, str(tmp_path / "torn"), spark.createDataFrame([], "a int, b int").schema).collect()


def folder_of(column="source_file"):
    return F.regexp_extract(column, "/([A-Z]+)/[^/]*$", 1)


TINY = registers.Register(
    "TINY",
    (registers.Sheet("AA", 1), registers.Sheet("BB", 2, drop=("a",)), registers.Sheet("CC", 0, keep_first=True)),
    layout="AA",
    key="kp_type",
    client="client_no",
)


def landed(spark, tmp_path, more=()):
    base = tmp_path / "in"
    write(str(base / "AA"), "1.csv", [["Title"], ["KP Type", "Client-No", "Note", "Visit", "Visit"], ["F", "1", "n", "Yes", ""]], ["\n"])
    write(str(base / "AA"), "2.csv", [["Note", "Client-No", "KP type", "Visit", "Visit", ""], ["m", "2", "F", "No", "Yes"]], ["\r\n"])
    write(str(base / "BB"), "1.csv", [["", "t\nu"], ["KP Type", "Client-No", "a", "Note", "V", "W"], ["G", "3", "x", " k ", "1", "2", " "]], ["\n"])
    write(str(base / "CC"), "1.csv", [["Client-No", "KP Type", "Note"], ["4", "H", "first"], ["4", "H", "later"], ["5", "", "x"]], ["\n"])
    for folder, name, rows in more:
        write(str(base / folder), name, rows, ["\n"])
    return records.land_records(spark, f"{base}/*", str(tmp_path / "out"))


def test_headers_of_all_files_open_in_one_pass(spark, tmp_path):
    rows = registers.consolidate_records(
        registers.Register(**{**TINY.__dict__, "sheets": TINY.sheets[:2]}), landed(spark, tmp_path).where("source_file not like '%/CC/%'"), folder_of(), {}
    )
    assert rows.columns == ["kp_type", "client_no", "note", "visit4", "visit5", "source_rank", "row_in_source"]
    got = sorted(tuple(r)[:6] for r in rows.collect())
    assert got == [("F", "1", "n", "Yes", None, 1), ("F", "2", "m", "No", "Yes", 1), ("G", "3", "k", "1", "2", 2)]


def test_a_header_that_does_not_fit_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="cannot take the names"):
        registers.consolidate_records(TINY, landed(spark, tmp_path), folder_of(), {})
    with pytest.raises(ValueError, match="no region"):
        registers.consolidate_records(TINY, landed(spark, tmp_path, [("DD", "1.csv", [["KP Type"]])]), folder_of(), {})
    with pytest.raises(ValueError, match="no row holds"):
        registers.consolidate_records(TINY, landed(spark, tmp_path, [("DD", "1.csv", [["Type"]])]), folder_of(), {})


def test_empty_columns_and_first_rows(spark, tmp_path):
    base = tmp_path / "in"
    write(str(base / "AA"), "1.csv", [["KP Type", "Client-No", "Gone", "Note"], ["F", "1", " ", "n"]], ["\n"])
    write(str(base / "CC"), "1.csv", [["Client-No", "KP Type", "Note"], ["4", "H", "first"], ["4", "H", "later"], ["5", "", "x"]], ["\n"])
    both = registers.Register(**{**TINY.__dict__, "sheets": (TINY.sheets[0], TINY.sheets[2]), "drop_empty": True})
    found = records.land_records(spark, f"{base}/*", str(tmp_path / "out"))
    rows = registers.consolidate_records(both, found, folder_of(), {"note": "remark"})
    assert sorted(tuple(r)[:4] for r in rows.collect()) == [("F", "1", "n", 1), ("H", "4", "first", 2)]
    assert rows.columns[:3] == ["kp_type", "client_no", "remark"]


def test_cells_right_of_the_header_are_refused(spark, tmp_path):
    write(str(tmp_path / "in" / "AA"), "1.csv", [["KP Type", "B"], ["F", "1", "stray"]], ["\n"])
    found = records.land_records(spark, f"{tmp_path}/in/*", str(tmp_path / "out"))
    headers = variants.find_headers(found, "KP Type")
    place = lambda by, header: {c: i for i, c in enumerate(variants.header_names(header))}
    with pytest.raises(Exception, match="right of its header"):
        variants.open_variants(found, headers, ["B"], place).collect()


def test_earlier_dates_stay_and_a_rerun_replaces_its_own(spark, tmp_path):
    path = str(tmp_path / "snap")
    df = spark.range(10).withColumn("region", F.when(F.col("id") < 5, "A").otherwise("B"))
    files.save_snapshot(df, path, "2024-05-01", ["region"])
    files.save_snapshot(df.where("id < 7"), path, "2024-05-02", ["region"])
    files.save_snapshot(df.where("id < 3").withColumn("extra", F.lit(1)), path, "2024-05-02", ["region"])
    got = files.load_snapshot(spark, path)
    assert files.run_dates(spark, path) == ["24-05-01", "24-05-02"]
    assert sorted((r.run_date, r.id, r.region, r.extra) for r in got.where("run_date = '24-05-02'").collect()) == [
        ("24-05-02", i, "A", 1) for i in range(3)
    ]
    assert files.load_snapshot(spark, path, "2024-05-01").count() == 10
    bad = df.withColumn("id", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        files.save_snapshot(bad, path, "2024-05-01", ["region"])
    assert files.load_snapshot(spark, path, "2024-05-01").count() == 10
