"""Date cells that vote for how they are read."""

import datetime

import pytest
from pyspark.sql import functions as F

from rollbook.operators import dates
from rollbook.plans.repair import repair_values


def day(text):
    return None if text is None else datetime.date.fromisoformat(text)


def read(spark, rows, **options):
    df = spark.createDataFrame([(i, f, c) for i, (f, c) in enumerate(rows)], "i int, file string, d string")
    return [r.d for r in dates.read_dates(df, ["d"], **options).orderBy("i").collect()]


@pytest.mark.parametrize(
    "cells,want",
    [
        (["2018", "5", "3/4/2024"], [None, None, "2024-04-03"]),
        (["2018", "5", "45292", "3/4/2024"], [None, None, "2024-01-01", "2024-04-03"]),
        (["05/13/2018", "3/4/2024", "2024-02-01"], ["2018-05-13", "2024-03-04", "2024-02-01"]),
        (["13/05/2018", "25/12/2018", "05/13/2018", "3/4/2024"], ["2018-05-13", "2018-12-25", "2018-05-13", "2024-04-03"]),
        (["1-31-2024", "1.2.2024", " 2 Mar 2024 ", None, "", "TBD"], ["2024-01-31", "2024-01-02", "2024-03-02", None, None, None]),
    ],
)
def test_cells_are_read_as_the_column_votes(spark, cells, want):
    assert read(spark, [("a", c) for c in cells]) == [day(w) for w in want]


def test_files_vote_for_themselves(spark):
    rows = [("us", "12/31/2023"), ("us", "1/2/2024"), ("eu", "31/12/2023"), ("eu", "1/2/2024"), (None, "45300"), (None, "1/2/2024"), ("eu", "45300")]
    got = read(spark, rows, by=["file"])
    assert got == [day(d) for d in ("2023-12-31", "2024-01-02", "2023-12-31", "2024-02-01", "2024-01-09", "2024-02-01", "2024-01-09")]


def test_votes_and_range(spark):
    df = spark.createDataFrame([("45292",), ("2018",), ("13/1/2024",), ("1/13/2024",), ("1/1/2024",), (None,)], "d string")
    assert tuple(dates.date_votes(df, ["d"]).first()) == ("d", 1, 1, 1)
    wide = dates.SerialRange("1900-01-01", "1910-01-01")
    got = dates.read_dates(df, ["d"], serials=wide).collect()
    assert [r.d for r in got][:2] == [None, day("1905-07-10")]
    assert dates.read_dates(df.limit(0), ["d"]).count() == 0


def test_unread_cells_and_repair(spark):
    df = spark.range(6).select(
        F.col("id").alias("sno"),
        F.element_at(F.array(*map(F.lit, ["45292", "2018", "TBD", "", "3/4/2024", "45300"])), (F.col("id") + 1).cast("int")).alias("date_of_next_appointment"),
        *[F.lit("x").alias(c) for c in ("region", "county", "sr_name", "kp_name", "kp_type", "kp_unique_identifier", "sex", "hiv_status_at_enrollment")],
    )
    fixed = repair_values(df, vote_by=["region"])
    got = {r.sno: r.date_of_next_appointment for r in fixed.collect()}
    assert got == {0: day("2024-01-01"), 1: None, 2: None, 3: None, 4: day("2024-04-03"), 5: day("2024-01-09")}
    unread = dates.unread_cells(df, fixed, ["date_of_next_appointment"], "sno").first()
    assert unread.n_unread == 2
