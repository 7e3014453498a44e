"""Cell functions: NULL, blank, bad text, ties."""

import datetime

import pytest
from pyspark.sql import functions as F

from rollbook import functions as fn
from rollbook.operators import columns


def column(spark, values, function, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", function(F.col("x"))).orderBy("i").collect()]


def test_if_na_keeps_unknown(spark):
    got = column(spark, ["a", "b", None], lambda c: fn.if_na(c == "a", F.lit("yes"), F.lit("no")))
    assert got == ["yes", "no", None]


def test_to_number_takes_plain_numbers_only(spark):
    texts = ["5", " 5 ", "-1.5", ".5", "7.", "1e3", "none", "", None, "NaN", "12d", "1,000", "0x1A"]
    want = [5.0, 5.0, -1.5, 0.5, 7.0, 1000.0] + [None] * 7
    assert column(spark, texts, fn.to_number) == want


def test_numeric_columns_are_not_parsed_again(spark):
    df = spark.createDataFrame([(1, "2")], "a bigint, b string")
    parsed = fn.parse_numbers(df, ["a", "b"])
    assert dict(parsed.dtypes) == {"a": "bigint", "b": "double"}


def test_text_is_compared_as_a_number(spark):
    df = spark.createDataFrame([("none",), ("0",), ("9",), ("10",), (None,)], "x string")
    got = [r[0] for r in df.select(fn.is_positive(df, "x")).collect()]
    assert got == [None, False, True, True, None]


def test_excel_dates(spark):
    texts = ["45413", "45413.7", "61", "60", "59", "1", "0", "-3", "99999999999", "TBD", None]
    d = datetime.date
    want = [d(2024, 5, 1), d(2024, 5, 1), d(1900, 3, 1), None, d(1900, 2, 28), d(1900, 1, 1)]
    assert column(spark, texts, fn.excel_date) == want + [None] * 5


def test_text_dates(spark):
    texts = ["2023-02-01", "2023/02/01", "01.02.2023", "1/2/2023", "01-02-2023", "01 Feb 2023", "1  february 2023"]
    assert column(spark, texts, fn.text_date) == [datetime.date(2023, 2, 1)] * len(texts)
    assert column(spark, ["TBD", "32/01/2023", "01/13/2023", "", None], fn.text_date) == [None] * 5


def test_date_cells_are_serials_or_text(spark):
    cells = ["45413", "2024-05-01", "01/05/2024", "01 May 2018", "soon", " ", None]
    day = datetime.date(2024, 5, 1)
    assert column(spark, cells, fn.cell_date) == [day, day, day, datetime.date(2018, 5, 1), None, None, None]
    assert column(spark, cells, fn.is_unread_date) == [False] * 4 + [True, False, False]


def test_paste_writes_na(spark):
    df = spark.createDataFrame([("a", None), (None, None)], "x string, y string")
    got = [r[0] for r in df.select(fn.concat_na(F.col("x"), F.col("y"))).collect()]
    assert got == ["aNA", "NANA"]


STATUS = {
    "positive": ("Positive", "Positive"),
    "negative": ("Negative", "Negative"),
    "Unknown": ("Unknown", "Unknown "),
    "Uknown": ("Unknown", "Unknown "),
    "unknown": ("Unknown", "Unknown"),
    "Known positive": ("Known Positive", "Known Positve"),
    "known Positive": ("Known Positive", "Known Positve"),
    "Known Positive": ("Known Positive", "Known Positve"),
    "Negative": ("Negative", "Negative"),
    None: (None, None),
}


@pytest.mark.parametrize("place, mapping", [(0, fn.STATUS_INTENDED), (1, fn.STATUS_AS_WRITTEN)])
def test_status_recode(spark, place, mapping):
    got = column(spark, list(STATUS), lambda c: fn.recode(c, mapping))
    assert got == [pair[place] for pair in STATUS.values()]


def test_place_from_code(spark):
    df = spark.createDataFrame([("05_1", "A"), ("06_1", "B"), (None, "C")], "id string, p string")
    got = [r[0] for r in df.select(fn.place_from_code(F.col("id"), F.col("p"))).collect()]
    assert got == ["LAMU", "B", None]


def test_swap_with_unknown_condition(spark):
    df = spark.createDataFrame([("X", "a", "b"), ("Y", "a", "b"), (None, "a", "b")], "r string, a string, b string")
    keep = columns.swap_where(df, F.col("r") == "X", "a", "b")
    blank = columns.swap_where(df, F.col("r") == "X", "a", "b", na="blank")
    assert [(r.a, r.b) for r in keep.collect()] == [("b", "a"), ("a", "b"), ("a", "b")]
    assert [(r.a, r.b) for r in blank.collect()] == [("b", "a"), ("a", "b"), (None, None)]


def test_lower_text_leaves_other_types(spark):
    df = spark.createDataFrame([("Ab", 1, "Cd")], "x string, n int, y string")
    assert tuple(columns.lower_text(df).first()) == ("ab", 1, "cd")
    assert tuple(columns.lower_text(df, ["y"]).first()) == ("Ab", 1, "cd")


def test_prefix_selection_anchors_every_prefix(spark):
    df = spark.createDataFrame([(1, 2, 3)], "age int, package int, visit_region int")
    assert columns.select_prefixes(df, ["region", "age"]).columns == ["age"]
    as_written = columns.select_prefixes(df, ["region", "age"], anchored=False)
    assert as_written.columns == ["age", "package"]
