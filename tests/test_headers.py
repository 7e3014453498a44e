"""Header lists and frames that carry them."""

import pytest

from rollbook.operators import headers


def test_repeated_and_blank_headers_get_their_position():
    assert headers.unique_by_position(["a", "b", "a", "", None, "c...9"]) == [
        "a...1", "b", "a...3", "...4", "...5", "c",
    ]


def test_clean_headers():
    raw = [
        "KP Unique Identifier (SR/No)", "Sex", "sex", "% tested", "2nd visit", "Café #", "dateOfBirth", " ",
    ]
    assert headers.clean_headers(raw) == [
        "kp_unique_identifier_sr_no", "sex", "sex_2", "percent_tested", "x2nd_visit",
        "cafe_number", "date_of_birth", "x",
    ]


def test_rule_chains():
    assert headers.apply_rules(["Date-of Birth (dd/mm)."], headers.REGISTER_RULES) == [
        "date_of_birth_ddmm"
    ]
    assert headers.apply_rules(['a\\b "c"'], headers.EXPORT_RULES) == ["ab_c"]
    assert headers.apply_rules(["Complete sessions?:"], headers.TRACKER_RULES) == [
        "complete_sessions"
    ]


def test_rename_takes_either_line_break(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int").toDF("x\ny", "b")
    assert headers.rename_columns(df, {"x\r\ny": "z"}).columns == ["z", "b"]


def test_rename_refuses_an_absent_column(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="absent"):
        headers.rename_columns(df, {"nope": "z"})


def test_positional_rename_needs_equal_counts(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert headers.rename_by_position(df, ["x", "y"]).columns == ["x", "y"]
    with pytest.raises(ValueError, match="2 columns cannot take 1"):
        headers.rename_by_position(df, ["x"])


def test_names_that_differ_in_case_only_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError, match="not unique"):
        headers.rename_by_position(df, ["x", "X"])


def test_schema_diff_counts_what_would_be_lost(spark):
    left = spark.createDataFrame([(1, "a", None), (2, None, None)], "k int, x string, y string")
    right = left.select("k")
    assert [tuple(r) for r in headers.schema_diff(left, right).collect()] == [("x", 1), ("y", 0)]
    assert headers.schema_diff(right, left).collect() == []
