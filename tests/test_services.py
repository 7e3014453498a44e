"""Monthly blocks and indicators: missing months, pairing, and relations between indicators."""

import itertools

import pytest
from pyspark.sql import functions as F

from rollbook.operators import blocks, indicators
from rollbook.plans.indicators import indicator_report
from workload.register import register

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def months(spark):
    cells = ["Yes", "No", None]
    data = [(i, *c) for i, c in enumerate(itertools.product(cells, repeat=3))]
    return spark.createDataFrame(data, "id int, s100 string, s22 string, s9 string").cache()


def test_blocks_are_ordered_by_number(months):
    assert blocks.block_columns(months, "s") == ["s9", "s22", "s100"]
    assert blocks.block_columns(months, "S") == ["s9", "s22", "s100"]
    with pytest.raises(ValueError, match="no monthly columns"):
        blocks.block_columns(months, "x")


def test_derived_columns_are_not_months(months):
    assert len(blocks.block_columns(months.withColumn("s", F.lit("Yes")), "s")) == 3


def test_unequal_month_counts_are_refused(months):
    with pytest.raises(ValueError, match="differ in months"):
        blocks.aligned_blocks(months.withColumn("t1", F.lit("Yes")), ["s", "t"])


def test_any_flag_and_month_count(months):
    got = months.select(
        "s100", "s22", "s9", blocks.any_flag(months, "s").alias("f"), blocks.months_yes(months, "s").alias("n")
    )
    for row in got.collect():
        cells = list(row)[:3]
        flag = "Yes" if "Yes" in cells else None if None in cells else "No"
        assert (row.f, row.n) == (flag, cells.count("Yes"))


def test_strict_and_filled_totals(spark):
    df = spark.createDataFrame(
        [("1", "2"), ("1", None), ("0", "0"), ("0", None), ("none", "4")], "q1 string, q2 string"
    )
    for frame in (df, blocks.parse_numbers(df, ["q1", "q2"])):
        strict = [r[0] for r in frame.select(blocks.quantity_total(frame, "q")).collect()]
        filled = [r[0] for r in frame.select(blocks.quantity_total(frame, "q", skip_null=True)).collect()]
        assert strict == [3.0, None, 0.0, None, None]
        assert filled == [3.0, 1.0, 0.0, 0.0, 4.0]


def test_counts_are_zero_on_missing_cells(spark):
    df = spark.createDataFrame([(None, None)], "s1 string, q1 string")
    assert tuple(indicators.count_value(df, "s").first()) == (0,)
    assert tuple(indicators.count_positive(df, "q").first()) == (0,)


def test_case_can_be_ignored(spark):
    df = spark.createDataFrame([("yes",), ("Yes",), ("no",)], "s1 string")
    assert indicators.count_value(df, "s").first()[0] == 1
    assert indicators.count_value(df, "s", ignore_case=True).first()[0] == 2


def test_nonzero_columns(spark):
    counts = spark.createDataFrame([(3, 0, 1)], "a bigint, b bigint, c bigint")
    assert [tuple(r) for r in indicators.nonzero_columns(counts).collect()] == [("a", 3), ("c", 1)]
    assert indicators.keep_nonzero_columns(counts).columns == ["a", "c"]


def test_relations_between_indicators(spark):
    rows = indicator_report(register(spark, SF_DIR)).collect()
    assert rows
    for r in rows:
        assert r.package_same_month <= r.package_any_month
        assert r.package_from_flags <= r.package_any_month
        assert r.package_any_month <= min(r.sti_any, r.condoms_any)
        assert r.package_any_month <= r.clients


def test_lowered_register_counts_the_same(spark):
    from rollbook.operators.columns import lower_text

    df = register(spark, SF_DIR).drop("hiv_status_at_enrollment")
    plain = indicator_report(df, by=["region"]).drop("region")
    lowered = indicator_report(lower_text(df), by=["region"], ignore_case=True).drop("region")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, lowered.collect()))


def test_partitioning_does_not_change_the_report(spark):
    df = register(spark, SF_DIR)
    one, many = indicator_report(df.coalesce(1)), indicator_report(df.repartition(9))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
