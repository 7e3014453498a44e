"""Profiles and tables against numpy and plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollbook.operators import profile, tables


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(50, 20, 1500).round(1), np.full(800, 33.3), rng.lognormal(3, 2, 200)])
    rng.shuffle(values)
    return values


@pytest.fixture(scope="module")
def frame(spark, numbers):
    data = [(i, str(v), float(i)) for i, v in enumerate(numbers)]
    data += [(10_000 + i, bad, None) for i, bad in enumerate(["n/a", None, "", "NaN"])]
    df = spark.createDataFrame(data, "i int, x string, y double")
    return df.repartition(5).cache()


@pytest.mark.parametrize("ranges", [1, 7, 28, 200])
def test_quantiles_are_exact_for_any_number_of_ranges(frame, numbers, ranges, monkeypatch):
    monkeypatch.setattr(profile, "RANGES", ranges)
    points = (0.0, 0.05, 0.25, 0.5, 0.73, 0.95, 1.0)
    got = {r["variable"]: r for r in profile.numeric_profile(frame, ["x", "y"], points).collect()}
    for name, values in (("x", numbers), ("y", np.arange(len(numbers)))):
        want = np.quantile(values, points)
        have = [got[name][profile._quantile_name(p)] for p in points]
        assert have == pytest.approx(list(want), rel=1e-12)
        assert got[name]["n_missing"] == 4 and got[name]["n"] == len(values)


@pytest.mark.parametrize("most,ranges", [(3, 2), (40, 5), (500, 128)])
def test_ranges_with_more_values_are_cut_again(frame, numbers, most, ranges, monkeypatch):
    monkeypatch.setattr(profile, "MOST_VALUES", most)
    monkeypatch.setattr(profile, "RANGES", ranges)
    points = (0.0, 0.1, 0.5, 0.77, 1.0)
    got = {r["variable"]: r for r in profile.numeric_profile(frame, ["x", "y"], points).collect()}
    for name, values in (("x", numbers), ("y", np.arange(len(numbers)))):
        have = [got[name][profile._quantile_name(p)] for p in points]
        assert have == pytest.approx(list(np.quantile(values, points)), rel=1e-12)
    n = len(numbers)
    pairs = np.abs(numbers[:, None] - numbers[None, :]).sum() / (n * (n - 1))
    assert got["x"]["gini_mean_difference"] == pytest.approx(pairs)


def test_no_task_orders_more_than_a_range(spark, monkeypatch):
    """Selected ranges hold at most MOST_VALUES values, however many there are."""
    monkeypatch.setattr(profile, "MOST_VALUES", 200)
    monkeypatch.setattr(profile, "RANGES", 8)
    seen = []
    live = profile._live
    monkeypatch.setattr(profile, "_live", lambda counts, some: seen.append(some) or live(counts, some))
    df = spark.range(20_000).select(F.exp(F.col("id") / 900).alias("x"))
    got = profile.numeric_summary(df, ["x"]).first()
    assert got["median"] == pytest.approx((np.exp(9999 / 900) + np.exp(10000 / 900)) / 2)
    assert len(seen) > 2
    last = [(low, high) for _, _, low, high, _ in seen[-1]]
    assert all(df.where(F.col("x").between(low, high)).count() <= 200 for low, high in last)


def test_sketches_of_groups_merge(spark):
    df = spark.range(30_000).select(
        (F.col("id") % 7).alias("g"), F.concat(F.lit("k"), F.col("id") % 9000).alias("s"), F.lit(None).cast("string").alias("e")
    )
    merged = profile.merge_sketches(profile.text_sketches(df, ["s", "e"], ["g"]), ["s", "e"])
    got = {r["variable"]: r["n_unique"] for r in merged.collect()}
    assert got["e"] == 0 and abs(got["s"] / 9000 - 1) < profile.SKETCH_ERROR
    sketched = {r["variable"]: r for r in profile.skim_text(df, ["s", "e"], sketch=True).collect()}
    assert sketched["s"]["n_unique"] == got["s"] and sketched["e"]["n_missing"] == 30_000


def test_moments_gini_and_info(frame, numbers):
    got = profile.numeric_profile(frame, ["x"]).first()
    n = len(numbers)
    pairs = np.abs(numbers[:, None] - numbers[None, :]).sum() / (n * (n - 1))
    _, counts = np.unique(numbers, return_counts=True)
    assert got["mean"] == pytest.approx(numbers.mean())
    assert got["sd"] == pytest.approx(numbers.std(ddof=1))
    assert got["gini_mean_difference"] == pytest.approx(pairs)
    assert got["info"] == pytest.approx((1 - ((counts / n) ** 3).sum()) / (1 - 1 / n**2))
    assert got["n_distinct"] == len(counts)


def test_describe_lists_the_extremes(frame, numbers):
    got = {r["statistic"]: r["value"] for r in profile.describe(frame, ["x"]).collect()}
    distinct = np.unique(numbers)
    assert [got[f"lowest_{i}"] for i in range(1, 6)] == list(distinct[:5])
    assert [got[f"highest_{i}"] for i in range(1, 6)] == list(distinct[::-1][:5])


def test_column_without_numbers(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    got = profile.numeric_summary(df, ["x"]).first()
    assert (got["min"], got["median"], got["mean"], got["n_missing"]) == (None, None, None, 2)


def test_single_value(spark):
    df = spark.createDataFrame([("4",)], "x string")
    got = profile.skim_numeric(df, ["x"]).first()
    assert (got["p0"], got["p50"], got["p100"], got["sd"]) == (4.0, 4.0, 4.0, None)


def test_value_counts_are_scanned_once(frame, monkeypatch):
    """The counts are made once, before the report; the report's own plan reads them and never the data."""
    made = []
    count = profile.numeric_value_counts
    monkeypatch.setattr(profile, "numeric_value_counts", lambda *a: made.append(a) or count(*a))
    df = profile.describe(frame.select("x"), ["x"])
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(made) == 1 and "value-counts" in plan
    assert "InMemoryTableScan" not in plan and plan.count("partial_count(1)") == 0


def test_missing_counts(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None)], "a int, b int, c string")
    got = [tuple(r) for r in profile.missing_cumsum(df).orderBy("position").collect()]
    assert got == [(0, "a", 0, 0), (1, "b", 2, 2), (2, "c", 1, 3)]
    first = profile.missing_summary(df).first()
    assert (first["variable"], first["pct_miss"]) == ("b", 100.0)


def test_text_profile(spark):
    df = spark.createDataFrame([("ab",), ("",), ("  ",), (None,), ("ab",)], "x string")
    got = profile.skim_text(df).first()
    assert (got.n_missing, got.empty, got.whitespace, got.n_unique) == (1, 1, 1, 3)
    assert (got.min_length, got.max_length, got.complete_rate) == (0, 2, 0.8)


def test_breaks():
    assert profile.pretty_breaks(18, 140, 15_000) == [10.0 * i for i in range(1, 15)]
    assert profile.pretty_breaks(0, 1, 10) == pytest.approx([0.0, 0.2, 0.4, 0.6, 0.8, 1.0])
    assert profile.pretty_breaks(1, 100, 100)[0] <= 1


def test_histogram_is_closed_on_the_right(spark):
    df = spark.createDataFrame([(str(v),) for v in (0, 10, 10.5, 20, 30)], "x string")
    got = [tuple(r) for r in profile.histogram(df, "x", [0, 10, 20, 30]).collect()]
    assert got == [(0.0, 10.0, 2), (10.0, 20.0, 2), (20.0, 30.0, 1)]
    breaks = profile.default_breaks(df, "x")
    assert sum(r.n for r in profile.histogram(df, "x", breaks).collect()) == 5
    with pytest.raises(Exception, match="outside the histogram breaks"):
        profile.histogram(df, "x", [0, 10]).collect()


def test_one_way_levels_and_labels(spark):
    df = spark.createDataFrame([("a",)] * 1 + [(None,)] * 3 + [("b",)] * 4, "x string")
    got = [tuple(r) for r in tables.one_way(df, "x").collect()]
    assert got == [("a", 1, 0.125, 0.2), ("b", 4, 0.5, 0.8), (None, 3, 0.375, None)]
    label = tables.one_way_percent(df, "x").filter("x = 'a'").first()
    assert (label["pct"], label["label"]) == (12.5, "12.50% (1)")


def test_percent_ties_go_to_the_even_digit(spark):
    shares = spark.createDataFrame([(0.00125, 1), (0.00375, 3)], "s double, n int")
    got = [r[0] for r in shares.select(tables.percent_label(F.col("s"), F.col("n"))).collect()]
    assert got == ["0.12% (1)", "0.38% (3)"]


def test_unlisted_levels_are_counted(spark):
    df = spark.createDataFrame([("a", "A"), ("a", "Z"), ("a", None), ("b", "Z")], "r string, c string")
    assert [tuple(r) for r in tables.two_way(df, "r", "c", ["A"]).collect()] == [("a", 1, 2), ("b", 0, 1)]
    for row in tables.two_way_totals(df, "r", "c", ["A", None]).collect():
        assert row["A"] + row["NA_"] + row["other_levels"] == row["total"]


def test_totals_are_not_confused_with_missing(spark):
    df = spark.createDataFrame([("a", "x"), (None, "x"), (None, None)], "r string, c string")
    got = [tuple(r) for r in tables.two_way_totals(df, "r", "c", ["x", "y"]).collect()]
    assert got == [("a", 1, 0, 0, 1, 0), (None, 1, 0, 1, 2, 0), ("Total", 2, 0, 1, 3, 1)]
    wide = tables.two_way(df, "r", "c", ["x", None])
    assert wide.columns == ["r", "x", "NA_", "other_levels"]
    assert [tuple(r) for r in wide.collect()] == [("a", 1, 0, 0), (None, 1, 1, 0)]
    cube = {(r.r_level, r.c_level, r.margin): r.n for r in tables.two_way_cube(df, "r", "c").collect()}
    assert cube[(None, None, 0)] == 1 and cube[("Total", "Total", 3)] == 3
    assert cube[("Total", None, 2)] == 1 and cube[(None, "Total", 1)] == 2
