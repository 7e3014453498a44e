"""Quality report on a register."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rollbook.functions import number_column, to_number
from rollbook.operators import dupes, profile
from rollbook.sources.files import load_snapshot, save_snapshot
from rollbook.sources.workspace import new_path

MAX_AGE = 100


def _long(df: DataFrame, section: str, statistics: Sequence[str]) -> DataFrame:
    cells = [
        F.struct(F.lit(s).alias("statistic"), F.col(s).cast("double").alias("value"))
        for s in statistics
    ]
    return df.select(F.lit(section).alias("section"), "variable", F.inline(F.array(*cells)))


def _repeats(df: DataFrame, key: str) -> DataFrame:
    found = (
        df.groupBy(F.col(f"`{key}`"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.lit(key).alias("variable"),
            F.count_if(F.col("n") > 1).alias("repeated_keys"),
            F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("rows_of_repeated_keys"),
            F.sum(F.col("n") - 1).alias("later_rows"),
        )
    )
    return _long(found, "repeats", ["repeated_keys", "rows_of_repeated_keys", "later_rows"])


def tracker_check(df: DataFrame, name: str) -> DataFrame:
    """(section, variable, statistic, value) of a tracker: missing cells, and people listed again."""
    return _long(profile.missing_counts(df), "missing", ["n_miss"]).unionByName(_repeats(df, name))


def quality_report(
    df: DataFrame,
    key: str,
    type_column: str,
    first_contact: str,
    enrolment: str,
    numeric: Sequence[str] = ("age", "yob"),
    age: str = "age",
) -> DataFrame:
    """(section, variable, statistic, value): missing cells, rule breaks, repeats, number ranges.

    Three passes: one for all missing and rule counts, one for the key, one for the numbers.
    """
    columns = df.columns
    counted = df.agg(
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(columns)],
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.coalesce(F.col(type_column) == "", F.lit(True))).alias("blank_type"),
        F.count_if(F.col(first_contact) > F.col(enrolment)).alias("date_order_errors"),
        F.count_if(number_column(df, age) > MAX_AGE).alias("age_too_high"),
    )
    cell = lambda section, variable, statistic, n: F.struct(
        F.lit(section).alias("section"),
        F.lit(variable).alias("variable"),
        F.lit(statistic).alias("statistic"),
        F.col(n).cast("double").alias("value"),
    )
    rules = [
        cell("register", "all", "rows", "rows"),
        cell("check", type_column, "blank", "blank_type"),
        cell("check", first_contact, "after_enrolment", "date_order_errors"),
        cell("check", age, "above_limit", "age_too_high"),
    ]
    missing = [cell("missing", c, "n_miss", f"m{i}") for i, c in enumerate(columns)]
    checks = counted.select(F.inline(F.array(*rules, *missing)))

    numbers = profile.numeric_summary(df, numeric)
    return (
        checks.unionByName(_repeats(df, key))
        .unionByName(_long(numbers, "numbers", ["min", "q1", "median", "mean", "q3", "max"]))
    )


@dataclass(frozen=True)
class SavedQuality:
    """What is known of a snapshot once it is written: the report, and the rows of repeated keys."""

    report: DataFrame
    repeats: DataFrame


def save_with_quality(
    df: DataFrame,
    path: str,
    run_date: str,
    key: str,
    order: Sequence[str],
    type_column: str,
    first_contact: str,
    enrolment: str,
    numeric: Sequence[str] = ("age", "yob"),
    levels: Sequence[str] = (),
    texts: Sequence[str] = (),
    age: str = "age",
    partition_by: Sequence[str] = (),
) -> SavedQuality:
    """Write a dated snapshot and report on it: (section, variable, statistic, value).

    Two scans. What needs no more than a row at a time (missing cells, rule breaks, lengths and blanks of texts) is
    observed while the snapshot is written. What needs a column's different values (repeated keys, levels, numbers,
    distinct texts) comes from one scan of those columns of the snapshot, as value counts that combine before the
    shuffle. The listed rows of repeated keys are a plan of their own, run when they are read.
    """
    columns = df.columns
    cell = lambda c: F.col(f"`{c}`")
    found = Observation()
    observed = df.observe(
        found,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.coalesce(cell(type_column) == "", F.lit(True))).alias("blank"),
        F.count_if(cell(first_contact) > cell(enrolment)).alias("late"),
        F.count_if(number_column(df, age) > MAX_AGE).alias("old"),
        *[F.count_if(cell(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.min(F.length(cell(c))).alias(f"short{i}") for i, c in enumerate(texts)],
        *[F.max(F.length(cell(c))).alias(f"long{i}") for i, c in enumerate(texts)],
        *[F.count_if(cell(c) == "").alias(f"empty{i}") for i, c in enumerate(texts)],
        *[F.count_if(cell(c).rlike(r"^\s+$")).alias(f"space{i}") for i, c in enumerate(texts)],
    )
    save_snapshot(observed, path, run_date, partition_by)
    seen = found.get
    rows = [
        ("register", "all", "rows", seen["rows"]),
        ("check", type_column, "blank", seen["blank"]),
        ("check", first_contact, "after_enrolment", seen["late"]),
        ("check", age, "above_limit", seen["old"]),
        *[("missing", c, "n_miss", seen[f"m{i}"]) for i, c in enumerate(columns)],
    ]
    for i, c in enumerate(texts):
        missing = seen[f"m{columns.index(c)}"]
        rate = (seen["rows"] - missing) / seen["rows"] if seen["rows"] else None
        names = ("complete_rate", "min_length", "max_length", "empty", "whitespace")
        values = (rate, *[seen[f"{k}{i}"] for k in ("short", "long", "empty", "space")])
        rows += [("text", c, name, v) for name, v in zip(names, values)]
    schema = "section string, variable string, statistic string, value double"
    spark = df.sparkSession
    saved = load_snapshot(spark, path, run_date)
    plain = spark.createDataFrame([(a, b, c, None if v is None else float(v)) for a, b, c, v in rows], schema)

    wanted = list(dict.fromkeys([key, *levels, *texts, *numeric]))
    as_text = saved.select(*[cell(c).cast("string").alias(c) for c in wanted])
    counts = as_text.unpivot([], [cell(c) for c in wanted], "variable", "value").groupBy("variable", "value")
    target = new_path(spark, "quality-values")
    counts.agg(F.count(F.lit(1)).alias("n")).write.parquet(target)
    counts = spark.read.schema("variable string, value string, n bigint").parquet(target)

    n, value = F.col("n"), F.col("value")
    repeated = counts.where(F.col("variable") == key).agg(
        F.lit(key).alias("variable"),
        F.count_if(n > 1).alias("repeated_keys"),
        F.sum(F.when(n > 1, n).otherwise(0)).alias("rows_of_repeated_keys"),
        F.sum(n - 1).alias("later_rows"),
    )
    parts = [plain, _long(repeated, "repeats", ["repeated_keys", "rows_of_repeated_keys", "later_rows"])]
    if levels:
        level = counts.where(F.col("variable").isin(*levels))
        parts.append(
            level.select(
                F.lit("level").alias("section"),
                "variable",
                F.coalesce(value, F.lit("NA")).alias("statistic"),
                n.cast("double").alias("value"),
            )
        )
    if texts:
        unique = counts.where(F.col("variable").isin(*texts)).groupBy("variable").agg(F.count("value").alias("n_unique"))
        parts.append(_long(unique, "text", ["n_unique"]))
    if numeric:
        typed = counts.where(F.col("variable").isin(*numeric)).withColumn("value", to_number(value))
        typed = typed.groupBy("variable", "value").agg(F.sum("n").alias("n"))
        numbers = profile.numeric_profile(saved, numeric, ranks=False, counts=typed)
        numbers = numbers.withColumnsRenamed({"p25": "q1", "p50": "median", "p75": "q3"})
        parts.append(_long(numbers, "numbers", ["min", "q1", "median", "mean", "q3", "max"]))
    report = parts[0]
    for more in parts[1:]:
        report = report.unionByName(more)
    return SavedQuality(report, dupes.get_dupes(saved, [key], order))
