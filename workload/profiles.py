"""Queries on frequency tables and column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.operators import profile, tables
from workload.catalog import number, query
from workload.register import COLUMNS, REGIONS, register

DIGITS = 6
NUMERIC = ("age", "yob")


def _rounded(df):
    """Fractions to six digits, so that the order of summation does not show."""
    return df.select(
        *[
            F.round(f.name, DIGITS).alias(f.name) if f.dataType.simpleString() == "double" else f.name
            for f in df.schema.fields
        ]
    )


# ---- frequency tables -------------------------------------------------------------------------

_ONE_WAY = (
    "SELECT {c}, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM register) AS DOUBLE), 6) "
    "AS percent, CASE WHEN {c} IS NOT NULL THEN round(count(*) / CAST((SELECT count({c}) FROM "
    "register) AS DOUBLE), 6) END AS valid_percent FROM register GROUP BY {c}"
)


@query(_ONE_WAY.format(c="kp_type"))
def freq_one_way(spark, sf_dir):
    return _rounded(tables.one_way(register(spark, sf_dir), "kp_type"))


@query(
    "SELECT sr_name, count(*) AS n, round_even(count(*) / CAST((SELECT count(*) FROM register) AS "
    "DOUBLE) * 100, 2) AS pct FROM register GROUP BY sr_name"
)
def freq_one_way_pct(spark, sf_dir):
    return tables.one_way_percent(register(spark, sf_dir), "sr_name").drop("label")


@query(
    "SELECT sr_name, n, pct, printf('%.2f%% (%d)', pct, n) AS label FROM (SELECT sr_name, count(*) AS n, "
    "round_even(count(*) / CAST((SELECT count(*) FROM register) AS DOUBLE) * 100, 2) AS pct "
    "FROM register GROUP BY sr_name) t"
)
def freq_one_way_label(spark, sf_dir):
    """With the printed label."""
    return tables.one_way_percent(register(spark, sf_dir), "sr_name")


def _cells(column: str, values) -> str:
    listed = [
        (f"{column} IS NULL", "NA_") if v is None else (f"{column} = '{v}'", v) for v in values
    ]
    other = " AND ".join(f"({test}) IS NOT TRUE" for test, _ in listed)
    listed.append((other, "other_levels"))
    return ", ".join(f'count(*) FILTER (WHERE {test}) AS "{name}"' for test, name in listed)


_CELLS = _cells("region", REGIONS)
SEXES = ("Male", "Female", None)  # the fourth level is not listed


@query(f"SELECT county, {_CELLS} FROM register GROUP BY county")
def freq_two_way(spark, sf_dir):
    return tables.two_way(register(spark, sf_dir), "county", "region", REGIONS)


@query(
    "SELECT CASE WHEN grouping(county) = 1 THEN 'Total' ELSE county END AS county, "
    f"{_CELLS}, count(*) AS total, CAST(grouping(county) AS INT) AS is_total "
    "FROM register GROUP BY ROLLUP (county)"
)
def freq_two_way_totals(spark, sf_dir):
    return tables.two_way_totals(register(spark, sf_dir), "county", "region", REGIONS)


@query(f"SELECT county, {_cells('sex', SEXES)} FROM register GROUP BY county")
def freq_two_way_unlisted(spark, sf_dir):
    return tables.two_way(register(spark, sf_dir), "county", "sex", SEXES)


@query(
    "SELECT CASE WHEN grouping(county) = 1 THEN 'Total' ELSE county END AS county, "
    f"{_cells('sex', SEXES)}, count(*) AS total, CAST(grouping(county) AS INT) AS is_total "
    "FROM register GROUP BY ROLLUP (county)"
)
def freq_two_way_totals_unlisted(spark, sf_dir):
    return tables.two_way_totals(register(spark, sf_dir), "county", "sex", SEXES)


@query(
    "SELECT CASE WHEN grouping(sex) = 1 THEN 'Total' ELSE sex END AS sex_level, "
    "CASE WHEN grouping(region) = 1 THEN 'Total' ELSE region END AS region_level, "
    "CAST(grouping(sex, region) AS INT) AS margin, count(*) AS n "
    "FROM register GROUP BY CUBE (sex, region)"
)
def freq_two_way_cube(spark, sf_dir):
    return tables.two_way_cube(register(spark, sf_dir), "sex", "region")


# ---- numeric profiles -------------------------------------------------------------------------


def _per_column(select: str, names=NUMERIC) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, {select} FROM (SELECT {number(c)} AS v FROM register) t"
        for c in names
    )


@query(
    _per_column(
        "min(v) AS min, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, "
        "round(avg(v), 6) AS mean, quantile_cont(v, 0.75) AS q3, max(v) AS max, "
        "count(*) - count(v) AS n_missing"
    )
)
def prof_numeric_summary(spark, sf_dir):
    return _rounded(profile.numeric_summary(register(spark, sf_dir), NUMERIC))


@query(
    _per_column(
        "count(*) - count(v) AS n_missing, round(count(v) / CAST(count(*) AS DOUBLE), 6) "
        "AS complete_rate, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, min(v) AS p0, "
        "quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, "
        "max(v) AS p100",
        (*NUMERIC, "condoms_distributed_nmbr46"),
    )
)
def prof_skim_numeric(spark, sf_dir):
    df = register(spark, sf_dir)
    return _rounded(profile.skim_numeric(df, [*NUMERIC, "condoms_distributed_nmbr46"]))


_DESCRIBED = {
    "n": "count(v)",
    "n_missing": "count(*) - count(v)",
    "n_distinct": "count(DISTINCT v)",
    "mean": "avg(v)",
    **{f"p{round(p * 100):02d}": f"quantile_cont(v, {p})" for p in profile.DESCRIBE_QUANTILES},
}


@query(
    f"""
, v AS (SELECT {number("age")} AS v FROM register)
, counted AS (
  SELECT v, count(*) AS n, sum(count(*)) OVER (ORDER BY v) - count(*) AS before,
    row_number() OVER (ORDER BY v) AS low, row_number() OVER (ORDER BY v DESC) AS high,
    sum(count(*)) OVER () AS size
  FROM v WHERE v IS NOT NULL GROUP BY v)
SELECT 'age' AS variable, statistic, round(value, 6) AS value FROM (
  {" UNION ALL ".join(
      f"SELECT '{name}' AS statistic, CAST({text} AS DOUBLE) AS value FROM v"
      for name, text in _DESCRIBED.items()
  )}
  UNION ALL SELECT 'gini_mean_difference',
    sum(v * n * (2 * before + n - size)) * 2 / (max(size) * (max(size) - 1)) FROM counted
  UNION ALL SELECT 'info', (1 - sum(pow(n / CAST(size AS DOUBLE), 3))) /
    (1 - 1 / CAST(max(size) * max(size) AS DOUBLE)) FROM counted
  UNION ALL SELECT 'lowest_' || low, v FROM counted WHERE low <= 5
  UNION ALL SELECT 'highest_' || high, v FROM counted WHERE high <= 5
) d"""
)
def prof_describe(spark, sf_dir):
    return _rounded(profile.describe(register(spark, sf_dir), ["age"]))


# ---- text and missing-value profiles ----------------------------------------------------------

_TEXT = [c for c in COLUMNS if c not in ("sno", "date_of_first_contact", "date_of_enrolment")]


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*) - count({c}) AS n_missing, "
        f"round(count({c}) / CAST(count(*) AS DOUBLE), 6) AS complete_rate, "
        f"CAST(min(length({c})) AS INT) AS min_length, CAST(max(length({c})) AS INT) AS max_length, "
        f"count(*) FILTER (WHERE {c} = '') AS empty, count(DISTINCT {c}) AS n_unique, "
        f"count(*) FILTER (WHERE {c} <> '' AND trim({c}) = '') AS whitespace FROM register"
        for c in _TEXT
    )
)
def prof_skim_text(spark, sf_dir):
    return _rounded(profile.skim_text(register(spark, sf_dir)))


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*) - count({c}) AS n_missing, CAST(1 AS INT) AS within_error FROM register"
        for c in _TEXT
    )
)
def prof_skim_text_sketch(spark, sf_dir):
    """Distinct counts by sketches kept for each region and merged: within the stated error of the exact ones."""
    df = register(spark, sf_dir)
    exact = profile.skim_text(df).select("variable", "n_missing", "n_unique")
    kept = profile.text_sketches(df.withColumn("part", F.col("region")), _TEXT, ["part"])
    merged = profile.merge_sketches(kept, _TEXT)
    near = F.abs(F.col("sketched") - F.col("n_unique")) <= F.col("n_unique") * profile.SKETCH_ERROR
    return exact.join(merged.withColumnRenamed("n_unique", "sketched"), "variable").select(
        "variable", "n_missing", near.cast("int").alias("within_error")
    )


_MISSING = " UNION ALL ".join(
    f"SELECT CAST({i} AS INT) AS position, '{c}' AS variable, count(*) - count({c}) AS n_miss, "
    "count(*) AS n FROM register"
    for i, c in enumerate(COLUMNS)
)


@query(
    "SELECT position, variable, n_miss, CAST(sum(n_miss) OVER (ORDER BY position) AS BIGINT) "
    f"AS n_miss_cumsum FROM ({_MISSING}) m"
)
def prof_missing_cumsum(spark, sf_dir):
    return profile.missing_cumsum(register(spark, sf_dir))


@query(
    "SELECT position, variable, n_miss, round(n_miss * 100 / CAST(n AS DOUBLE), 6) AS pct_miss "
    f"FROM ({_MISSING}) m"
)
def prof_missing_summary(spark, sf_dir):
    return _rounded(profile.missing_summary(register(spark, sf_dir)))


_BREAKS = [float(b) for b in range(0, 160, 10)]


@query(
    " UNION ALL ".join(
        f"SELECT CAST({lo} AS DOUBLE) AS low, CAST({hi} AS DOUBLE) AS high, count(*) FILTER (WHERE "
        f"{number('age')} {'>=' if lo == 0 else '>'} {lo} AND {number('age')} <= {hi}) AS n FROM register"
        for lo, hi in zip(_BREAKS, _BREAKS[1:])
    )
)
def prof_histogram(spark, sf_dir):
    return profile.histogram(register(spark, sf_dir), "age", _BREAKS)


@query(f"SELECT region, {number('age')} AS age, count(*) AS n FROM register GROUP BY 1, 2")
def prof_age_by_region(spark, sf_dir):
    return profile.value_pairs(register(spark, sf_dir), "region", "age")
