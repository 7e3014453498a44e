"""Column profiles: missing values, numeric summaries, text summaries, histograms.

Numeric profiles start from value counts, which combine before the shuffle and are written down once. Exact
quantiles then select ranks: only the ranges of values that hold a wanted rank are kept and cut again, until each is small
enough for one task to put in order. What needs every value's rank orders the values by ranges, as many as
it takes, and adds the totals of the ranges before.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rollbook.functions.values import number_column
from rollbook.sources.workspace import new_path

MOST_VALUES = 1 << 20  # different values that one task puts in order
RANGES = 128  # parts a range is cut into when it holds more
SKETCH_BITS = 14  # a sketch has 2^14 cells
SKETCH_ERROR = 0.03
_SKIM_TEXT = (
    "variable string, n_missing bigint, complete_rate double, min_length int, max_length int, empty bigint, "
    "n_unique bigint, whitespace bigint"
)
QUARTILES = (0.25, 0.5, 0.75)
DESCRIBE_QUANTILES = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


# ---- missing values ---------------------------------------------------------------------------


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(position, variable, n_miss, pct_miss) per column, from one pass over the data."""
    names = list(df.columns if columns is None else columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(names)],
    )
    cells = [
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("variable"), F.col(f"m{i}").alias("n_miss")
        )
        for i, c in enumerate(names)
    ]
    return counted.select("rows", F.inline(F.array(*cells))).select(
        "position", "variable", "n_miss", (F.col("n_miss") * 100 / F.col("rows")).alias("pct_miss")
    )


def missing_cumsum(df: DataFrame) -> DataFrame:
    """Missing count per column with the running total in column order."""
    running = W.orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    return missing_counts(df).select(
        "position", "variable", "n_miss", F.sum("n_miss").over(running).alias("n_miss_cumsum")
    )


def missing_summary(df: DataFrame) -> DataFrame:
    """Missing count and percentage per column, most missing first."""
    return missing_counts(df).orderBy(F.col("n_miss").desc(), "position")


# ---- numeric profiles -------------------------------------------------------------------------


def numeric_value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, value, n): rows per distinct number; cells that are no number count as NULL.

    The filter is always true. It keeps ``n`` in every use of this table, so that all uses in one
    query share one scan and one shuffle.
    """
    numbers = df.select(*[number_column(df, c).cast("double").alias(c) for c in columns])
    return (
        numbers.unpivot([], [F.col(f"`{c}`") for c in columns], "variable", "value")
        .groupBy("variable", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 0)
    )


def _known() -> Column:
    return F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _small(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table that is part of the plan, so that joining it takes no job of its own."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return spark.createDataFrame(
        pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})
    )


_TOTALS = "variable string, rows bigint, known bigint, n_distinct bigint, mean double, min double, max double"


def _column_totals(counts: DataFrame) -> list[Row]:
    """One row per column: rows, known, n_distinct, mean, min, max."""
    value = F.col("value")
    totals = counts.groupBy("variable").agg(
        F.sum("n").alias("rows"),
        F.sum(_known()).alias("known"),
        F.count("value").alias("n_distinct"),
        (F.sum(value * F.col("n")) / F.sum(_known())).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return totals.collect()


def _live(counts: DataFrame, live: list[tuple]) -> DataFrame:
    """Value counts inside the live ranges (variable, range, low, high, before); both ends belong to a range."""
    schema = "variable string, range int, low double, high double, before bigint"
    ranges = _small(counts.sparkSession, live, schema)  # at most two rows a wanted quantile
    inside = (F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))
    return counts.join(F.broadcast(ranges), "variable").where(inside)


def select_ranks(
    counts: DataFrame, wanted: Mapping[str, Sequence[int]], bounds: Mapping[str, tuple[float, float, int]]
) -> DataFrame:
    """(variable, rank, value): the values at 0-based ranks of each column, exactly.

    ``bounds`` gives the least and greatest value of a column and its number of different ones. While a range of values
    that holds wanted ranks has more than MOST_VALUES, it is cut at approximate quantiles, the parts are counted,
    and only those with a wanted rank stay, each with the count of the smaller values. Each round divides a range by
    about CUTS, whatever the distribution; the driver sees the counts of the parts only.
    """
    live = [(v, 0, lo, hi, 0) for v, (lo, hi, _) in bounds.items() if wanted.get(v)]
    sizes = {(v, 0): bounds[v][2] for v, *_ in live}
    while live and max(sizes.values()) > MOST_VALUES:
        inside = _live(counts, live)
        into = max(2, RANGES)
        fractions = F.array(*[F.lit(i / into) for i in range(1, into)])
        cuts = inside.groupBy("variable", "range").agg(F.percentile_approx("value", fractions, F.lit(4 * into)).alias("cuts"))
        part = F.size(F.filter("cuts", lambda c: c < F.col("value")))
        parts = inside.join(F.broadcast(cuts), ["variable", "range"]).groupBy("variable", "range", part.alias("part")).agg(
            F.sum("n").alias("n"), F.count("*").alias("values"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        before = {(v, r): b for v, r, _, _, b in live}
        nxt, sizes = [], {}
        for row in sorted(parts.collect(), key=lambda r: (r["variable"], r["range"], r["part"])):
            v, start = row["variable"], before[(row["variable"], row["range"])]
            before[(v, row["range"])] = end = start + row["n"]
            if any(start <= rank < end for rank in wanted[v]):
                place = sum(1 for x in nxt if x[0] == v)
                nxt.append((v, place, row["low"], row["high"], start))
                sizes[(v, place)] = row["values"]
        live = nxt
    ranks = [(v, rank) for v, some in wanted.items() for rank in sorted(set(some))]
    ranks = _small(counts.sparkSession, ranks, "variable string, rank bigint")
    inside = W.partitionBy("variable", "range").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    found = _live(counts, live).withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    covers = (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))
    return found.join(F.broadcast(ranks), "variable").where(covers).select("variable", "rank", "value")


def running_counts(counts: DataFrame, n_values: int) -> DataFrame:
    """Written value counts with ``before``, the rows of the column that hold a smaller number.

    Values are dealt by ranges of about MOST_VALUES; what the ranges before hold is added, one row a range and column.
    """
    order = [F.col("variable"), F.col("value").asc_nulls_first()]
    ranges = -(-n_values // MOST_VALUES)
    if ranges > 1:
        dealt = counts.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
        counts = _written(dealt, "value-ranges")
    else:
        counts = counts.withColumn("range", F.lit(0))
    smaller = W.partitionBy("variable").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.groupBy("variable", "range").agg(F.sum(_known()).alias("held"))
    offsets = offsets.select("variable", "range", F.coalesce(F.sum("held").over(smaller), F.lit(0)).alias("far"))
    inside = W.partitionBy("variable", "range").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    near = F.coalesce(F.sum(_known()).over(inside), F.lit(0))
    return counts.withColumn("near", near).join(offsets, ["variable", "range"]).select(
        "variable", "value", "n", (F.col("far") + F.col("near")).alias("before")
    )


def _quantiles(
    counts: DataFrame, rows: list[Row], totals: DataFrame, quantiles: Sequence[float]
) -> DataFrame:
    """Exact quantiles with linear interpolation between ranks, one column each."""
    places = {r["variable"]: [(r["known"] - 1) * p for p in quantiles] for r in rows if r["known"]}
    wanted = {v: [k for x in some for k in (math.floor(x), math.ceil(x))] for v, some in places.items()}
    bounds = {r["variable"]: (r["min"], r["max"], r["n_distinct"]) for r in rows if r["known"]}
    found = select_ranks(counts, wanted, bounds).join(F.broadcast(totals.select("variable", "known")), "variable")
    at = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("value")))
    columns = []
    for p in quantiles:
        place = (F.col("known") - 1) * F.lit(p)
        low, high = at(F.floor(place)), at(F.ceil(place))
        columns.append((low + (high - low) * F.max(place - F.floor(place))).alias(_quantile_name(p)))
    return found.groupBy("variable").agg(*columns)


def numeric_profile(
    df: DataFrame,
    columns: Sequence[str],
    quantiles: Sequence[float] = QUARTILES,
    ranks: bool = True,
    counts: DataFrame | None = None,
) -> DataFrame:
    """One row per column with every numeric statistic; without ``ranks``, all but Gini's mean difference.

    ``counts`` are the columns' written value counts, if there are any already.
    """
    if counts is None:
        counts = _written(numeric_value_counts(df, columns), "value-counts")
    rows = _column_totals(counts)
    totals = _small(counts.sparkSession, rows, _TOTALS)
    value, known, n, size = F.col("value"), F.col("known"), _known(), F.max("known")
    each = counts.join(F.broadcast(totals.select("variable", "known", "mean")), "variable")
    squares = F.sum((value - F.col("mean")) * (value - F.col("mean")) * n)
    ties = F.sum(F.pow(n / known, 3))
    spread = each.groupBy("variable").agg(
        F.sqrt(squares / F.when(size > 1, size - 1)).alias("sd"),
        F.when(size > 1, (1 - ties) / (1 - 1 / (size * size))).alias("info"),
    )
    out = totals.join(spread, "variable").join(
        _quantiles(counts, rows, totals, quantiles), "variable", "left"
    )
    if ranks:
        # With c smaller rows, a value held by n rows has ranks c+1..c+n; the rank sums collapse.
        each = running_counts(counts, sum(r["n_distinct"] for r in rows)).join(F.broadcast(totals.select("variable", "known")), "variable")
        gini = F.sum(value * n * (2 * F.col("before") + n - known)) * 2 / (size * (size - 1))
        gini = each.groupBy("variable").agg(F.when(size > 1, gini).alias("gini_mean_difference"))
        out = out.join(gini, "variable")
    return out.withColumn("n_missing", F.col("rows") - known).withColumnRenamed("known", "n")


def _quantile_name(p: float) -> str:
    return f"p{round(p * 100):02d}"


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, quartiles, mean, maximum and missing count of each column."""
    return numeric_profile(df, columns, ranks=False).select(
        "variable",
        "min",
        F.col("p25").alias("q1"),
        F.col("p50").alias("median"),
        "mean",
        F.col("p75").alias("q3"),
        "max",
        "n_missing",
    )


def skim_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing count, complete rate, mean, deviation and the five quantile points."""
    return numeric_profile(df, columns, ranks=False).select(
        "variable",
        "n_missing",
        (F.col("n") / F.col("rows")).alias("complete_rate"),
        "mean",
        "sd",
        F.col("min").alias("p0"),
        "p25",
        "p50",
        "p75",
        F.col("max").alias("p100"),
    )


def extremes(
    df: DataFrame, columns: Sequence[str], k: int = 5, counts: DataFrame | None = None
) -> DataFrame:
    """The k lowest and k highest distinct numbers of each column, as (variable, statistic, value)."""
    if counts is None:
        counts = numeric_value_counts(df, columns)
    value = F.col("value")
    sides = []
    for name, order in (("lowest", value.asc_nulls_last()), ("highest", value.desc_nulls_last())):
        place = F.row_number().over(W.partitionBy("variable").orderBy(order))
        sides.append(
            counts.withColumn("place", place)
            .filter((F.col("place") <= k) & value.isNotNull())
            .select("variable", F.concat(F.lit(f"{name}_"), "place").alias("statistic"), "value")
        )
    return sides[0].unionByName(sides[1])


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Extended numeric profile, long: (variable, statistic, value)."""
    statistics = ["n", "n_missing", "n_distinct", "info", "mean", "gini_mean_difference"]
    statistics += [_quantile_name(p) for p in DESCRIBE_QUANTILES]
    counts = _written(numeric_value_counts(df, columns), "value-counts")
    wide = numeric_profile(df, columns, DESCRIBE_QUANTILES, counts=counts)
    cells = [
        F.struct(F.lit(s).alias("statistic"), F.col(s).cast("double").alias("value"))
        for s in statistics
    ]
    return wide.select("variable", F.inline(F.array(*cells))).unionByName(
        extremes(df, columns, counts=counts)
    )


# ---- text profiles ----------------------------------------------------------------------------


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def _distinct_texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, n_unique), exactly: the different texts of a task are what is shuffled."""
    quoted = [F.col(f"`{c}`") for c in columns]
    texts = df.select(*quoted).unpivot([], quoted, "variable", "value").where(F.col("value").isNotNull())
    return texts.groupBy("variable", "value").agg(F.lit(1)).groupBy("variable").agg(F.count(F.lit(1)).alias("n_unique"))


def text_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row (per group of ``by``) with a sketch of the different texts of each column; ``merge_sketches`` adds them up.

    A sketch has a few KB whatever the number of rows, so sketches of each day or region can be kept and merged.
    """
    # a sketch leaves out empty text, so each text gets a mark
    marked = [F.concat(F.lit("="), F.col(f"`{c}`")) for c in columns]
    sketches = [F.hll_sketch_agg(m, F.lit(SKETCH_BITS)).alias(c) for m, c in zip(marked, columns)]
    return df.groupBy(*by).agg(*sketches)


def merge_sketches(sketches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, n_unique) of all rows of sketches together, within SKETCH_ERROR in 99 of 100 columns."""
    merged = sketches.agg(*[F.hll_union_agg(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(columns)])
    cells = [
        F.struct(F.lit(c).alias("variable"), F.hll_sketch_estimate(f"s{i}").alias("n_unique"))
        for i, c in enumerate(columns)
    ]
    return merged.select(F.inline(F.array(*cells)))


def skim_text(df: DataFrame, columns: Sequence[str] | None = None, sketch: bool = False) -> DataFrame:
    """Missing, complete rate, length range, blank, distinct and whitespace-only cells per column.

    All but the distinct count come from one aggregate that shuffles a row a task. Distinct texts are counted exactly,
    or, with ``sketch``, by a sketch within SKETCH_ERROR, which shuffles a few KB a task and column.
    """
    names = text_columns(df) if columns is None else list(columns)
    if not names:
        return df.sparkSession.createDataFrame([], _SKIM_TEXT)
    per = []
    for i, c in enumerate(names):
        cell = F.col(f"`{c}`")
        per += [
            F.count_if(cell.isNull()).alias(f"missing{i}"),
            F.min(F.length(cell)).alias(f"min{i}"),
            F.max(F.length(cell)).alias(f"max{i}"),
            F.count_if(cell == "").alias(f"empty{i}"),
            F.count_if(cell.rlike(r"^\s+$")).alias(f"space{i}"),
        ]
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *per).where("rows > 0")
    cells = [
        F.struct(
            F.lit(c).alias("variable"),
            F.col(f"missing{i}").alias("n_missing"),
            ((F.col("rows") - F.col(f"missing{i}")) / F.col("rows")).alias("complete_rate"),
            F.col(f"min{i}").alias("min_length"),
            F.col(f"max{i}").alias("max_length"),
            F.col(f"empty{i}").alias("empty"),
            F.col(f"space{i}").alias("whitespace"),
        )
        for i, c in enumerate(names)
    ]
    plain = counted.select(F.inline(F.array(*cells)))
    unique = merge_sketches(text_sketches(df, names), names) if sketch else _distinct_texts(df, names)
    return plain.join(unique, "variable", "left").select(
        "variable", "n_missing", "complete_rate", "min_length", "max_length", "empty",
        F.coalesce("n_unique", F.lit(0).cast("bigint")).alias("n_unique"), "whitespace",
    )


# ---- histograms -------------------------------------------------------------------------------


def pretty_breaks(low: float, high: float, n: int) -> list[float]:
    """Round, equally spaced break points for a count of ``n`` values, by Sturges' rule."""
    cells = math.ceil(math.log2(n) + 1)
    raw = (high - low) / cells or max(abs(high), 1.0)
    base = 10.0 ** math.floor(math.log10(raw))
    step = base
    # A rounder, larger step wins unless it overshoots; steps of 5 need the stronger case.
    for factor, smaller, bias in ((2, 1, 1.5), (5, 2, 2.75), (10, 5, 1.5)):
        if factor * base - raw >= bias * (raw - smaller * base):
            break
        step = factor * base
    first, last = math.floor(low / step + 1e-7), math.ceil(high / step - 1e-7)
    return [i * step for i in range(first, max(last, first + 1) + 1)]


def default_breaks(df: DataFrame, column: str) -> list[float]:
    """Break points from the range and count of a column (one small aggregate)."""
    value = number_column(df, column)
    row = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).first()
    if not row["n"]:
        raise ValueError(f"{column} holds no numbers")
    return pretty_breaks(row["lo"], row["hi"], row["n"])


def histogram(df: DataFrame, column: str, breaks: Sequence[float]) -> DataFrame:
    """Rows per cell ``(low, high]``; the first cell includes its low end, empty cells are kept.

    All values must lie within the breaks; a value outside them fails the query.
    """
    value = number_column(df, column)
    cells = list(zip(breaks, breaks[1:]))
    inside = [
        (value > low if i else value >= low) & (value <= high) for i, (low, high) in enumerate(cells)
    ]
    outside = (value < breaks[0]) | (value > breaks[-1])
    counted = df.agg(
        F.count_if(outside).alias("outside"),
        *[F.count_if(cond).alias(f"h{i}") for i, cond in enumerate(inside)],
    )
    rows = [
        F.struct(
            F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"), F.col(f"h{i}").alias("n")
        )
        for i, (low, high) in enumerate(cells)
    ]
    return counted.select(
        F.inline(
            F.when(F.col("outside") == 0, F.array(*rows)).otherwise(
                F.raise_error(F.lit(f"{column} has values outside the histogram breaks"))
            )
        )
    )


def value_pairs(df: DataFrame, group: str, column: str) -> DataFrame:
    """Rows per group and number: the points of a scatter plot with their weights."""
    return (
        df.select(group, number_column(df, column).alias(column))
        .groupBy(group, column)
        .agg(F.count(F.lit(1)).alias("n"))
    )
