"""Repeated keys.

"First" always means first by explicit order columns. NULL keys count as equal, NULL order values
come first.

No operator here gathers the rows of one key in one task. A key's first row is a minimum, which
combines before the shuffle; later rows are matched to it by their own place, which spreads evenly
however many rows a key has; group sizes meet the rows of large keys under salts, as many as the size asks for.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.sources.workspace import new_path

ROWS_A_SALT = 1 << 17  # rows of one key that meet its size in one task
SALTS = 16  # least salts of a key with more rows


def _quoted(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def _same(left: str, right: str, names: Sequence[str]) -> Column:
    both = [(F.col(f"{left}.`{n}`"), F.col(f"{right}.`{n}`")) for n in names]
    return reduce(Column.__and__, [a.eqNullSafe(b) for a, b in both])


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, and no other: of rows that tie, the least by all columns."""
    least = F.min(F.struct(F.struct(*_quoted(order)), F.struct(*_quoted(df.columns)).alias("row")))
    return df.groupBy(*_quoted(keys)).agg(least.alias("_least")).select("_least.row.*")


def later_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The second and later rows of each key. Fails if two rows tie for a key's first place."""
    place = list(dict.fromkeys([*keys, *order]))
    places = df.groupBy(*_quoted(place)).agg(F.count(F.lit(1)).alias("_n"))
    least = F.min(F.struct(F.struct(*_quoted(order)), *_quoted(place), "_n")).alias("_least")
    tied = F.raise_error(F.lit("the order columns do not tell a key's first row")).cast("boolean")
    first = (
        places.groupBy(*_quoted(keys))
        .agg(least)
        .select(*[F.col(f"_least.`{c}`") for c in place], "_least._n")
        .filter(F.when(F.col("_n") > 1, tied).otherwise(True))
    )
    return df.alias("row").join(first.alias("first"), _same("row", "first", place), "left_anti")


def get_dupes(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All rows of repeated keys with ``dupe_count``; keys first, largest groups first.

    Sizes are counted before any row moves. A key with more than ROWS_A_SALT rows gets a salt for each so many of them (SALTS at least);
    the list of such keys (at most a key for each ROWS_A_SALT rows of the table) tells its rows their salts. A row then
    meets its key's size under its salt. Small keys have one salt and are copied once. The order columns end the sort
    key, so that a hot key can fill many output partitions.
    """
    sizes = df.groupBy(*_quoted(keys)).agg(F.count(F.lit(1)).alias("dupe_count")).filter("dupe_count > 1")
    path = new_path(df.sparkSession, "group-sizes")
    salts = F.greatest(F.ceil(F.col("dupe_count") / ROWS_A_SALT).cast("int"), F.lit(SALTS))
    salts = F.when(F.col("dupe_count") > ROWS_A_SALT, salts).otherwise(1)
    sizes.withColumn("_salts", salts).write.parquet(path)
    sizes = df.sparkSession.read.parquet(path)
    large = sizes.filter("_salts > 1").select(*[F.col(f"`{k}`").alias(f"_of{i}") for i, k in enumerate(keys)], "_salts")
    found = reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(f"_of{i}")) for i, k in enumerate(keys)])
    dealt = F.pmod(F.xxhash64(*_quoted(order)), F.coalesce("_salts", F.lit(1))).cast("int").alias("_salt")
    rows = df.join(F.broadcast(large), found, "left").select(*_quoted(df.columns), dealt)
    sizes = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    same = _same("row", "size", keys) & (F.col("row._salt") == F.col("size._salt"))
    others = [F.col(f"row.`{c}`") for c in df.columns if c not in set(keys)]
    return (
        rows.alias("row")
        .join(sizes.alias("size"), same)
        .select(*[F.col(f"row.`{k}`") for k in keys], "dupe_count", *others)
        .orderBy(F.col("dupe_count").desc(), *_quoted(keys), *_quoted(order))
    )
