"""Helpers of several operators: written tables, ranks in any number of groups, files, vocabularies."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.sources.workspace import new_path

# What separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back; the lineage ends there.

    A lost executor then costs a read, and ids given while writing can't change.
    """
    spark = df.sparkSession
    path = new_path(spark, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let Arrow batches of whole texts hold few rows and bytes; 10,000 long texts don't fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, by: list[str], order: list[str], add: tuple[str, ...] = ()) -> DataFrame:
    """Add ``rank`` (from 0) and, for each column c of ``add`` (long), ``before_c``: its sum over the rows before.

    Both count inside each group of ``by``, in ascending ``order`` with nulls last; ``order`` must identify
    a row of a group. Rows are dealt by ranges of (by, order), so that a group of any size fills many
    tasks; what the ranges before it hold is added to each row. Window sums run per range and group.
    """
    add = [("rank", F.lit(1).cast("long")), *((f"before_{c}", F.coalesce(F.col(c), F.lit(0))) for c in add)]
    keys = [F.col(c).asc_nulls_last() for c in (*by, *order)]
    dealt = df.repartitionByRange(partitions(df.sparkSession), *keys)
    dealt = settle(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    part = dealt.groupBy("_range", *by).agg(*[F.sum(value).alias(f"_sum_{c}") for c, value in add])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(
        F.col("_range").alias("_of"),
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)],
        *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_far_{c}") for c, _ in add],
    )
    inside = Window.partitionBy("_range", *by).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.select("*", *[F.coalesce(F.sum(value).over(inside), F.lit(0)).alias(f"_near_{c}") for c, value in add])
    same = F.col("_range") == F.col("_of")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    sums = [(F.col(f"_near_{c}") + F.col(f"_far_{c}")).cast("long").alias(c) for c, _ in add]
    return rows.join(part, same).select(*df.columns, *sums)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def open_store(uri: str):
    """A file system and a path in it, for a URI that any Hadoop or cloud store may serve."""
    from pyarrow import fs

    if re.match(r"^[a-z][a-z0-9+.-]*:", uri):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return fs.LocalFileSystem(), uri


def write_file(uri: str, chunks: Iterator[bytes]) -> int:
    """Write a file under a name that only this attempt uses; return its size."""
    store, path = open_store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    size = 0
    with store.open_output_stream(path, compression=None) as out:  # as is, whatever the name ends in
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    return size


def read_bytes(path: str) -> bytes:
    """A vocabulary file, read where the job is planned; tasks get its few MB as a broadcast."""
    with open(path, "rb") as f:
        return f.read()


def whole_groups(frames, keys: list[str], rows: int = 65536):
    """From pandas frames sorted by ``keys``: frames of about ``rows`` rows in which no group is torn."""
    import pandas as pd

    held, n = [], 0
    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        n += len(frame)
        if n < rows:
            continue
        whole = pd.concat(held, ignore_index=True)
        last = whole[keys].eq(whole[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = len(whole) - int(last[::-1].argmin()) if not last.all() else 0
        if cut:
            yield whole.iloc[:cut]
        held, n = [whole.iloc[cut:]], len(whole) - cut
    if n:
        yield pd.concat(held, ignore_index=True)


def starts_of(frame, keys: list[str]):
    """Positions at which a new group begins in a sorted frame."""
    import numpy as np

    new = np.ones(len(frame), bool)
    if len(frame) > 1:
        new[1:] = (frame[keys].to_numpy()[1:] != frame[keys].to_numpy()[:-1]).any(axis=1)
    return np.flatnonzero(new)


def split_hot(rows: DataFrame, keys: list[str], spread: Column, block: int) -> DataFrame:
    """Deal the members of each group to pairs of blocks, so that any two members meet in one pair.

    Groups of at most ``block`` rows have the one pair (0, 0). Larger ones are dealt by ``spread`` into
    blocks, and each block goes to all pairs that hold it. Adds ``_i``, ``_j`` and ``_own`` (its block).
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    sizes = settle(sizes.withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int")).drop("_n"), "hot")
    dealt = rows.join(sizes, keys, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("_own", F.pmod(F.hash(spread), "_blocks"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.select(
        *rows.columns,
        "_own",
        F.least("_own", "_other").alias("_i"),
        F.greatest("_own", "_other").alias("_j"),
    )
