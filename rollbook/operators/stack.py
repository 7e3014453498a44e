"""Stacking regional registers into one, with the row order kept as data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINEAGE = ("source_rank", "row_in_source")


def with_lineage(df: DataFrame, source_rank: int, row_id: str) -> DataFrame:
    """Add the stacking position: rank of the source, then the row id inside it."""
    return df.withColumns(
        {"source_rank": F.lit(source_rank), "row_in_source": F.col(row_id).cast("bigint")}
    )


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of frames that have the same column names."""
    names = set(frames[0].columns)
    for i, df in enumerate(frames[1:], start=1):
        if set(df.columns) != names:
            raise ValueError(f"frame {i} differs in {sorted(names ^ set(df.columns))}")
    return reduce(DataFrame.unionByName, frames)


def bind_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of frames, by name; columns that a frame lacks are NULL in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
