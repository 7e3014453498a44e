"""Field sheets, exported as CSV: title rows, then a header row, then text cells.

Landing turns the files into one parquet table with every cell as text and a row id that is fixed
from then on. A file is read by one task, because its cells may hold line breaks; all later work
runs on the landed table. Opening finds the header, drops what lies above it, and names the
columns.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.operators.headers import unique_by_position
from rollbook.sources.workspace import new_path


def land_sheets(spark: SparkSession, path: str, width: int, out: str) -> DataFrame:
    """Copy sheets of at most ``width`` columns to a parquet table at ``out``, all as text.

    A record with more cells, blank ones included, fails the job wherever its extra cells lie: no
    cell is left out.
    """
    cells = [f"c{i}" for i in range(width)]
    (
        spark.read.schema(", ".join(f"{c} string" for c in cells))
        .options(header=False, multiLine=True, quote='"', escape='"', maxColumns=width)
        # The end of a row is given: a line break inside the first cells must not be taken for it.
        # The carriage return before it, if any, goes with the white space.
        .options(ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, lineSep="\n")
        .csv(path)
        .select(
            *cells,
            F.col("_metadata.file_path").alias("source_file"),
            F.monotonically_increasing_id().alias("row_id"),
        )
        .write.mode("overwrite")
        .parquet(out)
    )
    return spark.read.parquet(out)


def _plain(text: Column) -> Column:
    """Header text for comparison: lower case, one underscore for all that is no letter or digit."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def equals_anchor(cell: Column, anchor: str) -> Column:
    """Whether a cell is the anchor, but for case and marks.

    Cells that lack one of the anchor's words, nearly all, are told by plain search; only the others are repaired.
    """
    wanted = re.sub("[^a-z0-9]+", "_", anchor.lower()).strip("_")
    holds = [F.lower(cell).contains(word) for word in wanted.split("_")]
    return reduce(Column.__and__, [*holds, _plain(cell) == wanted])


def open_sheets(landed: DataFrame, skip: int | None = None, anchor: str | None = None) -> DataFrame:
    """Data rows of landed sheets under their repaired headers, with their place.

    ``row_in_sheet`` counts from the header of each file; ``row_id`` orders all landed rows and is
    unique among them.

    The header is the first row that has a cell equal to ``anchor``, but for case and marks. With
    ``skip`` as well, a header below more than ``skip`` rows is refused; blank rows are not landed,
    so fewer are fine. With ``skip`` alone, the header is the row after so many landed rows. All
    files opened together must share one header; blank or repeated headers get their position
    appended. Cells are trimmed, and blank ones are NULL. Columns beyond the last header cell must
    be empty.

    The cells are read once for the headers of all files, and only rows that hold the anchor are ordered; the headers'
    table has a row a file and is written down.
    """
    if skip is None and anchor is None:
        raise ValueError("give skip or anchor")
    cells = [c for c in landed.columns if c not in ("source_file", "row_id")]
    row = F.struct("row_id", F.array(*cells).alias("names"))
    starts = landed.groupBy("source_file").agg(F.min("row_id").alias("first_id"))
    if anchor is None:
        heads = landed.join(starts, "source_file").where(F.col("row_id") == F.col("first_id") + skip)
    else:
        heads = landed.where(reduce(Column.__or__, [equals_anchor(F.col(c), anchor) for c in cells]))
    heads = heads.groupBy("source_file").agg(F.min(row).alias("header"))
    found = starts.join(heads, "source_file", "left").select(
        "source_file",
        F.col("header.row_id").alias("header_id"),
        F.col("header.names").alias("names"),
        "first_id",
    )
    path = new_path(landed.sparkSession, "sheet-headers")
    found.write.parquet(path)
    headers = landed.sparkSession.read.schema(found.schema).parquet(path)

    # One header in common means that the least and the greatest header row are the same.
    total = headers.agg(
        F.count_if(F.col("header_id").isNull()).alias("without"),
        F.min("names").alias("names"),
        F.max("names").alias("other"),
        F.max(F.col("header_id") - F.col("first_id")).alias("above"),
    ).first()
    if total["without"] or total["names"] is None:
        raise ValueError("some sheets have no header row")
    if total["names"] != total["other"]:
        raise ValueError("the sheets have no header row in common")
    if anchor is not None and skip is not None and total["above"] > skip:
        raise ValueError(f"{total['above']} rows above the header; at most {skip} are expected")
    names = total["names"]
    last = max(i for i, name in enumerate(names) if name is not None)
    used, unused = cells[: last + 1], cells[last + 1 :]

    body = landed.join(headers.select("source_file", "header_id"), "source_file")
    below = F.col("row_id") > F.col("header_id")
    kept = below
    if unused:
        stray = reduce(Column.__or__, [F.coalesce(F.trim(c) != "", F.lit(False)) for c in unused])
        refuse = F.raise_error(F.lit("a sheet has cells to the right of its header"))
        kept = F.when(below & stray, refuse.cast("boolean")).otherwise(below)
    cell = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return body.filter(kept).select(
        *[cell(c).alias(n) for c, n in zip(used, unique_by_position(names[: last + 1]))],
        "source_file",
        (F.col("row_id") - F.col("header_id")).alias("row_in_sheet"),
        "row_id",
    )
