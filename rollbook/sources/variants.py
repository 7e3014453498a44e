"""Landed records under many headers, read as one table.

Each file's header is found and kept in a registry: which cell of the file's rows gives which column of the layout.
All files then open in one pass, whatever the order and the names of their columns.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.operators.headers import unique_by_position
from rollbook.sources.sheets import equals_anchor
from rollbook.sources.workspace import new_path


def find_headers(landed: DataFrame, anchor: str) -> DataFrame:
    """(source_file, header_id, header, above): the first row of each file that holds the anchor, and the rows above it.

    Cells are read once, and only rows that hold the anchor are ordered; the table has a row a file and is written down.
    A file without such a row fails.
    """
    heads = landed.where(F.exists("cells", lambda c: equals_anchor(c, anchor)))
    heads = heads.groupBy("source_file").agg(F.min(F.struct("row_id", "cells")).alias("header"))
    found = landed.groupBy("source_file").agg(F.min("row_id").alias("first_id")).join(heads, "source_file", "left")
    found = found.select(
        "source_file",
        F.col("header.row_id").alias("header_id"),
        F.col("header.cells").alias("header"),
        (F.col("header.row_id") - F.col("first_id")).alias("above"),
    )
    path = new_path(landed.sparkSession, "header-registry")
    found.write.parquet(path)
    headers = landed.sparkSession.read.schema(found.schema).parquet(path)
    lost = headers.where("header_id is null").select("source_file").limit(3).collect()
    if lost:
        raise ValueError(f"no row holds {anchor!r} in {[r[0] for r in lost]}")
    return headers


def header_names(header: Sequence[str | None]) -> list[str]:
    """Unique names of a header's cells, without the blank cells right of the last filled one."""
    cells = [(h or "").strip() for h in header]
    last = max(i for i, h in enumerate(cells) if h)
    return unique_by_position(cells[: last + 1])


def open_variants(
    landed: DataFrame,
    headers: DataFrame,
    layout: Sequence[str],
    column_of: Callable[[str, Sequence[str | None]], Mapping[str, int]],
    by: Column | None = None,
) -> DataFrame:
    """Rows below the headers of all files, as the layout's columns, with source_file, by and row_in_sheet.

    ``column_of(by, header)`` says at which place of a header each layout column stands; it is asked once for each
    distinct pair, on the driver. ``by`` is an expression over ``source_file`` that tells files apart whose headers are read in
    different ways. Layout columns that a header lacks are NULL in its files. Cells are trimmed, blank ones are NULL, and rows
    without a filled cell are left out. A filled cell right of its header fails the job.
    """
    spark = landed.sparkSession
    headers = headers.withColumn("by", (F.lit("") if by is None else by).cast("string"))
    registry = []
    for r in headers.select("by", "header").distinct().collect():
        places = column_of(r["by"], r["header"])
        width = len(header_names(r["header"]))
        registry.append((r["by"], r["header"], [places.get(c) for c in layout], width))
    schema = "by string, header array<string>, places array<int>, width int"
    registry = spark.createDataFrame(registry, schema)
    known = headers.join(registry, ["by", "header"]).select("source_file", "header_id", "by", "places", "width")
    path = new_path(spark, "header-places")
    known.write.parquet(path)
    known = spark.read.schema(known.schema).parquet(path)
    body = landed.join(known, "source_file").where("row_id > header_id")
    stray = F.exists(F.slice("cells", F.col("width") + 1, F.greatest(F.size("cells"), F.lit(1))), lambda c: F.trim(c) != "")
    refuse = F.raise_error(F.lit("a sheet has cells to the right of its header")).cast("boolean")
    body = body.where(F.when(stray, refuse).otherwise(True))
    cell = lambda place: F.trim(F.get("cells", place))
    aligned = F.transform("places", lambda place: F.when(cell(place) != "", cell(place)))
    body = body.withColumn("aligned", aligned).where(F.exists("aligned", lambda c: c.isNotNull()))
    return body.select(
        *[F.col("aligned")[i].alias(c) for i, c in enumerate(layout)],
        "source_file",
        "by",
        (F.col("row_id") - F.col("header_id")).alias("row_in_sheet"),
    )


def empty_places(landed: DataFrame, headers: DataFrame, by: Column) -> dict[tuple[str, tuple], set[int]]:
    """For each pair of ``by`` and header: the places whose cells are blank in all files of the pair. One pass."""
    headers = headers.withColumn("by", by.cast("string")).select("source_file", "header_id", "by", "header")
    body = landed.join(headers, "source_file").where("row_id > header_id")
    filled = F.filter(
        F.transform("cells", lambda c, i: F.when(F.trim(c) != "", i)), lambda i: i.isNotNull()
    )
    seen = body.select("by", "header", F.explode_outer(filled).alias("place"))
    seen = seen.groupBy("by", "header").agg(F.collect_set("place").alias("places"))
    full = {(r["by"], tuple(r["header"])): set(r["places"]) for r in seen.collect()}
    every = {(r["by"], tuple(r["header"])) for r in headers.select("by", "header").distinct().collect()}
    return {k: set(range(len(k[1]))) - full.get(k, set()) for k in every}
