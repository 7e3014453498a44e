"""CSV files and table snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from rollbook.functions.values import run_date_label
from rollbook.sources.records import land_records
from rollbook.sources.workspace import new_path

NA = "NA"
# White space at the ends of a cell is part of it, and a row ends where the writer ends it: looked
# for in the text, the end could be taken from a line break inside a cell.
_DIALECT = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "lineSep": "\n",
}


def write_csv(df: DataFrame, path: str, compress: bool = False) -> None:
    """CSV with a header; missing cells are the text NA. ``compress`` writes gzip parts."""
    writer = df.write.mode("overwrite").options(**_DIALECT, nullValue=NA)
    if compress:
        writer = writer.option("compression", "gzip")
    writer.csv(path)


def export_csv(df: DataFrame, folder: str, name: str, run_date: str) -> str:
    """Write a spreadsheet export filed under its name and run date; return its path. Other dates' exports stay."""
    label = df.sparkSession.range(1).select(run_date_label(F.lit(run_date).cast("date"))).first()[0]
    path = f"{folder.rstrip('/')}/{name}_{label}"
    write_csv(df, path, compress=True)
    return path


def _typed(field: StructField) -> Column:
    cell = F.col(f"`{field.name}`")
    if isinstance(field.dataType, StringType):
        return F.when(cell.isNull(), "").when(cell != NA, cell).alias(field.name)
    return cell.try_cast(field.dataType).alias(field.name)


# Types a column may have when none are given, the narrowest first.
_KINDS = ("int", "bigint", "double", "boolean", "date", "timestamp")


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    line_breaks: bool = True,
    line_sep: str | None = None,
) -> DataFrame:
    """CSV with a header and NA for missing. Blank text stays blank; blank numbers are NULL.

    The header of each file must agree with a given schema. Types are inferred only when no schema is given,
    which costs a pass over the files. Rows may end in LF or CR LF, also within a file, and cells may hold line
    breaks; a large file is read by many tasks all the same, after its records are landed once in the working folder.

    Where the row end is known, ``line_sep`` names it and the files are read as they lie: one task a file, or, with
    ``line_breaks=False``, many; a record that a line break cuts, or of another length than the header, fails the job.
    """
    if line_sep is None and line_breaks:
        return _typed_records(land_records(spark, path, new_path(spark, "csv-records")), schema)
    options = {**_DIALECT, "multiLine": line_breaks, "lineSep": line_sep or "\n", "mode": "FAILFAST"}
    reader = spark.read.options(**options)
    if schema is None:
        inferred = spark.read.options(**options, nullValue=NA)
        schema = inferred.csv(path, inferSchema=True).schema
    as_text = StructType([StructField(f.name, StringType()) for f in schema.fields])
    cells = reader.option("enforceSchema", False).schema(as_text).csv(path)
    return cells.select(*[_typed(f) for f in schema.fields])


def _typed_records(records: DataFrame, schema: StructType | None) -> DataFrame:
    """Records under the header that all their files share."""
    spark = records.sparkSession
    first = records.groupBy("source_file").agg(F.min_by("cells", "row_id").alias("names"))
    found = first.agg(F.min("names").alias("names"), F.max("names").alias("other")).first()
    names = found["names"]
    if names is None:
        if schema is None:
            raise ValueError("the files hold no header")
        return spark.createDataFrame([], schema)
    wanted = names if schema is None else schema.fieldNames()
    if names != found["other"] or names != wanted:
        raise ValueError(f"the headers {names} and {found['other']} are not {wanted}")
    head = records.groupBy("source_file").agg(F.min("row_id").alias("head"))  # a row a file
    body = records.join(head, "source_file").where("row_id > head")
    torn = F.raise_error(F.lit("a record is of another length than the header")).cast("boolean")
    body = body.where(F.when(F.size("cells") == len(names), True).otherwise(torn))
    cells = body.select(*[F.col("cells")[i].alias(c) for i, c in enumerate(names)])
    return cells.select(*[_typed(f) for f in (schema or _inferred(cells)).fields])


def _inferred(cells: DataFrame) -> StructType:
    """The narrowest type of each column that reads all its cells but NA and blank ones."""
    filled = {c: F.when(~F.col(f"`{c}`").isin(NA, ""), F.col(f"`{c}`")) for c in cells.columns}
    bad = [
        F.count_if(filled[c].isNotNull() & filled[c].try_cast(kind).isNull()).alias(f"{i}:{kind}")
        for i, c in enumerate(cells.columns)
        for kind in _KINDS
    ]
    counts = cells.agg(*bad, *[F.count(filled[c]).alias(f"{i}") for i, c in enumerate(cells.columns)]).first()
    kinds = [
        next((k for k in _KINDS if counts[f"{i}"] and not counts[f"{i}:{k}"]), "string") for i in range(len(cells.columns))
    ]
    return StructType([StructField(c, _parse_datatype_string(k)) for c, k in zip(cells.columns, kinds)])


def save_snapshot(
    df: DataFrame, path: str, run_date: str | None = None, partition_by: Sequence[str] = ()
) -> None:
    """Write a table snapshot, filed under its run date and any other partition columns.

    Snapshots of other run dates stay; one of the same date is replaced. A dated snapshot is written beside the others first,
    under a name that readers skip, and takes its place when it is whole, so a job that fails leaves what was there.
    Without a run date the path holds one snapshot, which is replaced.

    Rows are rebalanced by the partition columns first: each value gets few files, and a value
    that holds most rows is split over many tasks.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if run_date is None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return
    spark = df.sparkSession
    label = spark.range(1).select(run_date_label(F.lit(run_date).cast("date"))).first()[0]
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    writer = df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")  # the rename is the mark
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staged)
    _take_place(spark, staged, f"{path.rstrip('/')}/run_date={label}")


def _take_place(spark: SparkSession, staged: str, final: str) -> None:
    """Rename a finished folder to its place; what was there goes first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path
    source, target = folder(staged), folder(final)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        files.delete(target, True)
    if not files.rename(source, target):
        raise OSError(f"{staged} cannot be renamed to {final}")


def load_snapshot(spark: SparkSession, path: str, run_date: str | None = None) -> DataFrame:
    """Read a table snapshot: of one run date, or of all.

    Columns that only some dates have are NULL in the others.
    """
    found = spark.read.option("mergeSchema", True).parquet(path)
    if run_date is None:
        return found
    return found.where(F.col("run_date") == run_date_label(F.lit(run_date).cast("date")))


def run_dates(spark: SparkSession, path: str) -> list[str]:
    """Labels of the dates a snapshot was saved for, in order."""
    return sorted(r[0] for r in load_snapshot(spark, path).select("run_date").distinct().collect())
