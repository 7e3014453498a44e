"""Records of delimited files, read by many tasks however large a file is.

A record ends at a line end outside quotes. Whether a byte range starts inside quotes depends on the number of quote
marks before it, so each range counts its own first; the parities add up along the file, one small row a range. Each
task then puts its lines together to records, and hands on only what crosses the edge of its range. Rows may end in LF
or CR LF, also within one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUOTE = '"'
_RECORD = "source_file string, split long, place long, kind string, text string, cells array<string>"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    # Only LF parts lines here: a lone carriage return can be part of a cell.
    return spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("split"),
    )


def _parse(records: list[str], sep: str) -> list[list[str]]:
    import csv
    import sys

    csv.field_size_limit(sys.maxsize)
    return list(csv.reader([r[:-1] if r.endswith("\r") else r for r in records], delimiter=sep, quotechar=QUOTE))


def _stitch(sep: str):
    """Lines of ranges in order to whole records, and to what crosses a range's edge."""

    def stitch(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ("source_file", "split", "place", "kind", "text", "cells")
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()))
        here, held, inside, headless, place = None, [], False, False, 0
        whole, cut = [], []

        def plain(lines, places):
            """Records of lines without quote marks: Arrow cuts them."""
            n = len(lines)
            cells = pc.split_pattern(lines, sep).cast(pa.list_(pa.string()))
            columns = [pa.repeat(here[0], n), pa.repeat(pa.scalar(here[1], pa.int64()), n), pa.array(places, pa.int64())]
            columns += [pa.repeat("record", n), pa.nulls(n, pa.string()), cells]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def flush():
            nonlocal whole, cut
            cells = _parse([text for _, _, text in whole], sep)
            rows = [(*where, at, "record", None, c) for (where, at, _), c in zip(whole, cells)]
            rows += [(*where, at, kind, text, None) for where, at, kind, text in cut]
            whole, cut = [], []
            if rows:
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        def leave():
            """The range ends: what is open goes on in the next one."""
            if here is not None and held:
                cut.append((here, place, "middle" if headless else "tail", "\n".join(held)))

        for batch in batches:
            files, splits = batch.column("source_file"), batch.column("split")
            values = batch.column("value")
            marks = pc.count_substring(values, QUOTE).to_numpy(zero_copy_only=False)
            easy = (marks == 0) & ~np.asarray(pc.match_substring_regex(values, "^(\ufeff|$)|\r"))
            n = batch.num_rows
            code = files.dictionary_encode().indices.to_numpy(), splits.to_numpy()
            edges = np.flatnonzero((np.diff(code[0]) != 0) | (np.diff(code[1]) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), n]):
                if a == b:
                    continue
                where = (files[a].as_py(), splits[a].as_py())
                if where != here:
                    leave()
                    here, held, place = where, [], 0
                    inside = headless = bool(batch.column("inside")[a].as_py())
                odd = (np.cumsum(marks[a:b]) + inside) % 2 == 1
                if not (held or headless or odd.any()):  # every line is a record
                    places = np.arange(place, place + b - a)
                    lines, some = values.slice(a, b - a), easy[a:b]
                    yield plain(lines.filter(pa.array(some)), places[some])
                    for at, line in zip(places[~some].tolist(), lines.filter(pa.array(~some)).to_pylist()):
                        whole.append((here, at, line.removeprefix("\ufeff") if at == 0 and where[1] == 0 else line))
                    place += b - a
                    inside = False
                    continue
                for line, unclosed in zip(values.slice(a, b - a).to_pylist(), odd.tolist()):
                    if place == 0 and where[1] == 0 and not held:
                        line = line.removeprefix("﻿")
                    if unclosed:
                        held.append(line)
                    elif held or headless:
                        text = "\n".join([*held, line])
                        if headless:
                            cut.append((here, place, "head", text))
                            headless = False
                        else:
                            whole.append((here, place, text))
                            place += 1
                        held = []
                    else:
                        whole.append((here, place, line))
                        place += 1
                inside = bool(odd[-1])
            out = flush()
            if out is not None:
                yield out
        leave()
        out = flush()
        if out is not None:
            yield out

    return stitch


def land_records(spark: SparkSession, path: str, out: str, sep: str = ",") -> DataFrame:
    """Write the records of delimited text files to a parquet table at ``out``; return them (``load_records``).

    A quoted cell may hold separators, doubled quotes and line ends. A quote that is never closed, and a bare carriage
    return in an unquoted cell, fail the job. A first byte order mark is dropped. The text is read twice, the first
    time for a count only.
    """
    lines = _lines(spark, path)
    count = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    ranges = lines.groupBy("source_file", "split").agg((F.sum(count) % 2).alias("odd"))
    along = W.partitionBy("source_file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    # One row for each range that starts inside quotes: fewer than the ranges, of which a task reads one or more.
    opened = ranges.withColumn("inside", F.sum("odd").over(along) % 2 == 1).where("inside")
    opened = F.broadcast(opened.select("source_file", "split", "inside"))
    parts = lines.join(opened, ["source_file", "split"], "left").mapInArrow(_stitch(sep), _RECORD)
    parts.write.mode("overwrite").parquet(out)
    return load_records(spark, out, sep)


def load_records(spark: SparkSession, out: str, sep: str = ",") -> DataFrame:
    """(source_file, row_id, cells) of landed records, cells as text; ``row_id`` counts a file's records from 0.

    Empty lines are left out, but counted. What crosses the edge of a range is put together here: at most two pieces a
    range.
    """
    parts = spark.read.schema(_RECORD).parquet(out)
    starts = parts.where("kind <> 'head' and kind <> 'middle'").groupBy("source_file", "split").count()
    along = W.partitionBy("source_file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.withColumn("before", F.coalesce(F.sum("count").over(along), F.lit(0))).drop("count")

    cut = parts.where("kind <> 'record'").drop("cells")
    order = W.partitionBy("source_file").orderBy("split", F.col("kind") == "tail")
    cut = cut.withColumn("record", F.count_if(F.col("kind") == "tail").over(order))
    texts = F.sort_array(F.collect_list(F.struct("split", F.col("kind") == "tail", "text")))
    joined = cut.groupBy("source_file", "record").agg(
        F.min_by(F.struct("split", "place"), F.struct("split", F.col("kind") == "tail")).alias("first"),
        F.count_if(F.col("kind") == "head").alias("ends"),
        F.array_join(F.transform(texts, lambda t: t["text"]), "\n").alias("text"),
    )
    never = F.raise_error(F.lit("a quote is never closed")).cast("string")
    text = F.when(F.col("ends") == 1, F.col("text")).otherwise(never)
    joined = joined.select("source_file", "first.split", "first.place", text.alias("text"))

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            cells = pa.array(_parse(batch.column("text").to_pylist(), sep), pa.list_(pa.string()))
            columns = [batch.column(c) for c in ("source_file", "split", "place")]
            yield pa.RecordBatch.from_arrays([*columns, cells], names=["source_file", "split", "place", "cells"])

    joined = joined.mapInArrow(parse, "source_file string, split long, place long, cells array<string>")
    records = parts.where("kind = 'record'").select("source_file", "split", "place", "cells")
    # A row a range, whatever the range holds: the records stay where they are.
    records = records.unionByName(joined).where(F.size("cells") > 0).join(F.broadcast(starts), ["source_file", "split"])
    return records.select("source_file", (F.col("before") + F.col("place")).alias("row_id"), "cells")
