"""A CSV scan that splits files although quoted fields hold line breaks.

Lines are read by Spark's text source, whose splits are byte ranges. A line break lies inside a field exactly if the
number of quotes before it in the file is odd (a doubled quote counts twice). So a first pass counts the quotes of every
split, their running parity over the splits of a file says in which state each split begins, and a second pass puts
the lines of a split together to records. A record that crosses splits comes out in fragments, at most two for each
split, which are joined at the end. No text is shuffled except these fragments.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_QUOTE = '"'
_PARTS = "file string, start long, tail boolean, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start): the lines of each split in their order. Only line feeds end a line."""
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _states(lines: DataFrame) -> DataFrame:
    """(file, start, open): whether a split begins inside a field; one row per split."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(_QUOTE), F.lit("")))
    counted = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    return counted.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("open"))


def _records(lines: DataFrame, names: list[str], whole: bool) -> DataFrame:
    """(file, start, tail, record): the whole records of all splits, or the fragments at their edges."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, inside, edge, first, held = None, False, False, False, []
        found: list[tuple] = []

        def finish() -> None:
            # What is open at the end of a split goes on in the next one.
            if held and not whole:
                found.append((*split, not edge, "\n".join(held)))

        for part in parts:
            columns = (part.column(i).to_pylist() for i in range(4))
            for line, file, start, opened in zip(*columns, strict=True):
                if split != (file, start):
                    finish()
                    if opened is None:
                        raise ValueError(f"{file}: the splits changed between two reads")
                    split, inside, edge, first, held = (file, start), opened, opened, start == 0, []
                held.append(line)
                if line.count(_QUOTE) % 2:
                    inside = not inside
                if inside:
                    continue
                record, held = "\n".join(held).removesuffix("\r"), []
                if edge:
                    if not whole:
                        found.append((file, start, False, record))
                elif first:
                    _same_header(record, names, file)
                elif whole and record.strip():
                    found.append((file, start, False, record))
                edge = first = False
            yield _batch(found)
            found = []
        finish()
        yield _batch(found)

    return lines.mapInArrow(run, _PARTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    types = [pa.string(), pa.int64(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "start", "tail", "record"])


def _same_header(record: str, names: list[str], file: str) -> None:
    found = next(csv.reader([record]), [])
    if [n.strip() for n in found] != names:
        raise ValueError(f"{file}: its header names other columns than the first file's")


def _joined(fragments: DataFrame) -> DataFrame:
    """Fragments put together: one that opens a record, then those that go on with it, in order of their splits."""
    order = [F.col("start"), F.col("tail")]
    opened = F.sum(F.col("tail").cast("int")).over(W.partitionBy("file").orderBy(*order))
    parts = fragments.withColumn("number", opened).groupBy("file", "number")
    pieces = F.sort_array(F.collect_list(F.struct("start", "tail", "record")))
    # A file may end inside a field; a file that does not has no text there.
    return parts.agg(F.array_join(pieces["record"], "\n").alias("record")).select("record")


def read_quoted(spark: SparkSession, path: str, names: list[str], schema: T.StructType, options: dict) -> DataFrame:
    """Rows of all files below ``path`` whose header is ``names``; ``schema`` has the same fields in that order.

    Quotes must be doubled inside quoted fields and stand nowhere else. ``options`` are those of Spark's CSV reader.
    Blank records are left out. A carriage return before the line feed that ends a record is no part of it.
    """
    lines = _lines(spark, path)
    # One row per split of the scan.
    known = lines.join(F.broadcast(_states(lines)), ["file", "start"], "left").select("value", "file", "start", "open")
    records = _records(known, names, whole=True).select("record").union(_joined(_records(known, names, whole=False)))
    shown = {name: str(value).lower() if isinstance(value, bool) else value for name, value in options.items() if name != "header"}
    # The names of the type do not matter to the parser, so any header is safe to spell as DDL.
    parsed = records.select(F.from_csv("record", ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(schema)), shown).alias("row"))
    return parsed.select(*[F.col(f"row.c{i}").alias(f.name) for i, f in enumerate(schema)])
