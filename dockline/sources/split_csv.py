"""CSV records of large files, read by many tasks although quoted values hold line breaks.

Spark splits a text file at line ends, but a line end inside quotes ends no record, and
whether a split starts inside quotes depends on all splits before it. So:

1. one scan reduces every split to a small function: for a split entered outside and
   inside quotes, the state at its end and whether a record ended in it. Lines without
   a quote change nothing and reach the scan as nulls;
2. the functions are chained over the splits of each file, a row a split as the driver
   holds them anyway. Each split then knows its state at its start;
3. a second scan cuts the lines into records. What a split holds of a record that began
   in an earlier one, or goes on in a later one, is a fragment; the fragments of a record
   are joined by a shuffle of those few rows;
4. the records are parsed by Spark's own CSV functions.

A quote opens a value only at its start, as in Spark's reader, so a stray quote inside an
unquoted value moves no border.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTSIDE, INSIDE = 0, 1
# a doubled quote does not close a value
REST_OF_QUOTED = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
QUOTED = re.compile('"' + REST_OF_QUOTED.pattern)


def exit_state(line: str, state: int, separator: str = ",") -> int:
    """Whether the end of a physical line lies inside quotes, given the state at its start."""
    at = 0
    if state == INSIDE:
        closed = REST_OF_QUOTED.match(line)
        if closed is None:
            return INSIDE
        at = line.find(separator, closed.end()) + 1
        if at == 0:
            return OUTSIDE
    while True:
        if line.startswith('"', at):
            closed = QUOTED.match(line, at)
            if closed is None:
                return INSIDE
            at = closed.end()
        at = line.find(separator, at) + 1
        if at == 0:
            return OUTSIDE


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, line): physical lines in file order within a split that starts at byte `at`."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("line"))


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, list[str | None]]]:
    """((file, at), first row, lines) of the runs of rows of one split in a batch."""
    files, starts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    cuts = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
    lines = batch.column(2).to_pylist()
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lines)], strict=True):
        if a < b:
            yield (int(files[a]), int(starts[a])), a, lines[a:b]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _split_functions(lines: DataFrame, separator: str) -> DataFrame:
    """(file, at, returns, some, out_end, out_closed, in_end, in_closed) of every split that starts a line.

    `returns` tells whether the first line ends with a carriage return, `some` whether a
    line is not empty, `*_closed` whether a record ends in the split.
    """
    names = ["file", "at", "returns", "some", "out_end", "out_closed", "in_end", "in_closed"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.bool_(), pa.int32(), pa.bool_()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for key, place, part in _stretches(batch):
                row = held.setdefault(key, [batch.column(3)[place].as_py(), False, OUTSIDE, False, INSIDE, False])
                row[1] = row[1] or any(line != "" for line in part)
                for k in (2, 4):
                    state, closed = row[k], row[k + 1]
                    for line in part:
                        if line:
                            state = exit_state(line, state, separator)
                        closed = closed or state == OUTSIDE
                    row[k], row[k + 1] = state, closed
        yield _batch([(*key, *row) for key, row in held.items()], names, kinds)

    bare = F.rtrim(F.col("line"), F.lit("\r")) == ""
    quoted = F.when(F.col("line").contains('"'), F.col("line")).when(bare, "")  # null: a line without quotes
    return lines.select("file", "at", quoted.alias("line"), F.endswith("line", F.lit("\r")).alias("returns")).mapInArrow(
        work, "file long, at long, returns boolean, some boolean, out_end int, out_closed boolean, in_end int, in_closed boolean")


class Start(NamedTuple):
    """What a split must know of those before it in its file."""

    began: int  # split whose last record is still open at the start, -1 if none
    head: bool  # whether the file's first record begins in it
    returns: bool  # whether the file's lines end with a carriage return


def _starts(splits: list) -> dict[tuple[int, int], Start]:
    """Start by (file, at)."""
    found, last, headed, returns = {}, {}, set(), {}
    for row in sorted(splits):
        file, at = row["file"], row["at"]
        began = last.get(file, -1)
        found[file, at] = Start(began, row["some"] and file not in headed, returns.setdefault(file, row["returns"]))
        if row["some"]:
            headed.add(file)
        end, closed = (row["out_end"], row["out_closed"]) if began < 0 else (row["in_end"], row["in_closed"])
        last[file] = -1 if end == OUTSIDE else at if began < 0 or closed else began
    return found


def _records(lines: DataFrame, starts: dict[tuple[int, int], Start], separator: str) -> DataFrame:
    """(file, began, at, first, text): records without `began`, and fragments of those that cross a split.

    `began` is the split in which the record of a fragment began, `first` marks the first
    record of a file (of its fragments, the one in the split where it began).
    """
    shared = lines.sparkSession.sparkContext.broadcast({key: tuple(start) for key, start in starts.items()})
    names = ["file", "began", "at", "first", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, carried, first, returns = None, OUTSIDE, -1, False, False
        pending: list[str] = []  # lines of the record that is open
        out: list[tuple] = []

        def give(began: int | None) -> None:
            text = "\n".join(pending)
            # as Spark's reader does, where lines end with both characters
            text = text.replace("\r\n", "\n").removesuffix("\r") if returns else text
            out.append((key[0], began, key[1], first and carried < 0, text))

        for batch in batches:
            for place, _, part in _stretches(batch):
                if place != key:
                    if pending:
                        give(carried if carried >= 0 else key[1])
                    key, pending = place, []
                    carried, first, returns = shared.value[key]
                    state = OUTSIDE if carried < 0 else INSIDE
                for line in part:
                    if '"' in line:
                        state = exit_state(line, state, separator)
                    pending.append(line)
                    if state == INSIDE:
                        continue
                    if carried >= 0:
                        give(carried)
                        carried = -1
                    elif len(pending) > 1 or line not in ("", "\r" if returns else ""):
                        give(None)
                        first = False
                    pending.clear()
            yield _batch(out, names, kinds)
            out.clear()
        if pending:
            give(carried if carried >= 0 else key[1])
            yield _batch(out, names, kinds)

    return lines.mapInArrow(work, "file long, began long, at long, first boolean, text string")


def records(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(record): the text of every CSV record but the first of each file, line breaks in quotes kept.

    Records end at a line feed, or at a carriage return and a line feed if the first line
    does; in the latter case a line break inside quotes becomes a line feed, as Spark's own
    reader has it. Empty lines are no records. A quote that is never closed makes one record of the rest of the file.
    """
    lines = _lines(spark, path)
    starts = _starts(_split_functions(lines, separator).collect())  # a row a split
    cut = _records(lines, starts, separator)
    whole = cut.filter("began IS NULL AND NOT first").select("text")
    joined = (
        cut.filter("began IS NOT NULL")
        .groupBy("file", "began")
        .agg(F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))  # one record
        .filter("NOT first")
        .select(F.array_join(F.col("parts.text"), "\n").alias("text"))
    )
    return whole.unionByName(joined).withColumnRenamed("text", "record")


def read_records(spark: SparkSession, path: str, names: list[str], options: dict[str, str]) -> DataFrame:
    """The CSV file(s) at `path` with text columns `names` in the order of the header."""
    schema = ", ".join(f"c{k} string" for k in range(len(names)))
    parsed = records(spark, path, options.get("sep", ",")).select(F.from_csv("record", schema, options).alias("r"))
    return parsed.select(*[F.col(f"r.c{k}").alias(name) for k, name in enumerate(names)])
