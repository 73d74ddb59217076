"""Distinct values of many columns with their counts, in one scan and one shuffle.

Exploding every row into a cell per column moves rows times columns through Spark. Here a
task counts the values of each column batch by batch in Arrow and passes on the distinct
ones; the counts of a value are then added up across tasks. Columns keep their own types
until their values are distinct, and only then become text. What a task holds is bounded:
once its tables exceed `HELD_VALUES` values they are passed on and begun anew, so a column
of nearly unique values streams through. A summary of the levels needs no row for a value:
tasks pass on tables of values, parted by a hash of the value, and the parts are merged as tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_VALUES = 400_000
# a part's bytes of text differ by odd factors that depend on their place
FACTORS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))


def _values(column: pa.Array) -> pa.Array:
    """Values that Arrow can count exactly; floating-point numbers as their bits, NaN as null."""
    if pa.types.is_floating(column.type):
        column = column.cast(pa.float64())
        known = pc.if_else(pc.is_nan(column), None, pc.add(column, 0.0))  # -0.0 is 0.0
        return pa.Array.from_buffers(pa.int64(), len(known), known.buffers(), offset=known.offset)
    return column


def _merged(values: list[pa.Array], counts: list[pa.Array]) -> pa.Table:
    """(value, n_sum): each distinct value once."""
    table = pa.table({"value": pa.chunked_array(values), "n": pa.chunked_array(counts)})
    return table.group_by("value", use_threads=False).aggregate([("n", "sum")])


def _parts(values: pa.Array, parts: int) -> np.ndarray:
    """A part for each value, that depends on the value only."""
    if pa.types.is_integer(values.type) or pa.types.is_boolean(values.type):
        hashed = values.cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64)
    else:
        text = values.cast(pa.large_binary())
        _, offsets, data = text.buffers()
        ends = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
        bytes_ = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.array([], np.uint8)
        starts = ends - ends[0]
        place = np.arange(len(bytes_)) - np.repeat(starts[:-1], np.diff(starts))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((bytes_.astype(np.uint64) + np.uint64(1)) * FACTORS[place % len(FACTORS)])])
        hashed = sums[starts[1:]] - sums[starts[:-1]]
    hashed = (hashed ^ (hashed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((hashed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _packet(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def level_summary(df: DataFrame, columns: dict[str, Column], parts: int | None = None) -> DataFrame:
    """(place, unique, top, freq): distinct present values of each column that has some, the most
    frequent one as text, of equally frequent ones the smallest text, and its rows.

    Values are taken as in `level_counts`. A value's rows meet in one of `parts` parts of its
    column, by default as many as there are shuffle partitions; a task holds one part at a time.
    """
    width = len(columns)
    dealt = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = df.select(*[value.alias(f"c{i}") for i, value in enumerate(columns.values())])

    def passed(held: list[list[pa.StructArray]]) -> Iterator[pa.RecordBatch]:
        for place, found in enumerate(held):
            if not found:
                continue
            table = _merged([p.field("values") for p in found], [p.field("counts") for p in found]).combine_chunks()
            if not len(table):
                continue
            part = _parts(table.column("value").chunk(0), dealt)
            order = np.argsort(part, kind="stable")
            table, part = table.take(pa.array(order)).combine_chunks(), part[order]
            ends = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            packets = [_packet(table.slice(a, b - a)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(packets), place), pa.int32()), pa.array(part[ends[:-1]], pa.int32()), pa.array(packets, pa.binary())],
                names=["place", "part", "packet"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[pa.StructArray]] = [[] for _ in range(width)]
        size = 0
        for batch in batches:
            for place, column in enumerate(batch.columns):
                counts = pc.value_counts(_values(column).drop_null())
                size += len(counts)
                held[place].append(counts)
            if size > HELD_VALUES:
                yield from passed(held)
                held, size = [[] for _ in range(width)], 0
        yield from passed(held)

    def summed(group: pa.Table) -> pa.Table:
        tables = [pa.ipc.open_stream(packet.as_buffer()).read_all() for packet in group.column("packet")]
        whole = pa.concat_tables(tables)
        found = _merged(whole.column("value").chunks, whole.column("n_sum").chunks)
        most = pc.max(found.column("n_sum"))
        best = found.filter(pc.equal(found.column("n_sum"), most)).column("value").cast(pa.string())
        return pa.table({
            "place": group.column("place").slice(0, 1), "unique": pa.array([len(found)], pa.int64()),
            "top": pa.array([pc.min(best).as_py()], pa.string()), "freq": pa.array([most.as_py()], pa.int64())})

    dealt_out = named.mapInArrow(work, "place int, part int, packet binary")
    found = dealt_out.groupBy("place", "part").applyInArrow(summed, "place int, unique long, top string, freq long")
    # a row a part
    best = F.min(F.struct((-F.col("freq")).alias("less"), F.col("top").alias("top")))
    return found.groupBy("place").agg(F.sum("unique").alias("unique"), best.alias("best")).select(
        "place", "unique", F.col("best.top").alias("top"), (-F.col("best.less")).alias("freq"))


def level_counts(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(place, value, n): each distinct present value of each column as text, with its rows.

    `place` is the column's place in `columns`. Integers, booleans and text keep their
    usual text; floating-point numbers are given by their bits, which serves to count
    and to compare them. Pass other types as text.
    """
    width = len(columns)
    named = df.select(*[value.alias(f"c{i}") for i, value in enumerate(columns.values())])

    def passed(held: list[list[pa.StructArray]]) -> Iterator[pa.RecordBatch]:
        for place, parts in enumerate(held):
            if parts:
                table = _merged([p.field("values") for p in parts], [p.field("counts") for p in parts])
                value = table.column("value").combine_chunks()
                whole = pa.types.is_integer(value.type)
                numbers = value.cast(pa.int64()) if whole else pa.nulls(len(value), pa.int64())
                texts = pa.nulls(len(value), pa.string()) if whole else value.cast(pa.string())
                places = pa.array([place] * len(value), pa.int32())
                yield from pa.table({"place": places, "number": numbers, "text": texts, "n": table.column("n_sum")}).to_batches()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[pa.StructArray]] = [[] for _ in range(width)]
        size = 0
        for batch in batches:
            for place, column in enumerate(batch.columns):
                counts = pc.value_counts(_values(column).drop_null())
                size += len(counts)
                held[place].append(counts)
            if size > HELD_VALUES:
                yield from passed(held)
                held, size = [[] for _ in range(width)], 0
        yield from passed(held)

    counts = named.mapInArrow(work, "place int, number long, text string, n long")
    return counts.groupBy("place", "number", "text").agg(F.sum("n").alias("n")).select(
        "place", F.coalesce("text", F.col("number").cast("string")).alias("value"), "n")
