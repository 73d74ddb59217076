"""Row numbers and running totals over a global (or per-key) order.

An ordered window without a partition puts the whole frame on one task. Here the
frame is range-partitioned on (keys, order), each chunk is counted, and the
chunk's starting offset is added to a numbering done inside the chunk. Range
boundaries are sampled, so the partitioned frame is checkpointed before it is
read twice: every later step sees the same chunk numbers, also after a lost
executor. Chunks are sorted before they are checkpointed and carry the place of each
row, so row numbers move no row a second time; running sums do.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockline.functions.columns import match_rows

SMALL_ROWS = 20_000
# rows in a packed batch, and the types that pass through one unchanged
PACKED_ROWS = 50_000
PLAIN = (T.IntegralType, T.DoubleType, T.FloatType, T.BooleanType, T.StringType, T.DateType)


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder the cluster names.

    A private temporary folder is used only by a local session that names none.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="dockline-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Plans made meanwhile drop their shuffle files as soon as their action ends.

    Else the files stay until the driver happens to collect its garbage, and those of all the
    steps of a long operator lie on disk together.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settled(df: DataFrame) -> DataFrame:
    """Checkpointed copy: computed once, safe to read many times."""
    use_checkpoint_dir(df.sparkSession)
    with passing_shuffles(df.sparkSession):
        return df.select("*").checkpoint()  # a plan of its own, since that of `df` is made already


def packed(df: DataFrame) -> DataFrame:
    """`settled`, with the rows kept as compressed column batches, so on less disk.

    Partitions and the order of their rows are those of `df`, which files read back do not keep.
    Columns of other than plain types are settled as they are.
    """
    if not all(isinstance(field.dataType, PLAIN) for field in df.schema):
        return settled(df)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packet(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["packet"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= PACKED_ROWS:
                yield packet(held)
                held, rows = [], 0
        if held:
            yield packet(held)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packet in batch.column(0):
                yield from pa.ipc.open_stream(packet.as_buffer()).read_all().to_batches()

    return settled(df.mapInArrow(pack, "packet binary")).mapInArrow(unpack, df.schema)


def stored_copy(df: DataFrame) -> DataFrame:
    """Copy in compressed Parquet under the checkpoint folder: computed once, later passes read the columns they use."""
    spark = df.sparkSession
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/copy-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def small_or_stored(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """A join side for a table whose key may be hot: broadcast if counted small.

    Up to ``limit`` rows are fetched and sent to every task, so the other side is
    not shuffled on a key with few levels; a longer frame is stored and joined
    by shuffle.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) <= limit:
        return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
    return settled(df)


def running(
    df: DataFrame,
    order: list[Column],
    *,
    keys: list[str] | None = None,
    row_number: str | None = None,
    sums: dict[str, str] | None = None,
    chunks: int | None = None,
    by: Column | None = None,
    store: Callable[[DataFrame], DataFrame] = settled,
) -> DataFrame:
    """Add a 1-based row number and/or inclusive running sums.

    ``sums`` maps a new column to the numeric column it accumulates. ``order``
    should be total within a key, else ties are placed arbitrarily. ``by`` is a computed value that
    precedes ``order``, ascending; it is neither moved nor stored with the rows. ``store`` keeps
    the sorted chunks.
    """
    keys = keys or []
    sums = sums or {}
    spark = df.sparkSession
    count = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = [] if by is None else [by.asc()]
    ranged = df.repartitionByRange(count, *[F.col(k) for k in keys], *first, *order)
    if by is None:
        ranged = ranged.sortWithinPartitions(*[F.col(k) for k in keys], *order)
    else:  # a value to sort by, not computed again in each comparison
        ranged = ranged.withColumn("_by", by).sortWithinPartitions(*[F.col(k) for k in keys], "_by", *order).drop("_by")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # in its partition
    ranged = store(ranged.withColumn("_chunk", F.spark_partition_id()).withColumn("_place", place))

    measures = [F.count("*").alias("_rows"), F.min("_place").alias("_first")]
    measures += [F.sum(source).alias(f"_sum_{i}") for i, source in enumerate(sums.values())]
    totals = ranged.groupBy(*keys, "_chunk").agg(*measures)
    # at most one row per chunk and key touching it
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    names = ["_rows", *[f"_sum_{i}" for i in range(len(sums))]]
    offsets = totals.select(
        *keys,
        "_chunk",
        "_first",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in names],
    )
    # one row per chunk without keys; with keys at most one more per key
    offsets = small_or_stored(offsets) if keys else F.broadcast(offsets)
    joined = match_rows(ranged, offsets, [*keys, "_chunk"], "inner")
    local = W.partitionBy(*keys, "_chunk").orderBy(*first, *order)
    upto = local.rowsBetween(W.unboundedPreceding, 0)
    added = []
    if row_number is not None:
        number = F.col("_place") - F.col("_first") + F.col("_rows_before") + 1
        added.append(number.cast("long").alias(row_number))
    for i, (name, source) in enumerate(sums.items()):
        added.append((F.sum(source).over(upto) + F.col(f"_sum_{i}_before")).alias(name))
    return joined.select(*df.columns, *added)
