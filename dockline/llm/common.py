"""Helpers shared by the operators: text batches, word hashes, stored tables, components.

A word is a maximal run of bytes other than space and 0x09-0x0D. Word hashes are
64-bit and computed for a whole slice of texts at once; a slice is a few MB of
text, or one longer text, so the memory of a task does not follow its row count.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockline.plans.ranking import passing_shuffles, settled, use_checkpoint_dir

__all__ = ["settled", "stored", "keyed", "slices", "Words", "windows", "mix64", "components"]

SLICE_BYTES = 4 << 20
BATCH_BYTES = 16 << 20
BLOCK = 1 << 20
LOWEST = -(1 << 63)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of a 64-bit array (finaliser with two multiplications)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for base in (_BASE, inverse):
            table = np.full(BLOCK + 1, base, np.uint64)
            table[0] = 1
            _powers.append(np.cumprod(table))
    return _powers


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end), which are sorted and disjoint."""
    power, inverse = _power_tables()
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = int(np.searchsorted(ends, base + BLOCK, side="right"))
        if to <= at:  # one range longer than a block
            digest = hashlib.blake2b(data[base : ends[at]].tobytes(), digest_size=8).digest()
            out[at] = int.from_bytes(digest, "little")
            at += 1
            continue
        part = data[base : ends[to - 1]].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        at = to
    return mix64(out)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of texts; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, values = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1)
        yield row, to, data[offs[row] : offs[to]], offs[row : to + 1] - offs[row]
        row = to


class Words:
    """Words of a slice: byte ranges, hashes, and the first word of each text in `first`."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False):
        self.data = FOLD[data] if fold else data
        inside = ~SPACE[data]
        opens, closes = inside.copy(), inside.copy()
        if len(data):
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            inner = offsets[1:-1]
            inner = inner[(inner > 0) & (inner < len(data))]
            opens[inner] = inside[inner]
            closes[inner - 1] = inside[inner - 1]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = hash_spans(self.data, self.starts, self.ends)

    def of(self, row: int) -> np.ndarray:
        return self.hashes[self.first[row] : self.first[row + 1]]


_window_factors = mix64(np.arange(1, 65, dtype=np.uint64) * _BASE) | np.uint64(1)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive words."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for j in range(size):
        out += hashes[j : j + count] * _window_factors[j]
    return mix64(out)


def batch_texts(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Bound an Arrow batch by bytes, since texts differ in length by orders of magnitude."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def keyed(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, text, _id, _th): the sort key of a document and the hash of its text.

    A null id sorts first. Rows equal in id and text are one document to the
    operators; rows equal in id only are ordered by the text's hash.
    """
    batch_texts(docs.sparkSession)
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(LOWEST)).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_th"),
    )


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder, which driver and executors share."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The frame written as Parquet to the shared checkpoint folder and read again."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    with passing_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of undirected `edges` (a, b); root is the smallest node reachable.

    Each round a node takes the smallest root among its neighbours, then roots
    are followed one step; the round count grows with the logarithm of the
    longest chain in practice. Every round is checkpointed.
    """
    both = settled(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = settled(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
        "node", F.least("node", "low").alias("root")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b")
        near = seen.groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        # the root of a node also learns of the smaller root that its member has seen
        told = labels.join(near, "node").select(
            "node", "root", F.least("root", "near").alias("best")
        )
        hooks = told.groupBy(F.col("root").alias("node")).agg(F.min("best").alias("hook"))
        hooked = (
            told.join(hooks, "node", "left")
            .select("node", "root", F.least("best", F.coalesce("hook", "best")).alias("next"))
        )
        jumped = hooked.join(
            hooked.select(F.col("node").alias("next"), F.col("next").alias("far")), "next", "left"
        ).select("node", "root", F.least("next", F.coalesce("far", "next")).alias("next"))
        jumped = settled(jumped)
        changed = jumped.filter(F.col("next") != F.col("root")).limit(1).count()
        labels = jumped.select("node", F.col("next").alias("root"))
        if not changed:
            return labels


def hex_sha256(column: Column) -> Column:
    return F.sha2(column, 256)


class Tokens:
    """Exact word numbers of a slice: words are the runs of bytes that `separator` does not mark.

    `ids` numbers equal words alike within the slice, `names` has the word of each
    number, `starts` the first byte of each word and `first` the first word of each text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
        inside = ~separator[data]
        opens, closes = inside.copy(), inside.copy()
        if len(data):
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            inner = offsets[1:-1]
            inner = inner[(inner > 0) & (inner < len(data))]
            opens[inner] = inside[inner]
            closes[inner - 1] = inside[inner - 1]
        self.starts = np.flatnonzero(opens)
        ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        bounds = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(ends - self.starts, out=bounds[1:])
        words = pa.Array.from_buffers(
            pa.large_binary(), len(self.starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])]
        ).dictionary_encode()
        self.ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.names = words.dictionary


def renamed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense numbers of the pairs (first, second) that occur twice or more, -1 for the others."""
    out = np.full(len(first), -1, np.int64)
    if len(first):
        _, number, count = np.unique(first * (second.max() + 1) + second, return_inverse=True, return_counts=True)
        again = count > 1
        out = np.where(again, np.cumsum(again) - 1, -1)[number]
    return out
