"""Moments and exact quartiles of many numeric columns, without exploding a cell.

A table of k numeric columns is read as Arrow batches, and each task reduces all columns at
once to a few numbers a column; Spark merges those. Wide generated aggregates would do the
same in code too long for the JVM to compile, and a row per cell moves k times the rows.

Quartiles take two scans. The first also keeps every `STEP`-th value of sorted chunks, from
which a stretch around each wanted rank follows. The second counts the values before the
stretch and lists the distinct ones in it, if few can be or a task meets few; else it counts
them in equal cells and the cell with the rank is the next stretch, unless all its values are listed. Stretches are made of the doubles' own order
as whole numbers, so a handful of rounds suffices whatever the values. The thinned values
decide where to look, the counts decide the answer.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockline.plans.ranking import settled

STEP = 64
CHUNK_ROWS = 100_000
LISTED_VALUES = 4_000
# distinct values of a stretch that a task lists whatever their rows: a column of whole numbers has no more
TIED_VALUES = 64
ACCURACY = 10_000
CELLS = 1024
LAST_KEY = (1 << 64) - 1


def _numbers(column: pa.Array) -> np.ndarray:
    """Present values of a column of doubles; NaN counts as absent."""
    values = column.drop_null().to_numpy(zero_copy_only=False)
    return values[~np.isnan(values)]


class _Chunks:
    """Values of the columns of a task, handed on in chunks of about `CHUNK_ROWS` rows."""

    def __init__(self, batches: Iterator[pa.RecordBatch], width: int):
        self.batches, self.width = batches, width

    def __iter__(self) -> Iterator[list[np.ndarray]]:
        held: list[list[np.ndarray]] = [[] for _ in range(self.width)]
        rows = 0
        for batch in self.batches:
            rows += batch.num_rows
            for place in range(self.width):
                held[place].append(_numbers(batch.column(place)))
            if rows >= CHUNK_ROWS:
                yield [np.concatenate(h) for h in held]
                held, rows = [[] for _ in range(self.width)], 0
        if rows:
            yield [np.concatenate(h) for h in held]


def _doubles(df: DataFrame, values: list[Column]) -> DataFrame:
    return df.select(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values)])


def column_moments(df: DataFrame, values: list[Column]) -> DataFrame:
    """(place, n, mean, m2, m3, m4, low, high, zeros, negatives, thinned): a row per chunk and column with values.

    `m2` to `m4` are sums of powers of the distance to the chunk's mean.
    """
    names = ["place", "n", "mean", "m2", "m3", "m4", "low", "high", "zeros", "negatives", "thinned"]
    kinds = [pa.int32(), pa.int64(), *[pa.float64()] * 6, pa.int64(), pa.int64(), pa.list_(pa.float64())]
    width = len(values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _Chunks(batches, width):
            rows = []
            for place, v in enumerate(chunk):
                if not len(v):
                    continue
                with np.errstate(invalid="ignore", over="ignore"):
                    mean = float(v.mean())
                    d = v - mean
                    square = d * d
                    powers = [float(x.sum()) for x in (square, square * d, square * square)]
                v = np.sort(v)
                rows.append((place, len(v), mean, *powers, float(v[0]), float(v[-1]), int((v == 0).sum()), int((v < 0).sum()),
                             v[STEP // 2 :: STEP].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    fields = ", ".join(f"{n} double" for n in names[2:8])
    return _doubles(df, values).mapInArrow(work, f"place int, n long, {fields}, zeros long, negatives long, thinned array<double>")


def merged_moments(parts: DataFrame) -> DataFrame:
    """(place, n, mean, m2, m3, m4, low, high, zeros, negatives) of each column over all chunks."""
    means = parts.groupBy("place").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    d, n = F.col("mean") - F.col("_mean"), F.col("n")
    return parts.drop("thinned").join(F.broadcast(means), "place").groupBy("place").agg(  # one row per column
        F.sum("n").alias("n"), F.max("_mean").alias("mean"),
        F.sum(F.col("m2") + n * d * d).alias("m2"),
        F.sum(F.col("m3") + 3 * d * F.col("m2") + n * d * d * d).alias("m3"),
        F.sum(F.col("m4") + 4 * d * F.col("m3") + 6 * d * d * F.col("m2") + n * d * d * d * d).alias("m4"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("zeros").alias("zeros"), F.sum("negatives").alias("negatives"))


def _ordered(values: np.ndarray) -> np.ndarray:
    """Unsigned whole numbers in the order of the doubles; both zeros are one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _double(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return struct.unpack("<d", struct.pack("<Q", bits))[0]


def _key(value: float) -> int:
    return int(_ordered(np.array([value]))[0])


class _Search(NamedTuple):
    """A wanted rank (from 0) of a column among the values of the keys `low` to `high`."""

    place: int
    rank: int
    low: int
    high: int
    listed: bool  # whether few enough values can lie there to be listed

    @property
    def width(self) -> int:
        """Keys in one of the `CELLS` equal cells of the stretch."""
        return -(-(self.high - self.low + 1) // CELLS)


def _starts(thinned: DataFrame, rows: dict[int, int], ranks: dict[int, list[int]], listed: int) -> list[_Search]:
    """Stretches that should hold the wanted ranks, from the thinned values of all chunks."""
    chunks = thinned.groupBy("place").agg(F.count("*").alias("chunks"))
    chunks = {row["place"]: row["chunks"] for row in chunks.collect()}  # one row per column
    def sides(place: int, rank: int) -> tuple[float, float]:
        # share of the rows by which thinned ranks can be off
        off = STEP * chunks[place] / rows[place] + 2 / ACCURACY
        return max(rank / rows[place] - off, 0.0), min(rank / rows[place] + off, 1.0)

    long_ = {place: held for place, held in ranks.items() if rows[place] > listed}
    wanted = sorted({side for place, held in long_.items() for rank in held for side in sides(place, rank)})
    ends = {}
    if wanted:
        found = thinned.select("place", F.explode("thinned").alias("v")).groupBy("place").agg(
            F.percentile_approx("v", wanted, ACCURACY).alias("ends"))
        ends = {row["place"]: dict(zip(wanted, row["ends"], strict=True)) for row in found.collect()}  # one row per column
    searches = []
    for place, held in ranks.items():
        for rank in held:
            if place not in long_ or place not in ends:
                searches.append(_Search(place, rank, 0, LAST_KEY, rows[place] <= listed))
                continue
            low, high = sides(place, rank)
            few = 2 * (high - low) * rows[place] <= listed
            searches.append(_Search(place, rank, _key(ends[place][low]), _key(ends[place][high]), few))
    return searches


def _counted(df: DataFrame, values: list[Column], searches: list[_Search]) -> DataFrame:
    """(number, cell, key, n): for each search the values before its stretch (cell -1), and those in it,
    by key if they are listed, else by cell. A task with at most `TIED_VALUES` distinct ones gives the
    keys with their cells; a cell counted without its keys has the key 0, which is no number's."""
    plain = [(*search, search.width) for search in searches]
    width = len(values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = np.zeros(len(plain), np.int64)
        cells = {k: np.zeros(CELLS, np.int64) for k, search in enumerate(plain) if not search[4]}
        tied = {k: (np.array([], np.uint64), np.array([], np.int64)) for k in cells}  # until they are too many
        out: list[list[np.ndarray]] = [[], [], [], []]

        def give(number: int, cell: np.ndarray, key: np.ndarray, n: np.ndarray) -> None:
            for part, column in zip(out, (np.full(len(n), number), cell, key, n), strict=True):
                part.append(column)

        def cell_of(keys: np.ndarray, low: int, size: int) -> np.ndarray:
            return ((keys - np.uint64(low)) // np.uint64(size)).astype(np.int64)

        for chunk in _Chunks(batches, width):
            chunk = [np.sort(_ordered(v)) for v in chunk]
            for k, (place, _, low, high, listed, size) in enumerate(plain):
                keys = chunk[place]
                first = int(np.searchsorted(keys, np.uint64(low), "left"))
                inside = keys[first : int(np.searchsorted(keys, np.uint64(high), "right"))]
                before[k] += first
                if listed:
                    inside, n = np.unique(inside, return_counts=True)
                    give(k, np.zeros(len(n), np.int64), inside.view(np.int64), n)
                    continue
                n = np.ones(len(inside), np.int64)
                if k in tied:
                    both, at = np.unique(np.concatenate([tied[k][0], inside]), return_inverse=True)
                    n = np.zeros(len(both), np.int64)
                    np.add.at(n, at, np.concatenate([tied[k][1], np.ones(len(inside), np.int64)]))
                    inside = both
                    if len(both) <= TIED_VALUES:
                        tied[k] = both, n
                        continue
                    del tied[k]
                np.add.at(cells[k], cell_of(inside, low, size), n)
        for k in range(len(plain)):
            give(k, np.array([-1]), np.array([0]), before[k : k + 1])
        for k, (keys, n) in tied.items():
            give(k, cell_of(keys, plain[k][2], plain[k][5]), keys.view(np.int64), n)
        for k, n in cells.items():
            held = np.flatnonzero(n)
            give(k, held, np.zeros(len(held), np.int64), n[held])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part), pa.int64()) for part in out], names=["number", "cell", "key", "n"])

    parts = _doubles(df, values).mapInArrow(work, "number long, cell long, key long, n long")
    return parts.groupBy("number", "cell", "key").agg(F.sum("n").alias("n"))


def values_at_ranks(
    df: DataFrame,
    values: list[Column],
    rows: dict[int, int],
    thinned: DataFrame,
    ranks: dict[int, list[int]],
    listed: int = LISTED_VALUES,
) -> dict[tuple[int, int], float]:
    """The value at each wanted rank (from 0, ascending) of each column, by (place, rank).

    `rows` has the number of present values of each column that has some, `thinned` the
    rows of `column_moments`.
    """
    found: dict[tuple[int, int], float] = {}
    open_ = _starts(thinned, rows, ranks, listed)
    while open_:
        held: dict[int, dict[str, list[tuple[int, int, int]]]] = {k: {} for k in range(len(open_))}
        # a few numbers a search: one before it, its cells, and at most the listed values or the tied ones of each task
        for r in _counted(df, values, open_).collect():
            kind = "before" if r["cell"] < 0 else "in"
            held[r["number"]].setdefault(kind, []).append((r["cell"], r["key"] % (1 << 64), r["n"]))
        later = []
        for k, search in enumerate(open_):
            # cells without keys come first in their cell; keys ascend from cell to cell
            inside = sorted(held[k].get("in", []))
            unknown = {cell for cell, key, _ in inside if not key}
            steps: list[list[int]] = []  # (cell, key or 0, n): a whole cell, if some of its keys are not known
            for cell, key, n in inside:
                if steps and cell in unknown and steps[-1][0] == cell:
                    steps[-1][2] += n
                else:
                    steps.append([cell, key, n])
            sums = np.cumsum([held[k]["before"][0][2], *[n for *_, n in steps]])
            at = int(np.searchsorted(sums, search.rank, "right")) - 1
            if at < 0 or at >= len(steps):  # the thinned values missed: look everywhere
                later.append(search._replace(low=0, high=LAST_KEY, listed=False))
            elif steps[at][1]:
                found[search.place, search.rank] = _double(steps[at][1])
            else:
                low = search.low + steps[at][0] * search.width
                high = min(low + search.width - 1, search.high)
                if low == high:
                    found[search.place, search.rank] = _double(low)
                else:
                    later.append(search._replace(low=low, high=high, listed=steps[at][2] <= listed))
        open_ = later
    return found


def exact_quantiles(
    df: DataFrame,
    values: list[Column],
    rows: dict[int, int],
    thinned: DataFrame,
    fractions: tuple[float, ...],
    listed: int = LISTED_VALUES,
) -> dict[int, list[float]]:
    """Interpolated quantiles of each column by its place, in the order of `fractions`.

    The answers have the bits of the built-in percentile.
    """
    spots = {place: [f * (n - 1) for f in fractions] for place, n in rows.items()}
    ranks = {place: sorted({side(x) for x in held for side in (math.floor, math.ceil)}) for place, held in spots.items()}
    found = values_at_ranks(df, values, rows, thinned, ranks, listed)

    def between(place: int, spot: float) -> float:
        low, high = found[place, math.floor(spot)], found[place, math.ceil(spot)]
        return low if low == high else (math.ceil(spot) - spot) * low + (spot - math.floor(spot)) * high

    return {place: [between(place, spot) for spot in held] for place, held in spots.items()}


def column_medians(df: DataFrame, columns: list[str]) -> list[float | None]:
    """Exact median of each column, null for a column without values; two or three scans of these columns."""
    values = [F.col(c).cast("double") for c in columns]
    parts = settled(column_moments(df, values).select("place", "n", "thinned"))
    rows = {row["place"]: row["n"] for row in parts.groupBy("place").agg(F.sum("n").alias("n")).collect()}  # one row per column
    found = exact_quantiles(df, values, rows, parts, (0.5,))
    return [float(found[place][0]) if place in found else None for place in range(len(columns))]


def outside_counts(df: DataFrame, values: list[Column], bounds: list[tuple[float, float, float, float]]) -> DataFrame:
    """(place, outside, third): values below `lower` or above `upper`, and values other than `low` and `high`."""
    width = len(values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((width, 2), np.int64)
        for batch in batches:
            for place, (lower, upper, low, high) in enumerate(bounds):
                v = _numbers(batch.column(place))
                counts[place] += [((v < lower) | (v > upper)).sum(), ((v != low) & (v != high)).sum()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array(counts[:, 0]), pa.array(counts[:, 1])], names=["place", "outside", "third"])

    parts = _doubles(df, values).mapInArrow(work, "place int, outside long, third long")
    return parts.groupBy("place").agg(F.sum("outside").alias("outside"), F.sum("third").alias("third"))
