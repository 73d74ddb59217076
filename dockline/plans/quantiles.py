"""Exact linear-interpolated quantiles per group with bounded state per task.

``percentile`` keeps every distinct value of a group in one buffer, which fails
once one group holds a large share of a big table. So group sizes are counted
first, groups of at most ``DIRECT_ROWS`` values use ``percentile``, and in larger
groups the order statistic is located by narrowing:

1. a histogram per group on a monotone coarse cell (a log scale), built with
   map-side combine, so its shuffle carries cells and not rows;
2. inside the cells that hold a wanted rank, a histogram on ``FINE_CELLS`` equal
   slices of the cell's own value range, repeated while a cell is still large.
   The smallest and the largest value always part, so every round shrinks it;
3. inside a small cell, the distinct values and their counts.

A rank whose cell holds a single value is answered at once, so whole-number
columns usually need only the first pass. Cells depend on values alone (no
sampling, no partition numbers), so re-run tasks give the same answer, and the
result is exact: narrowing only decides where to look.

Between the passes the cells that hold a wanted rank are fetched. Up to
``BROADCAST_CELLS`` of them are sent to every task, so the next pass shuffles no
rows; beyond that they stay distributed and rows are matched by a shuffle join
on group *and* cell, which spreads a hot group over its cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dockline.functions.columns import match_rows
from dockline.plans.ranking import settled

COARSE_PER_E_FOLD = 256
FINE_CELLS = 16384
BROADCAST_CELLS = 20_000
DIRECT_ROWS = 200_000


def _coarse_cell(value: Column) -> Column:
    """Non-decreasing map from a double to a cell number on a signed log scale."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * F.lit(float(COARSE_PER_E_FOLD)))


def _fine_cell(value: Column, low: Column, high: Column) -> Column:
    return F.floor((value - low) / (high - low) * F.lit(float(FINE_CELLS)))


def _long_form(df: DataFrame, keys: list[str], values: list[Column]) -> DataFrame:
    cells = [
        F.struct(F.lit(i).alias("_series"), value.alias("_v"))
        for i, value in enumerate(values)
    ]
    if len(cells) == 1:
        rows = df.select(*keys, F.lit(0).alias("_series"), values[0].alias("_v"))
    else:
        rows = df.select(*keys, F.explode(F.array(*cells)).alias("_cell"))
        rows = rows.select(*keys, "_cell._series", "_cell._v")
    return rows.filter(F.col("_v").isNotNull() & ~F.isnan("_v"))


def _ranked_cells(cells: DataFrame, within: list[str], order: str) -> DataFrame:
    """One row per (cell, wanted rank in it), with the number of values below the cell."""
    running = W.partitionBy(*within).orderBy(order)
    placed = cells.withColumn("_upto", F.sum("_n").over(running) + F.col("_below"))
    placed = placed.withColumn("_from", F.col("_upto") - F.col("_n"))
    inside = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_upto"))
    return (
        placed.withColumn("_rank", F.explode("_ranks"))
        .filter(inside)
        .drop("_ranks", "_below", "_upto")
        .withColumnRenamed("_from", "_below")
    )


def _kept(hits: DataFrame) -> tuple[DataFrame, bool, int]:
    """Materialise the hits: (frame, small enough to broadcast, largest open cell).

    Up to ``BROADCAST_CELLS`` hits come back as a local table; more than that are
    checkpointed and stay distributed.
    """
    rows = hits.limit(BROADCAST_CELLS + 1).collect()
    if len(rows) <= BROADCAST_CELLS:
        largest = max((r["_n"] for r in rows if r["_lo"] < r["_hi"]), default=0)
        return hits.sparkSession.createDataFrame(rows, hits.schema), True, largest
    hits = settled(hits)
    largest = hits.agg(F.max(F.when(F.col("_lo") < F.col("_hi"), F.col("_n")))).first()[0]
    return hits, False, largest or 0


def grouped_quantiles(
    df: DataFrame,
    keys: list[str],
    wanted: dict[str, tuple[Column | str, float]],
    direct_rows: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """One row per group with a column per entry of ``wanted``.

    ``wanted`` maps an output name to ``(value, fraction)``. Nulls and NaN are
    ignored. Groups without any value may be absent from the result, so callers
    left-join it. With no keys the result is exactly one row. Runs the counting
    passes when called; a caller that already knows the largest group size gives
    it as ``largest`` and saves one.
    """
    if not keys:
        return _by_narrowing(df, keys, wanted)
    limit = DIRECT_ROWS if direct_rows is None else direct_rows
    if largest is not None:
        route = _by_percentile if largest <= limit else _by_narrowing
        return route(df, keys, wanted)
    values = {_label(name, value): _column(value) for name, (value, _) in wanted.items()}
    counts = [F.count(value) for value in values.values()]
    size = F.greatest(*counts) if len(counts) > 1 else counts[0]
    sizes = df.groupBy(*keys).agg(size.alias("_size"))
    large = F.col("_size") > limit
    groups, large_groups = sizes.agg(F.count("*"), F.count(F.when(large, 1))).first()
    if large_groups == 0:
        return _by_percentile(df, keys, wanted)
    if large_groups == groups:
        return _by_narrowing(df, keys, wanted)
    big = settled(sizes.filter(large).select(*keys))
    if large_groups <= BROADCAST_CELLS:
        big = F.broadcast(big)  # counted just above
    return _by_percentile(match_rows(df, big, keys, "left_anti"), keys, wanted).unionByName(
        _by_narrowing(match_rows(df, big, keys, "left_semi"), keys, wanted)
    )


def _label(name: str, value: Column | str) -> str:
    return value if isinstance(value, str) else name


def _column(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("double")


def _by_percentile(
    df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column | str, float]]
) -> DataFrame:
    """Built-in exact percentile, for groups of a counted size."""
    picks = []
    for name, (value, fraction) in wanted.items():
        column = _column(value)
        number = F.when(~F.isnan(column), column)
        picks.append(F.percentile(number, F.lit(fraction)).alias(name))
    return df.groupBy(*keys).agg(*picks)


def _by_narrowing(
    df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column | str, float]]
) -> DataFrame:
    columns: list[Column] = []
    labels: list[str] = []
    series_of: dict[str, int] = {}
    for name, (value, _) in wanted.items():
        label = _label(name, value)
        if label not in labels:
            labels.append(label)
            columns.append(_column(value))
        series_of[name] = labels.index(label)
    fractions = [
        sorted({wanted[name][1] for name in wanted if series_of[name] == series})
        for series in range(len(columns))
    ]

    rows = _long_form(df, keys, columns).withColumn("_c1", _coarse_cell(F.col("_v")))
    group = [*keys, "_series"]

    def position(fraction: float) -> Column:
        return F.lit(fraction) * (F.col("_total") - F.lit(1))

    ranks = None
    for series, parts in enumerate(fractions):
        sides = [side(position(p)).cast("long") for p in parts for side in (F.floor, F.ceil)]
        listed, test = F.array_distinct(F.array(*sides)), F.col("_series") == series
        ranks = F.when(test, listed) if ranks is None else ranks.when(test, listed)

    first = rows.groupBy(*group, "_c1").agg(
        F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    first = first.withColumns(
        {
            "_total": F.sum("_n").over(W.partitionBy(*group)),
            "_below": F.lit(0).cast("long"),
        }
    ).withColumn("_ranks", ranks)
    hits, small, largest = _kept(_ranked_cells(first, group, "_c1"))
    value = [*group, "_total", "_rank"]
    answered = F.col("_lo") == F.col("_hi")
    answers = [hits.filter(answered).select(*value, F.col("_lo").alias("_v"))]

    # A cell is an interval of values: (group, coarse cell, lowest value) names it.
    cell = [*group, "_c1", "_low"]
    while largest > 0:
        parents = (
            hits.filter(~answered)
            .groupBy(*group, "_c1", F.col("_lo").alias("_low"), F.col("_hi").alias("_high"))
            .agg(F.max("_total").alias("_total"), F.max("_below").alias("_below"))
        )
        ranks_of = (
            hits.filter(~answered)
            .groupBy(*group, "_c1", F.col("_lo").alias("_low"))
            .agg(F.collect_set("_rank").alias("_ranks"))  # at most two per fraction
        )
        if small:
            parents = F.broadcast(parents)  # counted: at most BROADCAST_CELLS rows
        inside = match_rows(rows, parents, [*group, "_c1"], "inner").filter(
            (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))
        )
        totals = [F.count("*").alias("_n"), F.max("_total").alias("_total"), F.max("_below").alias("_below")]
        if largest <= DIRECT_ROWS:
            levels = inside.groupBy(*cell, "_v").agg(*totals)
            levels = match_rows(levels, ranks_of, cell, "inner")
            answers.append(_ranked_cells(levels, cell, "_v").select(*value, F.col("_v")))
            break
        slices = (
            inside.withColumn("_c2", _fine_cell(F.col("_v"), F.col("_low"), F.col("_high")))
            .groupBy(*cell, "_c2")
            .agg(*totals, F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        )
        slices = match_rows(slices, ranks_of, cell, "inner")
        hits, small, largest = _kept(_ranked_cells(slices, cell, "_c2"))
        answers.append(hits.filter(answered).select(*value, F.col("_lo").alias("_v")))

    found = reduce(lambda a, b: a.unionByName(b), answers)
    results = []
    for name, (_, fraction) in wanted.items():
        here = F.col("_series") == series_of[name]
        spot = position(fraction)
        low = F.max(F.when(here & (F.col("_rank") == F.floor(spot)), F.col("_v")))
        high = F.max(F.when(here & (F.col("_rank") == F.ceil(spot)), F.col("_v")))
        # the weights of the built-in percentile, so both branches give the same bits
        above = F.max(F.when(here, F.ceil(spot) - spot))
        part = F.max(F.when(here, spot - F.floor(spot)))
        results.append(F.when(low == high, low).otherwise(above * low + part * high).alias(name))
    return found.groupBy(*keys).agg(*results)
