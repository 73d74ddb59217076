"""Column expressions used across the operators (all JVM-side built-ins)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(value: Column, places: int) -> Column:
    """Half-even rounding in floating point: scale, ``rint``, unscale.

    Spark's ``round`` is half-up and ``bround`` works on the decimal text; both
    differ from the array rounding the published figures rest on.
    """
    if places == 0:
        return F.rint(value.cast("double"))
    scale = float(10**places)
    return F.rint(value.cast("double") * F.lit(scale)) / F.lit(scale)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null unless the denominator is strictly positive."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double"))


def percent(numerator: Column, denominator: Column, places: int = 4) -> Column:
    """Rounded percentage that is 0 on an empty denominator."""
    return F.when(
        F.coalesce(denominator, F.lit(0)) == 0, F.lit(0.0)
    ).otherwise(rounded(F.lit(100.0) * numerator / denominator, places))


def money_sum(value: Column | str) -> Column:
    """Sum of amounts with all their digits, 0 for a group of nulls.

    Whole cents are added exactly, so money does not depend on the order in which
    tasks finish; what an amount has beyond cents, or above 10^15, is added apart.
    """
    column = (F.col(value) if isinstance(value, str) else value).cast("double")
    cents = F.when(F.abs(column) < F.lit(1e15), column.cast("decimal(18,2)"))
    rest = column - F.coalesce(cents.cast("double"), F.lit(0.0))
    return F.coalesce(F.sum(cents).cast("double"), F.lit(0.0)) + F.coalesce(F.sum(rest), F.lit(0.0))


def whole_sum(value: Column | str) -> Column:
    """Integer sum with 0 for a group that holds only nulls."""
    column = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(column.cast("long")), F.lit(0).cast("long"))


def tally(condition: Column) -> Column:
    """Number of rows where the condition is true (null counts as false)."""
    return F.count(F.when(condition, F.lit(1)))


def on_time_pct(late: Column, rows: Column) -> Column:
    return rounded(F.lit(100.0) * (F.lit(1.0) - late / rows), 2)


def nan_to_null(value: Column) -> Column:
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)


def any_of(conditions: list[Column]) -> Column:
    """Logical or of null-safe conditions, false for an empty list."""
    safe = [F.coalesce(c, F.lit(False)) for c in conditions]
    return reduce(lambda a, b: a | b, safe, F.lit(False))


def inline_rows(one_row: DataFrame, records: list[dict[str, Column]]) -> DataFrame:
    """Turn a one-row wide aggregate into one row per record."""
    structs = [
        F.struct(*[expression.alias(name) for name, expression in record.items()])
        for record in records
    ]
    return one_row.select(F.inline(F.array(*structs)))


def match_rows(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join on keys that may be null, where null matches null."""
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns]
    )
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    )
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*[f"__{k}" for k in keys])


def merge_single_rows(*frames: DataFrame) -> DataFrame:
    """Combine several one-row frames with disjoint columns into one row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    names = [name for frame in frames for name in frame.columns]
    return stacked.agg(*[F.max(name).alias(name) for name in names])


def distinct_per_column(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row of exact distinct counts, one per column; nulls are no level.

    Each column is deduplicated alone, on its own type and with map-side combine, so
    a scan reads one column and no row is expanded.
    """
    counts = [
        df.select(F.col(column).alias("v")).filter("v is not null").distinct().agg(F.count("*").alias(name))
        for name, column in columns.items()
    ]
    return merge_single_rows(*counts)


def levels_outside(df: DataFrame, column: str, allowed: tuple, name: str = "level") -> DataFrame:
    """Observed minus allowed: the distinct levels of a column that are not allowed; null is no level."""
    levels = df.select(F.col(f"`{column}`").alias(name)).filter(F.col(name).isNotNull())
    return levels.filter(~F.col(name).isin(*allowed)).distinct()
