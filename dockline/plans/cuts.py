"""Rows at given ranks of a total order, without ordering or shuffling the table.

A decile or a gains curve needs the keys of a few rows, not a rank for every row. The
keys at the wanted ranks are found by narrowing: a bounded sample of keys gives for each
rank two keys that should enclose it, one aggregate over the table counts the rows below
and between them, and the rows between are sampled again until few enough are left to be
ordered. The sample only says where to look: every count is over all rows, and a pair that
misses its rank is widened. Ranks are exact, ties included.

A key is the tuple of the order's columns, so equal scores are told apart by the columns
that follow. Keys are compared with literals, so the caller can place each row by itself.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockline.plans.moments import column_moments, values_at_ranks
from dockline.plans.ranking import settled

SAMPLE_KEYS = 20_000
DIRECT_ROWS = 200_000
# sample places on either side of the expected one: about five standard deviations
MARGIN = 5


class Term(NamedTuple):
    """One column of an order; nulls come first ascending and last descending, as in Spark."""

    column: str
    ascending: bool = True

    def order(self) -> Column:
        return F.col(self.column).asc() if self.ascending else F.col(self.column).desc()


def precedes(order: list[Term], key: tuple, dtypes: list, or_equal: bool = False) -> Column:
    """Whether a row stands before `key` in the order (or at it)."""
    after_all = F.lit(or_equal)
    for term, value, dtype in reversed(list(zip(order, key, dtypes, strict=True))):
        held, cut = F.col(term.column), F.lit(value).cast(dtype)
        if term.ascending:
            before = F.lit(False) if value is None else held.isNull() | (held < cut)
        else:
            before = held.isNotNull() if value is None else held > cut
        after_all = F.coalesce(before, F.lit(False)) | (held.eqNullSafe(cut) & after_all)
    return after_all


class _Stretch(NamedTuple):
    """The rows strictly between two keys; null stands for the start or the end of the table."""

    low: tuple | None
    high: tuple | None
    below: int
    rows: int

    def holds(self, order: list[Term], dtypes: list) -> Column:
        after = F.lit(True) if self.low is None else ~precedes(order, self.low, dtypes, or_equal=True)
        return after if self.high is None else after & precedes(order, self.high, dtypes)


def keys_at_ranks(df: DataFrame, order: list[Term], ranks: list[int], *, rows: int | None = None,
                  direct_rows: int = DIRECT_ROWS, sample_keys: int = SAMPLE_KEYS) -> dict[int, tuple]:
    """Key of the row at each rank (1 is the first). Ranks outside 1..rows are left out.

    Reads `df` some times and shuffles the sample and the last rows looked at, no
    others. A rank among rows that are equal in all columns has their common key.
    """
    names = [term.column for term in order]
    keys = df.select(*names)
    dtypes = [keys.schema[name].dataType for name in names]
    total = keys.count() if rows is None else rows
    sort = [term.order() for term in order]
    found: dict[int, tuple] = {}
    places: dict[tuple, tuple[int, int]] = {}  # a key: rows before it, rows up to it
    open_ = {r: _Stretch(None, None, 0, total) for r in ranks if 1 <= r <= total}
    turn = 0
    while open_:
        stretches = list(dict.fromkeys(open_.values()))
        number = F.coalesce(*[F.when(s.holds(order, dtypes), F.lit(k)) for k, s in enumerate(stretches)])
        part = keys.withColumn("_part", number).filter(F.col("_part").isNotNull())
        held = sum(s.rows for s in stretches)
        if held <= direct_rows:
            wanted = {}
            for rank, s in open_.items():
                wanted.setdefault(stretches.index(s), {})[rank - s.below] = rank
            placed = part.withColumn("_place", F.row_number().over(W.partitionBy("_part").orderBy(*sort)))
            asked = reduce(lambda a, b: a | b, [(F.col("_part") == k) & F.col("_place").isin(*p) for k, p in wanted.items()])
            for row in placed.filter(asked).collect():  # a row a rank
                found[wanted[row["_part"]][row["_place"]]] = tuple(row[name] for name in names)
            break
        turn += 1
        sample = part.sample(min(1.0, sample_keys / held), seed=turn).sort("_part", *sort)
        picked: dict[int, list[tuple]] = {}
        for row in sample.collect():  # about sample_keys rows
            picked.setdefault(row["_part"], []).append(tuple(row[name] for name in names))
        ends = {}
        for rank, s in open_.items():
            near = picked.get(stretches.index(s), [])
            share = (rank - s.below) / s.rows
            spread = MARGIN * max((share * (1 - share) * len(near)) ** 0.5, 1.0)
            low, high = int(share * len(near) - spread), int(share * len(near) + spread) + 1
            if low < 0 and high >= len(near) and near:  # too few to enclose the rank: any key parts the stretch
                low = high = min(int(share * len(near)), len(near) - 1)
            ends[rank] = (near[low] if 0 <= low < len(near) else None, near[high] if high < len(near) else None)
        cuts = list(dict.fromkeys(end for pair in ends.values() for end in pair if end is not None))
        tests = [(precedes(order, cut, dtypes), precedes(order, cut, dtypes, or_equal=True)) for cut in cuts]
        counted = keys.agg(*[F.count(F.when(test, 1)) for pair in tests for test in pair]).first() if cuts else ()
        places |= {cut: (counted[2 * i], counted[2 * i + 1]) for i, cut in enumerate(cuts)}
        later = {}
        for rank in open_:
            # between the nearest two of all cuts so far, so that stretches are equal or apart
            low, start, high, end = None, 0, None, total
            for cut, (before, upto) in places.items():
                if before < rank <= upto:
                    found[rank] = cut
                elif start <= upto < rank:
                    low, start = cut, upto
                elif rank <= before <= end:
                    high, end = cut, before
            if rank not in found:
                later[rank] = _Stretch(low, high, start, end - start)
        open_ = later
    return found


def keys_at_score_ranks(df: DataFrame, score: str, ties: list[str], ranks: list[int], rows: int,
                        direct_rows: int = DIRECT_ROWS) -> dict[int, tuple]:
    """`keys_at_ranks` for an order of a score, highest first, and then of `ties`.

    The scores at the ranks are selected on numbers alone; only rows with just these
    scores are ordered by their ties. Scores that are missing or are no doubles take
    the general way.
    """
    order = [Term(score, ascending=False), *[Term(c) for c in ties]]
    wanted = sorted({r for r in ranks if 1 <= r <= rows})
    if not wanted:
        return {}
    parts = settled(column_moments(df, [F.col(score)]))
    present = parts.agg(F.sum("n")).first()[0]
    if present != rows or not isinstance(df.schema[score].dataType, T.DoubleType):
        return keys_at_ranks(df, order, wanted, rows=rows, direct_rows=direct_rows)
    found = values_at_ranks(df, [F.col(score)], {0: rows}, parts, {0: [rows - r for r in reversed(wanted)]})
    held = {r: found[0, rows - r] for r in wanted}
    levels = sorted(set(held.values()))
    counts = df.agg(*[F.count(F.when(test, 1)) for v in levels for test in (F.col(score) > v, F.col(score) == v)]).first()
    above, equal = dict(zip(levels, counts[::2], strict=True)), dict(zip(levels, counts[1::2], strict=True))
    keys: dict[int, tuple] = {}
    few = [v for v in levels if equal[v] <= direct_rows // len(levels)]
    for v in levels:
        if v not in few:  # a score that many rows share is searched by the ties
            inside = {r - above[v]: r for r in wanted if held[r] == v}
            rest = keys_at_ranks(df.filter(F.col(score) == v), order, list(inside), rows=equal[v], direct_rows=direct_rows)
            keys |= {inside[r]: key for r, key in rest.items()}
    if few:
        place = F.row_number().over(W.partitionBy(score).orderBy(*[term.order() for term in order]))
        tied = df.select(score, *ties).filter(F.col(score).isin(*few)).withColumn("_place", place)
        asked = reduce(lambda a, b: a | b, [
            (F.col(score) == v) & F.col("_place").isin(*[r - above[v] for r in wanted if held[r] == v]) for v in few])
        for row in tied.filter(asked).collect():  # a row a rank
            keys[above[row[score] + 0.0] + row["_place"]] = tuple(row[c] for c in (score, *ties))
    return keys
