"""Moments, quartiles and levels of many columns at once, against plain versions."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dockline.functions.columns import distinct_per_column
from dockline.operators import quality
from dockline.plans.levels import level_counts
from dockline.plans.moments import column_medians, column_moments, exact_quantiles, merged_moments, outside_counts

FRACTIONS = (0.0, 0.25, 0.5, 0.75, 1.0)


def _frame(rows=30_000):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame(
        {
            "spread": rng.lognormal(3, 2, rows),
            "ties": rng.integers(0, 4, rows).astype(float),
            "half": np.where(np.arange(rows) % 2 == 0, 7.0, rng.normal(7, 1, rows)),
            "flat": np.full(rows, 2.5),
            "gaps": np.where(rng.random(rows) < 0.9, np.nan, rng.normal(0, 5, rows)),
            "one": np.where(np.arange(rows) == 5, 3.0, np.nan),
            "none": np.full(rows, np.nan),
            "whole": rng.integers(-(10**15), 10**15, rows).astype(float),
        }
    )
    return frame


@pytest.mark.parametrize("listed", [4_000, 60, 0])
def test_quartiles_of_all_columns_are_exact(spark, listed):
    frame = _frame()
    df = spark.createDataFrame(frame).repartition(5)
    values = [F.col(c) for c in frame.columns]
    parts = column_moments(df, values)
    known = {i: int(frame[c].notna().sum()) for i, c in enumerate(frame.columns) if frame[c].notna().any()}
    got = exact_quantiles(df, values, known, parts, FRACTIONS, listed)
    assert set(got) == set(known)
    for place, name in enumerate(frame.columns):
        if place in known:
            held = df.agg(*[F.percentile(F.nanvl(name, F.lit(None)), F.lit(f)) for f in FRACTIONS]).first()
            assert got[place] == list(held)


def test_quartiles_with_infinite_values_and_few_rows(spark):
    df = spark.createDataFrame([(float("-inf"), 1.0), (1.0, None), (2.0, float("nan")), (float("inf"), 4.0)], "a double, b double")
    values = [F.col("a"), F.col("b")]
    got = exact_quantiles(df, values, {0: 4, 1: 2}, column_moments(df, values), (0.5, 1.0))
    assert got == {0: [1.5, float("inf")], 1: [2.5, 4.0]}
    assert exact_quantiles(df.limit(0), values, {}, column_moments(df.limit(0), values), (0.5,)) == {}


def test_moments_equal_the_built_in_aggregates(spark):
    frame = _frame(5_000)[["spread", "ties", "half", "gaps"]]
    df = spark.createDataFrame(frame).repartition(7)
    rows = {r.place: r for r in merged_moments(column_moments(df, [F.col(c) for c in frame.columns])).collect()}
    for place, name in enumerate(frame.columns):
        v = F.nanvl(name, F.lit(None))
        n, mean, var, skew, kurt, low, high = df.agg(
            F.count(v), F.avg(v), F.var_pop(v), F.skewness(v), F.kurtosis(v), F.min(v), F.max(v)).first()
        r = rows[place]
        assert (r.n, r.low, r.high) == (n, low, high)
        assert np.isclose([r.mean, r.m2 / n, r.m3 * n**0.5 / r.m2**1.5, n * r.m4 / r.m2**2 - 3], [mean, var, skew, kurt], rtol=1e-9).all()


def test_outside_counts(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (9.0,), (None,), (float("nan"),)], "a double")
    assert tuple(outside_counts(df, [F.col("a")], [(1.5, 5.0, 1.0, 9.0)]).first()) == (0, 2, 1)


def test_level_counts_of_every_type(spark):
    rows = [(1, 2.0, "a", True), (1, float("nan"), "b", None), (None, 2.0, "a", False), (2**60 + 1, -0.0, None, True), (2**60, 0.0, "", True)] * 30
    df = spark.createDataFrame(rows, "n long, d double, t string, b boolean").repartition(6)
    got = {(r.place, r.value): r.n for r in level_counts(df, {c: F.col(c) for c in df.columns}).collect() if r.place != 1}
    want = Counter()
    for n, _, t, b in rows:
        for place, value in ((0, n), (2, t), (3, b)):
            if value is not None:
                want[place, str(value).lower() if isinstance(value, bool) else str(value)] += 1
    assert got == dict(want)
    numbers = sorted(r.n for r in level_counts(df, {"d": F.col("d")}).collect())
    assert numbers == [60, 60]  # 2.0 and zero of either sign
    assert level_counts(df.limit(0), {"t": F.col("t")}).count() == 0


def test_levels_of_nearly_unique_columns_and_keys(spark):
    df = spark.range(5_000).select("id", F.concat(F.lit("v"), F.col("id") % 4_999).alias("text"), (F.col("id") % 3 == 0).alias("flag"))
    rows = {r.column: r for r in quality.table_levels(df, ["flag", "id"]).collect()}
    assert (rows["text"].unique, rows["text"].top, rows["text"].freq) == (4_999, "v0", 2)
    assert rows["id"].unique == rows[quality.KEY].unique == 5_000
    assert quality.most_frequent(df, ["flag"]).first().top == "false"


def test_an_audit_explodes_no_cell(spark, ship):
    audit = quality.assess_dataset(quality.Dataset(ship, ["shipment_id"]))
    alone = {
        "missing": quality.missing_value_report(ship),
        "validity": quality.validity_report(ship),
        "outliers": quality.outlier_report(ship),
        "summary": quality.summary_statistics(ship),
        "consistency": quality.consistency_report(ship),
        "recommendations": quality.preprocessing_recommendations(ship),
        "score": quality.data_quality_score(ship, ["shipment_id"]),
    }
    for name, report in alone.items():
        assert sorted(map(str, getattr(audit, name).collect())) == sorted(map(str, report.collect())), name
    assert audit.duplicates.summary.collect() == quality.duplicate_report(ship, ["shipment_id"]).summary.collect()


def test_medians_of_columns_with_and_without_values(spark):
    rows = [(i, None, float(i % 3) if i % 4 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b double, c double").repartition(5)
    want = df.agg(*[F.percentile(c, 0.5) for c in "abc"]).first()
    assert column_medians(df, ["a", "b", "c"]) == list(want)
    assert column_medians(df.limit(0), ["a", "b"]) == [None, None]


def test_distinct_counts_keep_the_type_of_a_column(spark):
    rows = [(1, "x", 0.0), (1, None, -0.0), (2, "X", None), (None, "x", float("nan")), (2, "", float("nan"))]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    got = distinct_per_column(df, {"n_a": "a", "n_b": "b", "n_c": "c"}).first()
    assert tuple(got) == (2, 3, 2)
    assert tuple(distinct_per_column(df.limit(0), {"n_a": "a"}).first()) == (0,)
