"""Passes and rows that an audit takes, on rows built here."""

import pytest
from pyspark.sql import functions as F

from checks import quality as checks
from dockline.operators import quality
from dockline.plans import moments
from dockline.plans.levels import level_counts, level_summary


def test_tied_values_take_one_count(spark, monkeypatch):
    df = spark.range(0, 60_000, 1, 3).select((F.col("id") % 4).cast("double").alias("tied"), ((F.col("id") * 7919) % 60_000 / 7.0).alias("wide"))
    values = [F.col("tied"), F.col("wide")]
    parts, counts, counted = moments.column_moments(df, values).cache(), [], moments._counted
    monkeypatch.setattr(moments, "_counted", lambda df, values, searches: counts.append(len(searches)) or counted(df, values, searches))
    got = moments.exact_quantiles(df.select("tied"), values[:1], {0: 60_000}, parts.filter("place = 0"), (0.25, 0.5, 0.75), 100)
    assert got == {0: list(df.agg(*[F.percentile("tied", F.lit(f)) for f in (0.25, 0.5, 0.75)]).first())}
    assert len(counts) == 1
    # some tasks list the tied values, others count cells
    mixed = df.select(F.when(F.spark_partition_id() == 0, F.col("tied")).otherwise(F.col("wide") / 170).alias("v"))
    held = moments.column_moments(mixed, [F.col("v")])
    got = moments.exact_quantiles(mixed, [F.col("v")], {0: 60_000}, held, (0.1, 0.5, 0.9), 10)
    assert got == {0: list(mixed.agg(*[F.percentile("v", F.lit(f)) for f in (0.1, 0.5, 0.9)]).first())}


@pytest.mark.parametrize("parts", [1, 7])
def test_a_summary_of_levels_equals_the_counted_levels(spark, parts):
    df = spark.range(0, 3_000, 1, 4).select(
        "id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("é" * 3), (F.col("id") % 700).cast("string"))).alias("t"),
        F.when(F.col("id") % 2 == 0, "").otherwise("x").alias("e"), (F.col("id") % 5 == 0).alias("b"), (-(F.col("id") % 9)).cast("int").alias("i"),
        F.when(F.col("id") % 4 == 0, F.lit("NaN").cast("double")).when(F.col("id") % 4 == 1, -0.0).when(F.col("id") % 4 == 2, 0.0).otherwise(F.col("id") / 3).alias("d"),
        F.lit(None).cast("string").alias("none"))
    cells = {c: F.col(c) for c in df.columns}
    counts = level_counts(df, cells).toPandas()
    want = {}
    for place, group in counts.groupby("place"):
        best = group[group.n == group.n.max()]
        want[place] = (len(group), min(best.value, key=lambda v: v.encode()), int(group.n.max()))
    got = {r.place: (r.unique, r.top, r.freq) for r in level_summary(df, cells, parts).collect()}
    assert got == want and 6 not in got
    assert level_summary(df.limit(0), cells, parts).collect() == []


def test_an_audit_counts_a_single_key_once(spark, monkeypatch):
    seen, table = [], quality.table_levels
    monkeypatch.setattr(quality, "table_levels", lambda df, key=None: seen.append(key) or table(df, key))
    for kind in ("long", "string", "double"):
        df = spark.createDataFrame([(1.0, 1), (1.0, 2), (2.0, 3), (None, 4), (None, 4)], "k double, v long")
        df = df.withColumn("k", F.col("k").cast(kind))
        row = quality.assess_dataset(quality.Dataset(df, ["k"])).duplicates.summary.first()
        assert (row["key_duplicate_rows"], row["exact_duplicate_rows"]) == (2, 1)
    assert seen == [None, None, ["k"]]
    empty = quality.assess_dataset(quality.Dataset(df.limit(0).withColumn("k", F.lit(1)), ["k"])).duplicates.summary.first()
    assert empty["key_duplicate_rows"] is None


def test_the_published_table_is_parsed_once(spark, monkeypatch):
    parsed = spark.sparkContext.accumulator(0)
    note = F.udf(lambda v: parsed.add(1) or v, "string").asNondeterministic()
    texts = spark.range(40).select(F.col("id").cast("string").alias("ID"), (F.col("id") % 7).cast("string").alias("Line Item Quantity"))
    monkeypatch.setattr(checks.t, "stored_published", lambda *_: texts)
    monkeypatch.setattr(checks.t, "stored_shipments", lambda *_: spark.range(40).select(F.col("id").alias("shipment_id")))
    monkeypatch.setattr(checks.ingest, "published_types", lambda df: df.withColumn("ID", note("ID").cast("long")))
    assert checks.QUERIES["parsing_uplift"](spark, "").collect()[0]["dataset"] == "shipments"
    assert parsed.value == 40
