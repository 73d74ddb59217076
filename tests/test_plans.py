"""Quantile and ranking plans against plain numpy and pandas."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dockline.llm.common import stored
from dockline.operators import evaluation
from dockline.plans import cuts, ranking
from dockline.plans.quantiles import grouped_quantiles
from dockline.plans.ranking import running

FRACTIONS = (0.0, 0.25, 0.5, 0.9, 1.0)


def _expected(values, fraction):
    return float(np.quantile(np.array(values), fraction))


@pytest.mark.parametrize("direct_rows", [0, 40, 10_000])
def test_quantiles_match_numpy_with_a_hot_group(spark, direct_rows):
    random = np.random.default_rng(7)
    frame = pd.DataFrame(
        {
            "k": ["hot"] * 600 + ["b"] * 100 + [None] * 50 + ["one"],
            "v": np.concatenate(
                [random.lognormal(3, 2, 600), -random.normal(0, 5, 100), np.full(50, 2.5), [7.0]]
            ),
        }
    )
    frame["w"] = (frame.index % 7).astype(float)
    df = spark.createDataFrame(frame)
    wanted = {f"q{i}": ("v", f) for i, f in enumerate(FRACTIONS)} | {"w": ("w", 0.5)}
    got = {r["k"]: r for r in grouped_quantiles(df, ["k"], wanted, direct_rows).collect()}
    assert set(got) == {"hot", "b", None, "one"}
    for key, row in got.items():
        part = frame[frame.k.isna()] if key is None else frame[frame.k == key]
        for i, f in enumerate(FRACTIONS):
            assert row[f"q{i}"] == pytest.approx(_expected(part.v, f), rel=1e-12)
        assert row["w"] == pytest.approx(_expected(part.w, 0.5))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e9, 1e9, allow_nan=False).map(lambda x: x + 0.0), min_size=1, max_size=60))
def test_global_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = grouped_quantiles(df, [], {"a": ("v", 0.5), "b": ("v", 0.9)}).first()
    assert row["a"] == pytest.approx(_expected(values, 0.5), rel=1e-9, abs=1e-9)
    assert row["b"] == pytest.approx(_expected(values, 0.9), rel=1e-9, abs=1e-9)


def test_quantiles_ignore_null_and_nan_and_survive_empty_input(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert grouped_quantiles(df, [], {"m": ("v", 0.5)}).first()["m"] == 2.0
    rows = grouped_quantiles(df.limit(0), [], {"m": ("v", 0.5)}).collect()
    assert len(rows) == 1 and rows[0]["m"] is None
    keyed = df.limit(0).withColumn("k", F.lit("a"))
    assert grouped_quantiles(keyed, ["k"], {"m": ("v", 0.5)}).collect() == []


def test_many_equal_values_resolve_without_a_second_pass(spark):
    df = spark.range(5000).select((F.col("id") % 5).cast("double").alias("v"))
    row = grouped_quantiles(df, [], {"a": ("v", 0.5), "b": ("v", 0.75)}).first()
    assert (row["a"], row["b"]) == (2.0, 3.0)


def test_large_cells_are_sliced_again(spark, monkeypatch):
    from dockline.plans import quantiles

    monkeypatch.setattr(quantiles, "DIRECT_ROWS", 3)
    monkeypatch.setattr(quantiles, "FINE_CELLS", 4)
    random = np.random.default_rng(5)
    # nearly all values inside a sliver of one coarse cell, with a far neighbour in it
    values = (1000.0 + random.random(400) * 1e-7).tolist() + [1001.0, 999.0, 5.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = grouped_quantiles(df, [], {"a": ("v", 0.5), "b": ("v", 0.9)}).first()
    assert row["a"] == pytest.approx(_expected(values, 0.5), rel=1e-15)
    assert row["b"] == pytest.approx(_expected(values, 0.9), rel=1e-15)


def test_many_hits_stay_distributed(spark, monkeypatch):
    from dockline.plans import quantiles

    monkeypatch.setattr(quantiles, "BROADCAST_CELLS", 3)
    df = spark.range(900).select((F.col("id") % 9).alias("k"), (F.col("id") * 1.7).alias("v"))
    got = grouped_quantiles(df, ["k"], {"m": ("v", 0.5)}, direct_rows=0).toPandas()
    want = df.toPandas().groupby("k").v.median()
    assert dict(zip(got.k, got.m)) == pytest.approx(want.to_dict())


def test_running_numbers_rows_and_sums_over_a_global_order(spark):
    df = spark.range(2000).select(
        F.col("id"), (F.col("id") % 3).alias("score"), (F.col("id") % 10).alias("x")
    )
    got = running(df, [F.col("score").desc(), F.col("id")], row_number="rn", sums={"s": "x"}).toPandas()
    want = got.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
    assert list(want["rn"]) == list(range(1, 2001))
    assert list(want["s"]) == list(want["x"].cumsum())


def test_running_restarts_per_key_and_splits_a_hot_key(spark):
    df = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, None).otherwise("hot").alias("k")
    )
    got = running(df, [F.col("id").desc()], keys=["k"], row_number="rn").toPandas()
    for _, part in got.groupby("k", dropna=False):
        ordered = part.sort_values("id", ascending=False)
        assert list(ordered["rn"]) == list(range(1, len(part) + 1))
    chunks = running(df, [F.col("id")], keys=["k"], row_number="rn", chunks=4)
    assert chunks.count() == 3000


def test_a_join_side_is_broadcast_only_when_counted_small(spark):
    from dockline.plans.ranking import small_or_stored

    df = spark.range(50)
    assert small_or_stored(df, 50).count() == 50
    stored = small_or_stored(df, 10)
    assert stored.count() == 50 and "ResolvedHint" not in stored._jdf.queryExecution().logical().toString()


def test_both_quantile_branches_give_the_same_bits(spark):
    random = np.random.default_rng(5)
    frame = pd.DataFrame({"k": random.integers(0, 60, 6000), "v": np.round(random.lognormal(3, 2, 6000), 2)})
    df = spark.createDataFrame(frame)
    wanted = {f"q{i}": ("v", f) for i, f in enumerate((0.1, 0.25, 0.5, 0.75, 0.9, 0.95))}
    both = [sorted(map(tuple, grouped_quantiles(df, ["k"], wanted, direct).collect())) for direct in (0, 10_000)]
    assert both[0] == both[1]


def _ordered(rows):
    """Rows by score descending (null last), then name ascending (null first)."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))


@pytest.mark.parametrize("levels", [1, 3, 10_000])
@pytest.mark.parametrize("direct", [40, 100_000])
def test_keys_at_ranks_equal_a_full_order(spark, levels, direct):
    pick = random.Random(levels)
    rows = [(pick.choice([None, float(pick.randrange(levels))]), pick.choice([None, f"n{pick.randrange(700)}"])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "score double, name string").repartition(5)
    ranks = [0, 1, 2, 300, 1499, 1500, 2999, 3000, 3001]
    order = [cuts.Term("score", ascending=False), cuts.Term("name")]
    got = cuts.keys_at_ranks(df, order, ranks, direct_rows=direct, sample_keys=60)
    assert got == {r: _ordered(rows)[r - 1] for r in ranks if 1 <= r <= 3000}


@pytest.mark.parametrize("levels", [1, 3, 10_000])
@pytest.mark.parametrize("direct", [100, 100_000])
def test_keys_at_score_ranks_equal_a_full_order(spark, levels, direct):
    pick = random.Random(levels)
    rows = [(float(pick.randrange(-levels, levels)), pick.choice([None, f"n{pick.randrange(700)}"])) for _ in range(6000)]
    df = spark.createDataFrame(rows, "score double, name string").repartition(5)
    ranks = [0, 1, 2, 300, 2999, 3000, 5999, 6000, 6001]
    want = {r: _ordered(rows)[r - 1] for r in ranks if 1 <= r <= 6000}
    assert cuts.keys_at_score_ranks(df, "score", ["name"], ranks, 6000, direct) == want
    gaps = df.unionByName(df.limit(1).withColumn("score", F.lit(None).cast("double")))
    assert cuts.keys_at_score_ranks(gaps, "score", ["name"], ranks[:8], 6001) == want


def test_keys_at_ranks_of_equal_and_of_no_rows(spark):
    df = spark.createDataFrame([(1.0, "a")] * 500, "score double, name string")
    order = [cuts.Term("score"), cuts.Term("name")]
    assert cuts.keys_at_ranks(df, order, [1, 250, 500], direct_rows=10, sample_keys=20) == dict.fromkeys([1, 250, 500], (1.0, "a"))
    assert cuts.keys_at_ranks(df.limit(0), order, [1, 2]) == {}


@pytest.mark.parametrize("count", [0, 1, 2, 9, 10, 11, 95])
def test_deciles_and_gains_equal_the_ranked_rows(spark, count):
    pick = random.Random(count)
    rows = [(pick.choice([0.1, 0.5, 0.9]), f"{i:03d}", pick.random() < 0.3) for i in range(count)]
    df = spark.createDataFrame(rows, "score double, name string, late boolean")
    ranked = sorted(rows, key=lambda r: (-r[0], r[1]))
    want = {r[1]: max(1, -(-i * 10 // (count - 1))) if count > 1 else 1 for i, r in enumerate(ranked)}
    assert {r.name: r.decile for r in evaluation.with_deciles(df, "score", ["name"]).collect()} == want
    for row in evaluation.gains_curve(df, "score", "late", ["name"]).collect():
        if count:
            reviewed = max(round(count * row.targeted_pct / 100), 1)
            assert (row.shipments_reviewed, row.late_captured) == (reviewed, sum(r[2] for r in ranked[:reviewed]))
        else:
            assert row.shipments_reviewed is None


def test_deciles_move_no_row(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("score"), "id")
    plan = evaluation.with_deciles(df, "score", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_row_numbers_are_shuffled_once(spark):
    df = spark.createDataFrame([(k % 3 or None, k) for k in range(300)], "g long, v long").repartition(7)
    out = running(df, [F.col("v").desc()], keys=["g"], row_number="n")
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    for g in (None, 1, 2):
        values = sorted((r.v, r.n) for r in out.collect() if r.g == g)
        assert [n for _, n in values] == list(range(100, 0, -1))


@pytest.mark.parametrize("copy", [ranking.settled, lambda df: stored(df, "copy")], ids=["settled", "stored"])
def test_copies_leave_no_shuffle_files_and_the_setting_as_it_was(spark, copy):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        kept = disk.getAllFiles()
        names = (kept.apply(k).getName() for k in range(kept.length()))
        return {x for x in names if x.startswith("shuffle_")}

    before, setting = files(), spark.conf.get(name)
    df = spark.range(100).groupBy((F.col("id") % 7).alias("g")).agg(F.sum("id").alias("s"))
    copied = copy(df)
    for _ in range(50):  # they are removed in the background
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(name) == setting == "false"
    assert sorted(map(tuple, copied.collect())) == sorted(map(tuple, df.collect()))
