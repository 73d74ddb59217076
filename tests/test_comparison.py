"""Statistical operators against published anchors and enumeration."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dockline.functions import special
from dockline.operators import comparison
from dockline.operators.ingest import with_era
from dockline.sources import tables


def _counts(spark, x1, n1, x2, n2):
    return spark.createDataFrame([(x1, n1, x2, n2)], "a long, b long, c long, d long")


def _z(spark, x1, n1, x2, n2):
    return comparison.with_two_proportions(_counts(spark, x1, n1, x2, n2), "a", "b", "c", "d").first()


def test_two_proportions_anchor(spark):
    row = _z(spark, 920, 1000, 951, 1000)
    assert row["z_statistic"] == pytest.approx(2.822, abs=1e-3)
    assert row["significant"] and row["absolute_diff_pp"] == 3.1
    same = _z(spark, 500, 1000, 500, 1000)
    assert not same["significant"] and same["p_value"] == pytest.approx(1.0)


def test_two_proportions_far_tail(spark):
    row = _z(spark, 4479, 5404, 4661, 4920)
    assert row["absolute_diff_pp"] == pytest.approx(11.85, abs=0.05)
    assert row["p_value"] == pytest.approx(7.53e-80, rel=0.01)


def test_tail_functions_against_known_values():
    assert special.two_sided_normal(1.959963984540054) == pytest.approx(0.05, rel=1e-12)
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-10)
    assert special.chi2_sf(9.487729036781154, 4) == pytest.approx(0.05, rel=1e-10)
    assert special.chi2_sf(2 * 50.0, 2) == pytest.approx(math.exp(-50.0), rel=1e-10)
    assert special.chi2_sf(400.0, 1) == pytest.approx(special.two_sided_normal(20.0), rel=1e-10)
    assert special.two_sided_t(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-9)
    assert special.two_sided_t(1.0, 1) == pytest.approx(0.5, rel=1e-12)
    assert special.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, rel=1e-9)


def test_rank_sum_exact_equals_enumeration():
    a, b = [1.1, 5.0, 2.2], [3.3, 4.4, 0.5, 7.0, 9.1]
    u = sum(x > y for x in a for y in b)
    pool = a + b
    every = []
    for pick in itertools.combinations(range(8), 3):
        mine = [pool[i] for i in pick]
        rest = [pool[i] for i in range(8) if i not in pick]
        every.append(sum(x > y for x in mine for y in rest))
    top = max(u, 15 - u)
    want = min(1.0, 2 * sum(v >= top for v in every) / len(every))
    assert special.rank_sum_exact(u, 3, 5) == pytest.approx(want)


def test_chi_square_equals_squared_z_on_two_by_two(spark):
    rows = [("a", 1)] * 80 + [("a", 0)] * 920 + [("b", 1)] * 49 + [("b", 0)] * 951
    df = spark.createDataFrame(rows, "g string, late int")
    chi = comparison.chi_square_test(df, "g", "late").first()
    z = comparison.two_proportion_test(df, F.col("late") == 0, F.col("g") == "b").first()
    assert chi["chi2_statistic"] == pytest.approx(z["z_statistic"] ** 2, abs=1e-3)
    assert chi["p_value"] == pytest.approx(z["p_value"], rel=1e-6)


def test_chi_square_flags_a_small_cell(spark):
    rows = [("A", i % 10 == 0) for i in range(100)] + [("B", i == 0) for i in range(4)]
    df = spark.createDataFrame([(g, int(x)) for g, x in rows], "group string, late int")
    row = comparison.chi_square_test(df, "group", "late").first()
    assert not row["expected_counts_adequate"] and row["degrees_of_freedom"] == 1


def _two(spark, x, y):
    frame = pd.DataFrame({"arm": ["a"] * len(x) + ["b"] * len(y), "v": np.concatenate([x, y])})
    return spark.createDataFrame(frame)


def test_welch_and_rank_choice(spark):
    random = np.random.default_rng(3)
    plain = _two(spark, random.normal(100, 10, 500), random.normal(104, 10, 500))
    row = comparison.compare_continuous(plain, "v", "arm", "a", "b").first()
    assert row["recommended_test"] == "welch" and row["welch_significant"]
    tail = _two(
        spark, np.concatenate([random.normal(10, 2, 500), [50_000, 90_000]]), random.normal(12, 2, 500)
    )
    row = comparison.compare_continuous(tail, "v", "arm", "a", "b").first()
    assert row["recommended_test"] == "mann_whitney" and row["rank_significant"]
    assert row["max_abs_skew"] > 2


def test_degenerate_arms(spark):
    df = _two(spark, np.array([1.0]), np.array([2.0, 3.0]))
    row = comparison.compare_continuous(df, "v", "arm", "a", "b").first()
    assert row["recommended_test"] == "none" and row["rank_p"] is None
    note = comparison.mann_whitney_test(df, "v", "arm", "a", "b").first()["note"]
    assert note == "insufficient data in one group"


def _stable(spark):
    random = np.random.default_rng(11)
    n = 4000
    route = np.where(np.arange(n) % 2 == 0, "A", "B")
    late = np.where(random.random(n) < np.where(route == "A", 0.20, 0.10), 1, 0)
    frame = pd.DataFrame(
        {
            "shipment_id": np.arange(n),
            "fulfil_via": route,
            "era": np.where(np.arange(n) % 4 < 2, "early", "late"),
            "delivery_delay_days": 0,
            "is_late": late,
            "delivery_year": 2008,
        }
    )
    return spark.createDataFrame(frame)


def test_interaction_detector_stays_quiet_on_a_stable_gap(spark):
    row = comparison.stratified_comparison(_stable(spark)).summary.first()
    assert not row["interaction_detected"] and not row["is_sign_flip"]
    assert abs(abs(row["pooled_gap_pp"]) - 10) < 3 and row["gap_range_pp"] < 5
    assert f"{row['pooled_gap_pp']:+.2f}" in row["verdict"]


def test_interaction_detector_fires_on_the_generated_gap(spark):
    # at 6,000 rows the early gap is noise around zero, so the larger tables are used
    rows = tables.stored_shipments(spark, "/root/testdata/sf0.01")
    row = comparison.stratified_comparison(with_era(rows, 1998)).summary.first()
    assert row["interaction_detected"] and not row["is_sign_flip"]


def test_structural_absence_is_named(ship):
    row = comparison.continuous_comparison(ship, "vendor_lead_time_days").first()
    assert "structurally missing for From RDC" in row["verdict"]
    assert row["coverage_low"] == 0.0


def test_more_than_two_levels_is_refused_in_words(ship):
    found = comparison.stratified_comparison(with_era(ship, 1998), "region")
    assert found.strata.count() == 0
    assert "exactly two levels" in found.summary.first()["verdict"]


def _decision(spark, x1, n1, x2, n2, with_mde=True):
    frame = _counts(spark, x1, n1, x2, n2).selectExpr(
        "a", "b", "c", "d", "b AS worst_n", "b - a AS worst_late", "d AS best_n", "d - c AS best_late",
        "b + d AS total", "b + d - a - c AS total_late",
    )
    tested = comparison.with_power(comparison.with_two_proportions(frame, "a", "b", "c", "d"))
    return comparison.with_decision(tested, with_mde=with_mde).first()


def test_decisions(spark):
    assert _decision(spark, 440_000, 500_000, 441_000, 500_000)["decision"] == "DO NOT ACT"
    assert _decision(spark, 920, 1000, 951, 1000)["decision"] == "ACT"
    assert _decision(spark, 500, 1000, 500, 1000)["decision"] == "NO EFFECT (BOUNDED)"
    assert _decision(spark, 500_000, 1_000_000, 500_000, 1_000_000)["decision"] == "NO EFFECT"
    assert _decision(spark, 500, 1000, 500, 1000, with_mde=False)["decision"] == "INCONCLUSIVE"


def test_power_functions_agree_with_each_other():
    n = special.size_per_arm(0.92, 0.951, 0.05, 0.80)
    h = special.cohens_h(0.92, 0.951)
    assert special.normal_power(h, n, n, 0.05) >= 0.80 > special.normal_power(h, n - 1, n - 1, 0.05)
    assert special.detectable_h(n, n, 0.05, 0.80) == pytest.approx(abs(h), rel=1e-2)


def test_rank_sum_exact_has_no_size_limit_and_no_cancellation():
    import math

    least = special.rank_sum_exact(0, 8, 20_000)
    assert least == pytest.approx(2 / math.comb(20_008, 8), rel=1e-12)
    shares = [special.rank_sum_exact(u, 8, 20_000) for u in (0, 10, 1_000, 40_000, 80_000)]
    assert shares == sorted(shares) and shares[-1] == 1.0
    # partitions of at most 5 into parts of any size here: 1 + 1 + 2 + 3 + 5 + 7
    assert special.rank_sum_exact(5, 8, 20_000) == pytest.approx(2 * 19 / math.comb(20_008, 8), rel=1e-12)
    assert special.rank_sum_p(1_000.0, 8, 3_000_000, 0) < 1e-20
