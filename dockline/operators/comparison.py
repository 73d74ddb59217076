"""Statistical comparison of groups: rates, tests, stratification and decisions.

Spark reduces the rows to sufficient statistics; p-values and similar finishers
run on the reduced frame. Arms: *treatment minus control*, which for a dimension
means *best level minus worst level*.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockline.config import DEFAULTS, Settings
from dockline.functions import special
from dockline.functions.columns import (
    merge_single_rows,
    on_time_pct,
    rounded,
    tally,
    whole_sum,
)
from dockline.plans.quantiles import grouped_quantiles
from dockline.plans.ranking import running, settled, small_or_stored

# Dimensions compared by default, and levels that are no real levels.
DIMENSIONS = {
    "fulfil_via": "follows the trade term almost one to one; look at each era apart",
    "shipment_mode": "changed over the years together with era",
    "region": "regions buy other products by other modes",
    "first_line_designation": "one side has hardly any freight figures",
    "product_group": "rare groups may be too small for the chi-square test",
    "era": "a split by time; use it for strata",
}
EXCLUDED_LEVELS = {"shipment_mode": ("Unknown",)}


def _real_level(dimension: str, level: Column) -> Column:
    test = level.isNotNull()
    if dimension in EXCLUDED_LEVELS:
        test = test & ~level.cast("string").isin(*EXCLUDED_LEVELS[dimension])
    return test


def usable_rows(df: DataFrame, dimension: str, min_size: int = DEFAULTS.min_group_size) -> DataFrame:
    """Rows with a known outcome whose level is real and large enough."""
    rows = df.filter(_real_level(dimension, F.col(dimension)) & F.col("is_late").isNotNull())
    kept = rows.groupBy(dimension).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_size)
    return rows.join(small_or_stored(kept.select(dimension)), dimension, "left_semi")


def group_rates(df: DataFrame, dimension: str, min_size: int = DEFAULTS.min_group_size) -> DataFrame:
    """On-time rate per usable level, worst first."""
    rows = df.filter(_real_level(dimension, F.col(dimension)) & F.col("is_late").isNotNull())
    return (
        rows.groupBy(F.col(dimension).cast("string").alias("level"))
        .agg(
            F.count("*").alias("n"),
            whole_sum("is_late").alias("late"),
            rounded(F.avg("delivery_delay_days"), 2).alias("mean_delay_days"),
        )
        .filter(F.col("n") >= min_size)
        .withColumn("on_time_pct", on_time_pct(F.col("late"), F.col("n")))
        .orderBy("on_time_pct", "level")
    )


def levels_excluded(df: DataFrame, dimension: str, min_size: int = DEFAULTS.min_group_size) -> DataFrame:
    """Observed levels that take no part in the comparison."""
    observed = df.select(F.col(dimension).cast("string").alias("level")).filter("level is not null")
    tested = group_rates(df, dimension, min_size).select("level")
    return observed.distinct().join(tested, "level", "left_anti").orderBy("level")


# --- proportions --------------------------------------------------------------------
def with_two_proportions(
    frame: DataFrame,
    hits_control: str,
    n_control: str,
    hits_treatment: str,
    n_treatment: str,
    alpha: float = DEFAULTS.alpha,
    p_values: bool = True,
) -> DataFrame:
    """Two-proportion z-test per row from counts.

    The statistic uses the pooled variance, the interval on the difference the
    unpooled one, and each arm gets a Wilson interval.
    """
    x1, n1 = F.col(hits_control).cast("double"), F.col(n_control).cast("double")
    x2, n2 = F.col(hits_treatment).cast("double"), F.col(n_treatment).cast("double")
    p1 = F.when(n1 > 0, x1 / n1).otherwise(0.0)
    p2 = F.when(n2 > 0, x2 / n2).otherwise(0.0)
    pooled = F.try_divide(x1 + x2, n1 + n2)
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    gap = p2 - p1
    error = F.sqrt(F.try_divide(p2 * (1 - p2), n2) + F.try_divide(p1 * (1 - p1), n1))
    crit = special.normal_quantile(1 - alpha / 2)

    def wilson(p: Column, n: Column, sign: int) -> Column:
        centre = p + crit**2 / (2 * n)
        half = crit * F.sqrt(p * (1 - p) / n + crit**2 / (4 * n * n))
        return (centre + sign * half) / (1 + crit**2 / n)

    raw = frame.withColumn("_z", F.try_divide(gap, spread))
    if p_values:
        raw = raw.withColumn("p_value", special.normal_p("_z"))
        raw = raw.withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))
    return raw.withColumns(
        {
            "p_control": rounded(p1, 5),
            "p_treatment": rounded(p2, 5),
            "absolute_diff": rounded(gap, 5),
            "absolute_diff_pp": rounded(100 * gap, 3),
            "relative_lift_pct": F.when(p1 > 0, rounded(100 * gap / p1, 3)).otherwise(0.0),
            "z_statistic": rounded(F.col("_z"), 4),
            "ci_lower": rounded(gap - crit * error, 5),
            "ci_upper": rounded(gap + crit * error, 5),
            "ci_lower_pp": rounded(100 * (gap - crit * error), 3),
            "ci_upper_pp": rounded(100 * (gap + crit * error), 3),
            "control_ci_lower": rounded(wilson(p1, n1, -1), 5),
            "control_ci_upper": rounded(wilson(p1, n1, 1), 5),
            "treatment_ci_lower": rounded(wilson(p2, n2, -1), 5),
            "treatment_ci_upper": rounded(wilson(p2, n2, 1), 5),
        }
    ).drop("_z")


def two_proportion_test(
    df: DataFrame, success: Column, treatment: Column, alpha: float = DEFAULTS.alpha, p_values: bool = True
) -> DataFrame:
    """One-row z-test between the rows where ``treatment`` holds and where it does not."""
    counts = df.agg(
        tally(~treatment & success).alias("hits_control"),
        tally(~treatment).alias("n_control"),
        tally(treatment & success).alias("hits_treatment"),
        tally(treatment).alias("n_treatment"),
    )
    return with_two_proportions(
        counts, "hits_control", "n_control", "hits_treatment", "n_treatment", alpha, p_values
    )


def contingency(df: DataFrame, group: str, outcome: str) -> DataFrame:
    """Observed cells of a two-way table with their margins."""
    cells = (
        df.filter(F.col(group).isNotNull() & F.col(outcome).isNotNull())
        .groupBy(F.col(group).alias("row_level"), F.col(outcome).alias("column_level"))
        .agg(F.count("*").alias("n"))
    )
    by_row = cells.groupBy("row_level").agg(F.sum("n").alias("row_total"))
    by_column = cells.groupBy("column_level").agg(F.sum("n").alias("column_total"))
    return cells.join(by_row, "row_level").join(by_column, "column_level")


def crosstab(df: DataFrame, group: str, outcome: str, levels: list, shares: bool = False) -> DataFrame:
    """Counts per group with a column per listed outcome level, zero where none.

    With ``shares`` each row is divided by its total.
    """
    counted = df.filter(F.col(group).isNotNull() & F.col(outcome).isNotNull()).groupBy(group).agg(
        *[tally(F.col(outcome) == level).alias(str(level)) for level in levels],
        F.count("*").alias("_total"),
    )
    if shares:
        counted = counted.withColumns(
            {str(v): rounded(F.col(str(v)) / F.col("_total"), 3) for v in levels}
        )
    return counted.drop("_total").orderBy(group)


def chi_square_test(
    df: DataFrame, group: str, outcome: str, alpha: float = DEFAULTS.alpha, p_values: bool = True
) -> DataFrame:
    """Independence test without continuity correction, effect size and adequacy flag.

    An empty cell adds its expected count to the statistic. Expected counts sum
    to the table total, so the empty cells together add the total minus the
    expected counts of the observed cells and need not be generated.
    """
    cells = contingency(df, group, outcome)
    total = cells.agg(F.sum("n")).scalar()
    expected = F.col("row_total") * F.col("column_total") / total
    wide = cells.withColumn("_e", expected).agg(
        F.sum("n").alias("n"),
        F.sum((F.col("n") - F.col("_e")) ** 2 / F.col("_e")).alias("observed_part"),
        F.sum("_e").alias("expected_part"),
        F.min("row_total").alias("least_row"),
        F.min("column_total").alias("least_column"),
        F.countDistinct("row_level").alias("rows"),
        F.countDistinct("column_level").alias("columns"),
    )
    chi2 = F.col("observed_part") + F.greatest(F.col("n") - F.col("expected_part"), F.lit(0.0))
    small = F.least("rows", "columns") - 1
    least = F.col("least_row") * F.col("least_column") / F.col("n")
    wide = wide.withColumn("_chi2", F.when(small > 0, chi2).otherwise(0.0)).withColumn(
        "degrees_of_freedom", (F.col("rows") - 1) * (F.col("columns") - 1)
    )
    if p_values:
        wide = wide.withColumn("p_value", special.chi2_p("_chi2", "degrees_of_freedom"))
        wide = wide.withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))
    kept = ["p_value", "significant"] if p_values else []
    return wide.select(
        rounded(F.col("_chi2"), 4).alias("chi2_statistic"),
        "degrees_of_freedom",
        F.when(small > 0, rounded(F.sqrt(F.col("_chi2") / (F.col("n") * small)), 4))
        .otherwise(0.0)
        .alias("cramers_v"),
        rounded(least, 1).alias("min_expected_count"),
        (least >= 5).alias("expected_counts_adequate"),
        "n",
        *kept,
    )


# --- continuous metrics ---------------------------------------------------------------
def _arms(df: DataFrame, metric: str, arm: str, first: Column, second: Column) -> DataFrame:
    """(arm 1 or 2, value) rows without nulls or NaN."""
    which = F.when(F.col(arm).eqNullSafe(first), 1).when(F.col(arm).eqNullSafe(second), 2)
    value = F.col(metric).cast("double")
    rows = df.select(which.alias("arm"), value.alias("v"))
    return rows.filter("arm is not null and v is not null and not isnan(v)")


def _welch(arms: DataFrame, alpha: float, p_values: bool) -> DataFrame:
    stats = {}
    for i, label in ((1, "a"), (2, "b")):
        value = F.when(F.col("arm") == i, F.col("v"))
        stats[f"n_{label}"] = F.count(value)
        stats[f"_m{label}"] = F.avg(value)
        stats[f"_v{label}"] = F.when(F.count(value) > 1, F.var_samp(value))
        stats[f"_k{label}"] = F.skewness(value)
    wide = arms.agg(*[expression.alias(name) for name, expression in stats.items()])
    n1, n2, v1, v2 = F.col("n_a"), F.col("n_b"), F.col("_va"), F.col("_vb")
    gap = F.col("_ma") - F.col("_mb")
    e1, e2 = F.try_divide(v1, n1), F.try_divide(v2, n2)
    error = F.sqrt(e1 + e2)
    dof = F.try_divide((e1 + e2) ** 2, F.try_divide(e1**2, n1 - 1) + F.try_divide(e2**2, n2 - 1))
    pooled = F.sqrt(F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))
    wide = wide.withColumns(
        {
            "_gap": gap,
            "_error": error,
            "_t": F.try_divide(gap, error),
            "_dof": dof,
            "_d": F.when(pooled > 0, gap / pooled).otherwise(0.0),
        }
    )
    kept = []
    if p_values:
        wide = wide.withColumns(
            {
                "welch_p": special.t_p("_t", "_dof"),
                "_crit": special.t_critical(F.lit(1 - alpha / 2), F.col("_dof")),
            }
        )
        kept = [
            "welch_p",
            F.coalesce(F.col("welch_p") < alpha, F.lit(False)).alias("welch_significant"),
            rounded(F.col("_gap") - F.col("_crit") * F.col("_error"), 4).alias("ci_lower"),
            rounded(F.col("_gap") + F.col("_crit") * F.col("_error"), 4).alias("ci_upper"),
        ]
    worst_skew = F.greatest(F.abs(F.col("_ka")), F.abs(F.col("_kb")))
    return wide.select(
        "n_a",
        "n_b",
        rounded(F.col("_ma"), 4).alias("mean_a"),
        rounded(F.col("_mb"), 4).alias("mean_b"),
        rounded(F.sqrt("_va"), 4).alias("sd_a"),
        rounded(F.sqrt("_vb"), 4).alias("sd_b"),
        rounded(F.col("_gap"), 4).alias("mean_difference"),
        F.when(F.col("_mb") != 0, rounded(100 * F.col("_gap") / F.col("_mb"), 2)).otherwise(0.0).alias("pct_change"),
        rounded(F.col("_t"), 4).alias("t_statistic"),
        rounded(F.col("_dof"), 1).alias("degrees_of_freedom"),
        rounded(F.col("_d"), 4).alias("cohens_d"),
        F.when(~F.isnan(worst_skew), worst_skew).alias("_skew"),
        *kept,
    )


def welch_t_test(
    df: DataFrame, metric: str, arm: str, first, second, alpha: float = DEFAULTS.alpha, p_values: bool = True
) -> DataFrame:
    """Unequal-variance t-test between two levels of ``arm``, one row."""
    arms = _arms(df, metric, arm, F.lit(first), F.lit(second))
    return _welch(arms, alpha, p_values).drop("_skew")


def _rank_test(arms: DataFrame, alpha: float, p_values: bool) -> DataFrame:
    counts = arms.groupBy("v").agg(
        F.count("*").alias("n"), tally(F.col("arm") == 1).alias("n1"), tally(F.col("arm") == 2).alias("n2")
    )
    placed = running(counts, [F.col("v").asc()], sums={"upto": "n"})
    middle_rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0
    size = F.col("n").cast("double")
    wide = placed.agg(
        F.coalesce(F.sum("n1"), F.lit(0)).cast("double").alias("_n1"),
        F.coalesce(F.sum("n2"), F.lit(0)).cast("double").alias("_n2"),
        F.sum(F.col("n1") * middle_rank).alias("_r1"),
        F.sum(size * size * size - size).alias("_ties"),
    )
    wide = wide.withColumn("_u", F.col("_r1") - F.col("_n1") * (F.col("_n1") + 1) / 2)
    medians = grouped_quantiles(arms, ["arm"], {"m": ("v", 0.5)})
    medians = medians.agg(
        F.max(F.when(F.col("arm") == 1, F.col("m"))).alias("_ma"),
        F.max(F.when(F.col("arm") == 2, F.col("m"))).alias("_mb"),
    )
    wide = merge_single_rows(wide, medians)
    enough = (F.col("_n1") >= 2) & (F.col("_n2") >= 2)
    kept = []
    if p_values:
        wide = wide.withColumn("_p", special.rank_p("_u", "_n1", "_n2", "_ties"))
        kept = [
            F.when(enough, F.col("_p")).alias("rank_p"),
            F.coalesce(enough & (F.col("_p") < alpha), F.lit(False)).alias("rank_significant"),
        ]
    biserial = 2 * F.col("_u") / (F.col("_n1") * F.col("_n2")) - 1
    return wide.select(
        F.col("_n1").cast("long").alias("n_a"),
        F.col("_n2").cast("long").alias("n_b"),
        F.when(enough, rounded(F.col("_ma"), 4)).alias("median_a"),
        F.when(enough, rounded(F.col("_mb"), 4)).alias("median_b"),
        F.when(enough, rounded(F.col("_ma") - F.col("_mb"), 4)).alias("median_difference"),
        F.when(enough, rounded(F.col("_u"), 1)).alias("u_statistic"),
        F.when(enough, rounded(biserial, 4)).alias("rank_biserial"),
        F.when(enough, F.lit(None)).otherwise("insufficient data in one group").alias("note"),
        *kept,
    )


def mann_whitney_test(
    df: DataFrame, metric: str, arm: str, first, second, alpha: float = DEFAULTS.alpha, p_values: bool = True
) -> DataFrame:
    """Rank-sum test between two levels, with mid-ranks for ties, one row.

    Ranks come from counts per distinct value accumulated over a range-partitioned
    order, so no task sees all values.
    """
    return _rank_test(_arms(df, metric, arm, F.lit(first), F.lit(second)), alpha, p_values)


def _choice(settings: Settings) -> dict[str, Column]:
    """Which test to quote, whether the tests agree, and the sentence to print."""
    enough = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    skewed = F.coalesce(F.col("_skew") > settings.skew_limit, F.lit(False))
    agree = F.col("welch_significant") == F.col("rank_significant")
    rank = F.col("rank_significant")
    skew = F.format_string("%.1f", F.coalesce("_skew", F.lit(0.0)))
    wp, rp = F.format_string("%.3e", "welch_p"), F.format_string("%.3e", "rank_p")
    verdict = (
        F.when(~enough, F.lit("Insufficient data in one group to compare."))
        .when(skewed & ~agree & rank, F.concat(F.lit("Skew "), skew, F.lit(": the tests disagree; quote the rank test (p = "), rp,
              F.lit("), outliers mask the difference from the mean test (p = "), wp, F.lit(").")))
        .when(skewed & ~agree, F.concat(F.lit("Skew "), skew, F.lit(": the means differ (p = "), wp,
              F.lit(") but the ranks do not (p = "), rp, F.lit("); report a tail effect with both numbers.")))
        .when(skewed, F.concat(F.lit("Skew "), skew, F.lit(": quote the rank test (p = "), rp, F.lit("); both agree.")))
        .otherwise(F.concat(F.lit("Skew "), skew, F.lit(": means are meaningful; Welch applies (p = "), wp, F.lit(").")))
    )
    return {
        "max_abs_skew": F.when(enough, rounded(F.col("_skew"), 2)),
        "recommended_test": F.when(~enough, "none")
        .when(~skewed, "welch")
        .when(agree | rank, "mann_whitney")
        .otherwise("both"),
        "tests_agree": F.when(enough, agree).otherwise(False),
        "verdict": verdict,
    }


def _compare_arms(arms: DataFrame, settings: Settings) -> DataFrame:
    arms = settled(arms)
    welch = _welch(arms, settings.alpha, True)
    rank = _rank_test(arms, settings.alpha, True).drop("n_a", "n_b", "note")
    return merge_single_rows(welch, rank).withColumns(_choice(settings)).drop("_skew")


def compare_continuous(
    df: DataFrame, metric: str, arm: str, first, second, settings: Settings = DEFAULTS
) -> DataFrame:
    """Both tests, the larger absolute population skew, and which result to quote."""
    return _compare_arms(_arms(df, metric, arm, F.lit(first), F.lit(second)), settings)


def continuous_comparison(
    df: DataFrame, metric: str, dimension: str = "fulfil_via", settings: Settings = DEFAULTS
) -> DataFrame:
    """A metric across the two usable levels of a dimension (best against worst).

    Adds the share of known values per arm; a metric that one arm never has is
    called structurally missing instead of being tested.
    """
    ends = _ends(settled(group_rates(df, dimension, settings.min_group_size)))
    ends = settled(ends)
    rows = usable_rows(df, dimension, settings.min_group_size)
    high, low = ends.select("best").scalar(), ends.select("worst").scalar()
    text = F.col(dimension).cast("string")
    known = F.col(metric).isNotNull().cast("int")
    coverage = rows.agg(
        rounded(F.coalesce(F.avg(F.when(text == high, known)), F.lit(0.0)), 3).alias("coverage_high"),
        rounded(F.coalesce(F.avg(F.when(text == low, known)), F.lit(0.0)), 3).alias("coverage_low"),
    )
    arms = _arms(rows.withColumn(dimension, text), metric, dimension, high, low)
    two = F.col("levels") == 2
    absent = F.least("coverage_high", "coverage_low") == 0
    missing = F.when(F.col("coverage_high") == 0, F.col("level_high")).otherwise(F.col("level_low"))
    joined = merge_single_rows(
        _compare_arms(arms, settings),
        ends.select("levels", F.col("best").alias("level_high"), F.col("worst").alias("level_low")),
        coverage,
    )
    verdict = (
        F.when(~two, F.concat(F.lit(f"Needs exactly two levels of {dimension}; found "), F.col("levels"), F.lit(".")))
        .when(absent, F.concat(F.lit(f"{metric} is structurally missing for "), missing, F.lit("; undefined.")))
        .otherwise(F.col("verdict"))
    )
    return joined.withColumns(
        {"metric": F.lit(metric), "dimension": F.lit(dimension), "verdict": verdict}
    )


# --- dimensions -----------------------------------------------------------------------
def _ends(rates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Best and worst level (ties by name), level count and totals of a rate table."""
    place = F.struct("on_time_pct", "level", "n", "late")
    best, worst = F.max(place), F.min(place)
    return rates.groupBy(*(by or [])).agg(
        F.count("*").alias("levels"),
        F.sum("n").alias("total"),
        F.sum("late").alias("total_late"),
        best["level"].alias("best"),
        best["on_time_pct"].alias("best_pct"),
        best["n"].alias("best_n"),
        best["late"].alias("best_late"),
        worst["level"].alias("worst"),
        worst["on_time_pct"].alias("worst_pct"),
        worst["n"].alias("worst_n"),
        worst["late"].alias("worst_late"),
        F.min("n").alias("least_n"),
        F.sum(F.col("late") * F.col("late") / F.col("n")).alias("late_squares"),
    )


def _with_rate_tests(ends: DataFrame, settings: Settings, p_values: bool) -> DataFrame:
    """Chi-square over all levels and the best-worst z-test, from aggregated counts."""
    total, late = F.col("total").cast("double"), F.col("total_late").cast("double")
    good = total - late
    both = (late > 0) & (good > 0)
    # sum over levels of n (rate - overall)^2 over the outcome variance
    chi2 = F.when(both, (F.col("late_squares") - late * late / total) * total * total / (late * good)).otherwise(0.0)
    least = F.col("least_n") * F.when(both, F.least(late, good)).otherwise(total) / total
    out = ends.withColumns(
        {
            "_chi2": F.greatest(chi2, F.lit(0.0)),
            "degrees_of_freedom": F.when(both, F.col("levels") - 1).otherwise(0),
            "min_expected_count": rounded(least, 1),
            "expected_counts_adequate": least >= 5,
            "_good_worst": F.col("worst_n") - F.col("worst_late"),
            "_good_best": F.col("best_n") - F.col("best_late"),
        }
    ).filter("levels >= 2")
    if p_values:
        out = out.withColumn("chi_square_p", special.chi2_p("_chi2", "degrees_of_freedom"))
    out = with_two_proportions(
        out, "_good_worst", "worst_n", "_good_best", "best_n", settings.alpha, p_values
    )
    return (
        out.withColumn("chi2_statistic", rounded(F.col("_chi2"), 4))
        .withColumn("cramers_v", rounded(F.sqrt(F.col("_chi2") / F.col("total")), 4))
        .drop("_chi2", "_good_worst", "_good_best", "late_squares", "least_n")
    )


class Comparison(NamedTuple):
    rates: DataFrame
    tests: DataFrame
    excluded: DataFrame


def compare_groups(
    df: DataFrame, dimension: str = "fulfil_via", settings: Settings = DEFAULTS, p_values: bool = True
) -> Comparison:
    """Rates per level, chi-square over all levels, z-test best against worst, verdict.

    ``tests`` is empty when fewer than two levels are usable.
    """
    rates = group_rates(df, dimension, settings.min_group_size)
    tests = _with_rate_tests(_ends(rates), settings, p_values).withColumn("dimension", F.lit(dimension))
    tests = tests.withColumn("confound", F.lit(DIMENSIONS.get(dimension)))
    if p_values:
        overall = F.when(F.col("chi_square_p") < settings.alpha, "Significant across all levels")
        overall = overall.otherwise("No significant difference across levels")
        tests = tests.withColumn(
            "verdict",
            F.concat(
                F.format_string(
                    "%s (%.2f%%) versus %s (%.2f%%) differs by %.2f points, p = %.2e. ",
                    "best", "best_pct", "worst", "worst_pct",
                    F.col("best_pct") - F.col("worst_pct"), "p_value",
                ),
                overall,
                F.format_string(" (chi-square p = %.2e).", "chi_square_p"),
            ),
        )
    return Comparison(rates, tests, levels_excluded(df, dimension, settings.min_group_size))


class Stratified(NamedTuple):
    strata: DataFrame
    summary: DataFrame


def stratified_comparison(
    df: DataFrame,
    dimension: str = "fulfil_via",
    by: str = "era",
    settings: Settings = DEFAULTS,
    p_values: bool = True,
) -> Stratified:
    """The two-level gap inside each level of a third variable.

    ``is_sign_flip`` marks a gap that reverses between strata,
    ``interaction_detected`` a gap whose range exceeds half the pooled gap (or
    that flips). A stratum counts when both arms reach the minimum size.
    """
    floor = settings.min_group_size
    rows = df.filter(_real_level(dimension, F.col(dimension)) & F.col("is_late").isNotNull())
    cells = rows.groupBy(F.col(by).alias("stratum"), F.col(dimension).cast("string").alias("level")).agg(
        F.count("*").alias("n"), whole_sum("is_late").alias("late")
    )
    cells = settled(cells)
    rates = cells.groupBy("level").agg(F.sum("n").alias("n"), F.sum("late").alias("late")).filter(
        F.col("n") >= floor
    )
    ends = settled(_ends(rates.withColumn("on_time_pct", on_time_pct(F.col("late"), F.col("n")))))
    high, low, levels = (ends.select(c).scalar() for c in ("best", "worst", "levels"))
    arms = {
        name: F.sum(F.when(F.col("level") == level, F.col(column)))
        for level, name, column in (
            (high, "n_high", "n"), (high, "late_high", "late"), (low, "n_low", "n"), (low, "late_low", "late"),
        )
    }
    wide = cells.filter(levels == 2).groupBy("stratum").agg(*[e.alias(n) for n, e in arms.items()])
    wide = wide.filter((F.col("n_high") >= floor) & (F.col("n_low") >= floor))
    rate_high = 100.0 * (1 - F.col("late_high") / F.col("n_high"))
    rate_low = 100.0 * (1 - F.col("late_low") / F.col("n_low"))
    wide = wide.withColumns(
        {
            "on_time_high": rounded(rate_high, 2),
            "on_time_low": rounded(rate_low, 2),
            "gap_pp": rounded(rate_high - rate_low, 2),
            "_good_high": F.col("n_high") - F.col("late_high"),
            "_good_low": F.col("n_low") - F.col("late_low"),
        }
    )
    tested = with_two_proportions(wide, "_good_low", "n_low", "_good_high", "n_high", settings.alpha, p_values)
    kept = ["p_value", "significant"] if p_values else []
    strata = tested.select(
        "stratum", "n_high", "n_low", "on_time_high", "on_time_low", "gap_pp", "z_statistic", *kept
    )
    strata = settled(strata)
    gap = F.col("gap_pp")
    spread = strata.agg(
        F.count("*").alias("strata"),
        (F.max(gap) - F.min(gap)).alias("_range"),
        F.coalesce(F.max(gap > 0) & F.max(gap < 0), F.lit(False)).alias("is_sign_flip"),
        F.max(gap).alias("widest_gap_pp"),
        F.min(gap).alias("narrowest_gap_pp"),
        F.max_by(F.col("stratum").cast("string"), F.struct(gap, F.col("stratum").cast("string"))).alias("widest_stratum"),
        F.min_by(F.col("stratum").cast("string"), F.struct(gap, F.col("stratum").cast("string"))).alias("narrowest_stratum"),
    )
    best_rate = 100.0 * (1 - F.col("best_late") / F.col("best_n"))
    worst_rate = 100.0 * (1 - F.col("worst_late") / F.col("worst_n"))
    pooled = ends.select(
        "levels",
        F.col("best").alias("level_high"),
        F.col("worst").alias("level_low"),
        F.col("best_n").alias("n_high"),
        F.col("worst_n").alias("n_low"),
        rounded(best_rate, 2).alias("on_time_high"),
        rounded(worst_rate, 2).alias("on_time_low"),
        (best_rate - worst_rate).alias("_pooled"),
    )
    summary = merge_single_rows(pooled, spread)
    two = (F.col("levels") == 2) & (F.col("strata") > 0)
    interaction = (F.col("_range") > F.abs(F.col("_pooled")) * 0.5) | F.col("is_sign_flip")
    signed = "%+.2f"
    verdict = (
        F.when(F.col("levels") != 2, F.concat(F.lit(f"Needs exactly two levels of {dimension}; found "), "levels", F.lit(".")))
        .when(F.col("strata") == 0, F.lit(f"No stratum of {by} has enough data in both groups."))
        .when(F.col("is_sign_flip"), F.concat(F.lit(f"Which level is ahead depends on {by}, so the pooled "),
              F.format_string(signed, "_pooled"), F.lit(" pp is no answer.")))
        .when(F.col("interaction_detected"), F.concat(F.lit("Pooled over all strata the gap is "), F.format_string(signed, "_pooled"),
              F.lit(f" pp, yet by {by} it runs from "), F.format_string(signed, "narrowest_gap_pp"), F.lit(" to "),
              F.format_string(signed, "widest_gap_pp"), F.lit(" pp.")))
        .otherwise(F.concat(F.lit(f"Every {by} shows about the same gap; one figure, "), F.format_string(signed, "_pooled"),
              F.lit(" pp, stands for all.")))
    )
    summary = summary.withColumns(
        {
            "pooled_gap_pp": F.when(two, rounded(F.col("_pooled"), 2)),
            "gap_range_pp": F.when(two, rounded(F.col("_range"), 2)),
            "interaction_detected": F.coalesce(two & interaction, F.lit(False)),
            "is_sign_flip": F.coalesce(two & F.col("is_sign_flip"), F.lit(False)),
        }
    ).withColumn("verdict", verdict)
    return Stratified(strata.orderBy("stratum"), summary.drop("_range", "_pooled"))


def dimension_rates(
    df: DataFrame, dimensions: list[str] | None = None, min_size: int = DEFAULTS.min_group_size
) -> DataFrame:
    """Rates of every usable level of several dimensions from one pass."""
    names = [d for d in (dimensions or DIMENSIONS) if d in df.columns]
    cells = F.array(
        *[
            F.struct(
                F.lit(d).alias("dimension"),
                F.when(_real_level(d, F.col(d)), F.col(d).cast("string")).alias("level"),
            )
            for d in names
        ]
    )
    rows = df.filter(F.col("is_late").isNotNull()).select("is_late", F.explode(cells).alias("c"))
    rates = (
        rows.filter("c.level is not null")
        .groupBy("c.dimension", "c.level")
        .agg(F.count("*").alias("n"), whole_sum("is_late").alias("late"))
        .filter(F.col("n") >= min_size)
    )
    return rates.withColumn("on_time_pct", on_time_pct(F.col("late"), F.col("n")))


def comparison_catalogue(
    df: DataFrame,
    dimensions: list[str] | None = None,
    settings: Settings = DEFAULTS,
    p_values: bool = True,
) -> DataFrame:
    """Every dimension with best and worst level and tests, widest gap first."""
    ends = _ends(dimension_rates(df, dimensions, settings.min_group_size), ["dimension"])
    out = _with_rate_tests(ends, settings, p_values)
    kept = []
    if p_values:
        out = out.withColumn("significant", F.col("chi_square_p") < settings.alpha)
        kept = ["chi_square_p", "significant"]
    confound = F.element_at(
        F.create_map(*[F.lit(x) for pair in DIMENSIONS.items() for x in pair]), F.col("dimension")
    )
    return out.select(
        "dimension",
        "levels",
        F.format_string("%s (%.1f%%)", "best", rounded(F.col("best_pct"), 1)).alias("best"),
        F.format_string("%s (%.1f%%)", "worst", rounded(F.col("worst_pct"), 1)).alias("worst"),
        rounded(F.col("best_pct") - F.col("worst_pct"), 2).alias("gap_pp"),
        "chi2_statistic",
        "cramers_v",
        "min_expected_count",
        "expected_counts_adequate",
        *kept,
        confound.alias("confound"),
    ).orderBy(F.col("gap_pp").desc(), "dimension")


# --- power, value and decision ------------------------------------------------------------
def with_power(frame: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Achieved power, smallest detectable gap and rows needed, per comparison row.

    Reads ``p_control``/``p_treatment`` counts: ``worst_n``, ``worst_late``,
    ``best_n``, ``best_late``, ``total``, ``total_late``.
    """
    alpha, power = F.lit(settings.alpha), F.lit(settings.power)
    p1 = 1 - F.col("worst_late") / F.col("worst_n")
    p2 = 1 - F.col("best_late") / F.col("best_n")
    h = 2 * F.asin(F.sqrt(p2)) - 2 * F.asin(F.sqrt(p1))
    baseline = 1 - F.col("total_late") / F.col("total")
    target = F.least(p1 * (1 + settings.practical_lift_pct / 100.0), F.lit(1.0))
    out = frame.withColumns(
        {
            "cohens_h": rounded(h, 4),
            "_power": special.power_of(h, "worst_n", "best_n", alpha),
            "mde_pp": rounded(special.detectable(baseline, "worst_n", "best_n", alpha, power), 3),
            "n_required": special.arm_size(p1, target, alpha, power).cast("long"),
            "n_available": F.least("worst_n", "best_n"),
        }
    )
    return out.withColumn("achieved_power", F.when(h == 0, 0.0).otherwise(rounded(F.col("_power"), 4))).drop("_power")


def with_penalty_value(
    frame: DataFrame, gap: str = "absolute_diff", exposed: Column | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Yearly value of closing the gap at the configured penalty per late shipment."""
    yearly = F.col("total") / settings.years_covered if exposed is None else exposed
    return frame.withColumns(
        {
            "annual_shipments": rounded(yearly, 0),
            "annual_value_usd": rounded(yearly * F.abs(F.col(gap)) * settings.late_shipment_penalty, 0),
        }
    )


def with_decision(frame: DataFrame, settings: Settings = DEFAULTS, with_mde: bool = True) -> DataFrame:
    """Act, monitor, decline or call the null, from significance, lift, power and bound.

    A null is judged on the smallest detectable gap, never on achieved power.
    """
    real = F.col("significant")
    lift = F.abs(F.col("relative_lift_pct"))
    matters = lift >= settings.practical_lift_pct
    powered = F.col("achieved_power") >= settings.power
    threshold = F.abs(F.col("p_control")) * settings.practical_lift_pct
    bounded = F.abs(F.col("mde_pp")) <= threshold if with_mde else F.lit(None).cast("boolean")
    null = ~real & F.lit(with_mde)
    verdict = (
        F.when(null & bounded, "NO EFFECT")
        .when(null, "NO EFFECT (BOUNDED)")
        .when(real & matters & powered, "ACT")
        .when(real & matters, "ACT WITH MONITORING")
        .when(real, "DO NOT ACT")
        .otherwise("INCONCLUSIVE")
    )
    confidence = (
        F.when(F.col("decision").isin("NO EFFECT", "ACT", "DO NOT ACT"), "High")
        .when(F.col("decision").isin("NO EFFECT (BOUNDED)", "ACT WITH MONITORING"), "Medium")
        .otherwise("Low")
    )
    gap = F.format_string("%+.2f", "absolute_diff_pp")
    p = F.format_string("%.2e", "p_value")
    mde = F.format_string("%.2f", F.abs(F.col("mde_pp"))) if with_mde else F.lit("")
    because = (
        F.when(F.col("decision") == "ACT", F.concat(F.lit("The gap of "), gap, F.lit(" pp is significant (p = "), p,
               F.lit(") and large enough to matter.")))
        .when(F.col("decision") == "ACT WITH MONITORING", F.concat(F.lit("Significant (p = "), p,
               F.lit(") and large, but the power is below target; act on a limited scope.")))
        .when(F.col("decision") == "DO NOT ACT", F.concat(F.lit("Real (p = "), p, F.lit(") but a "),
               F.format_string("%.1f", lift), F.lit("% difference is too small to pay for a change.")))
        .when(F.col("decision") == "INCONCLUSIVE", F.concat(F.lit("Not significant (p = "), p,
               F.lit(") and no detectable bound is known.")))
        .otherwise(F.concat(F.lit("Not significant (p = "), p, F.lit("); a gap above "), mde,
               F.lit(" points would have been seen.")))
    )
    return (
        frame.withColumn("decision", verdict)
        .withColumn("confidence", confidence)
        .withColumn("practical_significance_met", F.coalesce(matters, F.lit(False)))
        .withColumn("adequately_powered", F.coalesce(powered, F.lit(False)))
        .withColumn("practical_threshold_pp", rounded(threshold, 3))
        .withColumn("rationale", because)
    )


def decision_table(
    df: DataFrame, dimensions: list[str] | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Every dimension with test, power, bound, yearly value and decision."""
    ends = _ends(dimension_rates(df, dimensions, settings.min_group_size), ["dimension"])
    tested = _with_rate_tests(settled(ends), settings, True)
    out = with_decision(with_penalty_value(with_power(tested, settings), settings=settings), settings)
    return out.orderBy(F.abs("absolute_diff_pp").desc(), "dimension")

