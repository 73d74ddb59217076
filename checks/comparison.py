"""Statistical comparison beside its SQL.

SQL has no tail functions here, so the compared queries leave out p-values and
what is read off them; the full forms are registered without SQL and p-values
are tested against published anchors.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks.base import SHIP, also, over, rnd
from dockline.config import DEFAULTS
from dockline.operators import comparison
from dockline.operators.ingest import with_era
from dockline.sources import tables as t

QUERIES = {}
ORACLES = {}
CRIT = "1.959963984540054"


def add(name, build, sql=None):
    QUERIES[name] = build
    if sql is not None:
        ORACLES[name] = sql


def _dated(spark, folder):
    return with_era(t.stored_shipments(spark, folder), t.ERA_CUTOFF)


def _rows(operator, **kwargs):
    return lambda spark, folder: operator(_dated(spark, folder), **kwargs)


ERA = "dated AS (SELECT *, CASE WHEN delivery_year <= 1998 THEN 'early' ELSE 'late' END AS era FROM ship)"


def rates_sql(dimension: str, excluded: str = "''") -> str:
    return f"""SELECT {dimension} AS level, count(*) AS n, CAST(sum(is_late) AS BIGINT) AS late,
      {rnd('avg(delivery_delay_days)', 2)} AS mean_delay_days,
      {rnd('100 * (1 - CAST(sum(is_late) AS BIGINT) / count(*))', 2)} AS on_time_pct
    FROM dated WHERE {dimension} IS NOT NULL AND is_late IS NOT NULL AND {dimension} NOT IN ({excluded})
    GROUP BY 1 HAVING count(*) >= 30"""


def z_sql(x1: str, n1: str, x2: str, n2: str) -> str:
    """Column list of the two-proportion test from four count expressions."""
    p1, p2 = f"(CAST({x1} AS DOUBLE) / {n1})", f"(CAST({x2} AS DOUBLE) / {n2})"
    pool = f"(CAST({x1} + {x2} AS DOUBLE) / ({n1} + {n2}))"
    gap = f"({p2} - {p1})"
    err = f"sqrt({p2} * (1 - {p2}) / {n2} + {p1} * (1 - {p1}) / {n1})"

    def wilson(p, n, sign):
        return (
            f"({p} + {CRIT}*{CRIT} / (2.0 * {n}) {sign} {CRIT} * sqrt({p} * (1 - {p}) / {n} + "
            f"{CRIT}*{CRIT} / (4.0 * {n} * {n}))) / (1 + {CRIT}*{CRIT} / {n})"
        )

    return f"""{rnd(p1, 5)} AS p_control, {rnd(p2, 5)} AS p_treatment, {rnd(gap, 5)} AS absolute_diff,
      {rnd(f'100 * {gap}', 3)} AS absolute_diff_pp, {rnd(f'100 * {gap} / {p1}', 3)} AS relative_lift_pct,
      {rnd(f'{gap} / sqrt({pool} * (1 - {pool}) * (1.0 / {n1} + 1.0 / {n2}))', 4)} AS z_statistic,
      {rnd(f'{gap} - {CRIT} * {err}', 5)} AS ci_lower, {rnd(f'{gap} + {CRIT} * {err}', 5)} AS ci_upper,
      {rnd(f'100 * ({gap} - {CRIT} * {err})', 3)} AS ci_lower_pp, {rnd(f'100 * ({gap} + {CRIT} * {err})', 3)} AS ci_upper_pp,
      {rnd(wilson(p1, n1, '-'), 5)} AS control_ci_lower, {rnd(wilson(p1, n1, '+'), 5)} AS control_ci_upper,
      {rnd(wilson(p2, n2, '-'), 5)} AS treatment_ci_lower, {rnd(wilson(p2, n2, '+'), 5)} AS treatment_ci_upper"""


add("group_rates", _rows(comparison.group_rates, dimension="fulfil_via"), also(ERA + " ", rates_sql("fulfil_via")))
add(
    "group_rates_real_modes",
    _rows(comparison.group_rates, dimension="shipment_mode"),
    also(ERA + " ", rates_sql("shipment_mode", "'Unknown'")),
)
add(
    "usable_comparison_rows",
    lambda spark, folder: comparison.usable_rows(_dated(spark, folder), "shipment_mode", 500)
    .groupBy("shipment_mode", "era")
    .agg(F.count("*").alias("n")),
    also(
        ERA,
        """, u AS (SELECT * FROM dated WHERE shipment_mode <> 'Unknown' AND is_late IS NOT NULL)
        SELECT shipment_mode, era, count(*) AS n FROM u WHERE shipment_mode IN
          (SELECT shipment_mode FROM u GROUP BY 1 HAVING count(*) >= 500) GROUP BY ALL""",
    ),
)
add(
    "levels_excluded",
    lambda spark, folder: comparison.levels_excluded(_dated(spark, folder), "shipment_mode"),
    also(
        ERA,
        f""" SELECT DISTINCT shipment_mode AS level FROM dated WHERE shipment_mode NOT IN
        (SELECT level FROM ({rates_sql('shipment_mode', "'Unknown'")}))""",
    ),
)

# --- tests -------------------------------------------------------------------------
COUNTS = """c AS (SELECT count_if(fulfil_via = 'From RDC' AND is_late = 0) AS hits_control, count_if(fulfil_via = 'From RDC') AS n_control,
  count_if(fulfil_via <> 'From RDC' AND is_late = 0) AS hits_treatment, count_if(fulfil_via <> 'From RDC') AS n_treatment
  FROM ship WHERE is_late IS NOT NULL)"""


def _two_proportions(p_values):
    def build(spark, folder):
        rows = t.stored_shipments(spark, folder).filter("is_late is not null")
        return comparison.two_proportion_test(
            rows, F.col("is_late") == 0, F.col("fulfil_via") != "From RDC", p_values=p_values
        )

    return build


add(
    "two_proportion_z_test",
    _two_proportions(False),
    also(COUNTS, f" SELECT c.*, {z_sql('hits_control', 'n_control', 'hits_treatment', 'n_treatment')} FROM c"),
)
add("two_proportion_z_test_p_value", _two_proportions(True))


def chi_sql(group: str, outcome: str) -> str:
    return f"""cells AS (SELECT g, o, count(b.g2) AS n FROM (SELECT DISTINCT {group} AS g FROM dated WHERE {group} IS NOT NULL AND {outcome} IS NOT NULL)
        CROSS JOIN (SELECT DISTINCT {outcome} AS o FROM dated WHERE {outcome} IS NOT NULL AND {group} IS NOT NULL)
        LEFT JOIN (SELECT {group} AS g2, {outcome} AS o2 FROM dated) b ON g = g2 AND o = o2 GROUP BY g, o),
      e AS (SELECT *, CAST(sum(n) OVER (PARTITION BY g) AS DOUBLE) * sum(n) OVER (PARTITION BY o) / sum(n) OVER () AS e FROM cells)
      SELECT {rnd('sum((n - e) * (n - e) / e)', 4)} AS chi2_statistic,
        (count(DISTINCT g) - 1) * (count(DISTINCT o) - 1) AS degrees_of_freedom,
        {rnd('sqrt(sum((n - e) * (n - e) / e) / (sum(n) * (least(count(DISTINCT g), count(DISTINCT o)) - 1)))', 4)} AS cramers_v,
        {rnd('min(e)', 1)} AS min_expected_count, min(e) >= 5 AS expected_counts_adequate, CAST(sum(n) AS BIGINT) AS n FROM e"""


for _name, _group, _outcome in (
    ("chi_square_mode_late", "shipment_mode", "is_late"),
    ("chi_square_route_late", "fulfil_via", "is_late"),
    ("chi_square_sparse_table", "brand", "inco_term"),
    ("chi_square_empty_cells", "dosage", "product_group"),
):
    add(
        _name,
        _rows(comparison.chi_square_test, group=_group, outcome=_outcome, p_values=False),
        also(ERA + ", ", chi_sql(_group, _outcome)),
    )
add("chi_square_p_value", _rows(comparison.chi_square_test, group="shipment_mode", outcome="is_late"))
MODES = ["Air", "Air Charter", "Ocean", "Truck", "Unknown"]
add(
    "contingency_counts",
    _rows(comparison.crosstab, group="dosage_form", outcome="shipment_mode", levels=MODES),
    over(
        "SELECT dosage_form, "
        + ", ".join(f"count_if(shipment_mode = '{m}') AS \"{m}\"" for m in MODES)
        + " FROM ship GROUP BY 1"
    ),
)
add(
    "contingency_shares",
    _rows(comparison.crosstab, group="dosage_form", outcome="shipment_mode", levels=MODES, shares=True),
    over(
        "SELECT dosage_form, "
        + ", ".join(
            f"{rnd(f'''CAST(count_if(shipment_mode = '{m}') AS DOUBLE) / count(*)''', 3)} AS \"{m}\"" for m in MODES
        )
        + " FROM ship GROUP BY 1"
    ),
)


def arms_sql(metric: str, arm: str, first: str, second: str) -> str:
    return f"""arms AS (SELECT CASE WHEN {arm} = '{first}' THEN 1 ELSE 2 END AS arm, CAST({metric} AS DOUBLE) AS v
      FROM dated WHERE {arm} IN ('{first}', '{second}') AND {metric} IS NOT NULL)"""


WELCH = f"""s AS (SELECT count(*) FILTER (arm = 1) AS n1, count(*) FILTER (arm = 2) AS n2, avg(v) FILTER (arm = 1) AS m1,
    avg(v) FILTER (arm = 2) AS m2, var_samp(v) FILTER (arm = 1) AS v1, var_samp(v) FILTER (arm = 2) AS v2 FROM arms)
  SELECT n1 AS n_a, n2 AS n_b, {rnd('m1', 4)} AS mean_a, {rnd('m2', 4)} AS mean_b, {rnd('sqrt(v1)', 4)} AS sd_a,
    {rnd('sqrt(v2)', 4)} AS sd_b, {rnd('m1 - m2', 4)} AS mean_difference, {rnd('100 * (m1 - m2) / m2', 2)} AS pct_change,
    {rnd('(m1 - m2) / sqrt(v1 / n1 + v2 / n2)', 4)} AS t_statistic,
    {rnd('(v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1))', 1)} AS degrees_of_freedom,
    {rnd('(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))', 4)} AS cohens_d FROM s"""
RANKS = f"""r AS (SELECT arm, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM arms),
  s AS (SELECT count(*) FILTER (arm = 1) AS n1, count(*) FILTER (arm = 2) AS n2, sum(rk) FILTER (arm = 1) AS r1,
    quantile_cont(v, 0.5) FILTER (arm = 1) AS m1, quantile_cont(v, 0.5) FILTER (arm = 2) AS m2 FROM r),
  u AS (SELECT *, r1 - CAST(n1 AS DOUBLE) * (n1 + 1) / 2 AS u FROM s)
  SELECT n1 AS n_a, n2 AS n_b, {rnd('m1', 4)} AS median_a, {rnd('m2', 4)} AS median_b, {rnd('m1 - m2', 4)} AS median_difference,
    {rnd('u', 1)} AS u_statistic, {rnd('2 * u / (CAST(n1 AS DOUBLE) * n2) - 1', 4)} AS rank_biserial, NULL::VARCHAR AS note FROM u"""
for _label, _metric, _arm, _a, _b in (
    ("delay_by_route", "delivery_delay_days", "fulfil_via", "Direct Drop", "From RDC"),
    ("freight_share_by_group", "freight_pct_of_value", "product_group", "ARV", "HRDT"),
):
    _args = {"metric": _metric, "arm": _arm, "first": _a, "second": _b}
    _cte = ERA + ", " + arms_sql(_metric, _arm, _a, _b) + ", "
    add(f"welch_t_test_{_label}", _rows(comparison.welch_t_test, **_args, p_values=False), also(_cte, WELCH))
    add(f"mann_whitney_test_{_label}", _rows(comparison.mann_whitney_test, **_args, p_values=False), also(_cte, RANKS))
    add(f"compare_continuous_{_label}", _rows(comparison.compare_continuous, **_args))

_skew_cte = ERA + ", " + arms_sql("freight_pct_of_value", "product_group", "ARV", "HRDT")


def _choice_inputs(spark, folder):
    both = comparison.compare_continuous(
        _dated(spark, folder), "freight_pct_of_value", "product_group", "ARV", "HRDT"
    )
    return both.select("n_a", "n_b", "max_abs_skew")


def _pop_skew(arm: int) -> str:
    v = f"CASE WHEN arm = {arm} THEN v END"
    return f"(SELECT avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), 1.5) FROM arms, (SELECT avg({v}) AS m FROM arms) WHERE arm = {arm})"


add(
    "test_choice_inputs",
    _choice_inputs,
    also(
        _skew_cte,
        f" SELECT count_if(arm = 1) AS n_a, count_if(arm = 2) AS n_b, {rnd(f'greatest(abs({_pop_skew(1)}), abs({_pop_skew(2)}))', 2)} AS max_abs_skew FROM arms",
    ),
)
add(
    "continuous_comparison_lead_time",
    lambda spark, folder: comparison.continuous_comparison(_dated(spark, folder), "vendor_lead_time_days"),
)
add(
    "continuous_comparison_coverage",
    lambda spark, folder: comparison.continuous_comparison(_dated(spark, folder), "total_lead_time_days").select(
        "level_high", "level_low", "coverage_high", "coverage_low"
    ),
    also(
        ERA,
        f""", r AS ({rates_sql('fulfil_via')}),
        hi AS (SELECT level FROM r ORDER BY on_time_pct DESC, level DESC LIMIT 1),
        lo AS (SELECT level FROM r ORDER BY on_time_pct, level LIMIT 1)
        SELECT (SELECT level FROM hi) AS level_high, (SELECT level FROM lo) AS level_low,
          {rnd('avg(CAST(total_lead_time_days IS NOT NULL AS INTEGER)) FILTER (fulfil_via = (SELECT level FROM hi))', 3)} AS coverage_high,
          {rnd('avg(CAST(total_lead_time_days IS NOT NULL AS INTEGER)) FILTER (fulfil_via = (SELECT level FROM lo))', 3)} AS coverage_low
        FROM dated WHERE is_late IS NOT NULL""",
    ),
)

# --- dimensions -----------------------------------------------------------------------
DIMENSIONS = ["fulfil_via", "shipment_mode", "region", "first_line_designation", "product_group", "era"]
ALL_RATES = "all_rates AS (" + " UNION ALL ".join(
    "SELECT '{d}' AS dimension, * FROM ({s})".format(
        d=d, s=rates_sql(d, "'Unknown'" if d == "shipment_mode" else "''")
    )
    for d in DIMENSIONS
) + f"""), ends AS (SELECT dimension, count(*) AS levels, CAST(sum(n) AS BIGINT) AS total, CAST(sum(late) AS BIGINT) AS total_late,
    arg_max(level, (on_time_pct, level)) AS best, arg_min(level, (on_time_pct, level)) AS worst,
    arg_max(on_time_pct, (on_time_pct, level)) AS best_pct, arg_min(on_time_pct, (on_time_pct, level)) AS worst_pct,
    arg_max(n, (on_time_pct, level)) AS best_n, arg_min(n, (on_time_pct, level)) AS worst_n,
    arg_max(late, (on_time_pct, level)) AS best_late, arg_min(late, (on_time_pct, level)) AS worst_late
    FROM all_rates GROUP BY 1 HAVING count(*) >= 2),
  parts AS (SELECT r.dimension, n, late, n * CAST(total_late AS DOUBLE) / total AS el, n * CAST(total - total_late AS DOUBLE) / total AS eg
    FROM all_rates r JOIN ends USING (dimension)),
  chi AS (SELECT dimension, sum((late - el) * (late - el) / el + (n - late - eg) * (n - late - eg) / eg) AS chi2,
    min(least(el, eg)) AS least_e FROM parts GROUP BY 1)"""
add(
    "comparison_catalogue",
    _rows(comparison.comparison_catalogue, p_values=False),
    also(
        f"{ERA}, {ALL_RATES} ",
        f"""SELECT ends.dimension, levels, printf('%s (%.1f%%)', best, {rnd('best_pct', 1)}) AS best, printf('%s (%.1f%%)', worst, {rnd('worst_pct', 1)}) AS worst,
          {rnd('best_pct - worst_pct', 2)} AS gap_pp, {rnd('chi2', 4)} AS chi2_statistic, {rnd('sqrt(chi2 / total)', 4)} AS cramers_v,
          {rnd('least_e', 1)} AS min_expected_count, least_e >= 5 AS expected_counts_adequate, CASE ends.dimension """
        + " ".join(f"WHEN '{d}' THEN '{text}'" for d, text in comparison.DIMENSIONS.items())
        + " END AS confound FROM ends JOIN chi ON ends.dimension = chi.dimension",
    ),
)
add("comparison_catalogue_p_values", _rows(comparison.comparison_catalogue))
add(
    "dimension_comparison",
    lambda spark, folder: comparison.compare_groups(_dated(spark, folder), "shipment_mode", p_values=False).tests,
    also(
        f"{ERA}, {ALL_RATES} ",
        f"""SELECT ends.*, levels - 1 AS degrees_of_freedom, {rnd('least_e', 1)} AS min_expected_count,
          least_e >= 5 AS expected_counts_adequate, {z_sql('(worst_n - worst_late)', 'worst_n', '(best_n - best_late)', 'best_n')},
          {rnd('chi2', 4)} AS chi2_statistic, {rnd('sqrt(chi2 / total)', 4)} AS cramers_v,
          '{comparison.DIMENSIONS['shipment_mode']}' AS confound
        FROM ends JOIN chi ON ends.dimension = chi.dimension WHERE ends.dimension = 'shipment_mode'""",
    ),
)
add(
    "dimension_comparison_verdict",
    lambda spark, folder: comparison.compare_groups(_dated(spark, folder), "region").tests,
)
STRATA = f"""{ERA}, r AS ({rates_sql('fulfil_via')}),
  e AS (SELECT arg_max(level, (on_time_pct, level)) AS high, arg_min(level, (on_time_pct, level)) AS low, count(*) AS levels,
    arg_max(n, (on_time_pct, level)) AS n_high, arg_min(n, (on_time_pct, level)) AS n_low,
    100.0 * (1 - arg_max(late, (on_time_pct, level)) / arg_max(n, (on_time_pct, level)))
      - 100.0 * (1 - arg_min(late, (on_time_pct, level)) / arg_min(n, (on_time_pct, level))) AS pooled, max(on_time_pct) AS on_high, min(on_time_pct) AS on_low FROM r),
  w AS (SELECT era AS stratum, count_if(fulfil_via = high) AS n_high, count_if(fulfil_via = low) AS n_low,
    count_if(fulfil_via = high AND is_late = 1) AS late_high, count_if(fulfil_via = low AND is_late = 1) AS late_low
    FROM dated, e WHERE is_late IS NOT NULL GROUP BY 1),
  strata AS (SELECT stratum, n_high, n_low, {rnd('100.0 * (1 - late_high / n_high)', 2)} AS on_time_high,
    {rnd('100.0 * (1 - late_low / n_low)', 2)} AS on_time_low,
    {rnd('100.0 * (1 - late_high / n_high) - 100.0 * (1 - late_low / n_low)', 2)} AS gap_pp,
    {rnd('''(CAST(n_high - late_high AS DOUBLE) / n_high - CAST(n_low - late_low AS DOUBLE) / n_low) /
      sqrt((CAST(n_high - late_high + n_low - late_low AS DOUBLE) / (n_high + n_low)) *
           (1 - CAST(n_high - late_high + n_low - late_low AS DOUBLE) / (n_high + n_low)) * (1.0 / n_low + 1.0 / n_high))''', 4)} AS z_statistic
    FROM w WHERE n_high >= 30 AND n_low >= 30) """
add(
    "stratified_comparison",
    lambda spark, folder: comparison.stratified_comparison(_dated(spark, folder), p_values=False).strata,
    also(STRATA, "SELECT * FROM strata"),
)
add(
    "stratified_summary",
    lambda spark, folder: comparison.stratified_comparison(_dated(spark, folder), p_values=False).summary.drop("verdict"),
    also(
        STRATA,
        f"""SELECT any_value(levels) AS levels, any_value(high) AS level_high, any_value(low) AS level_low, any_value(e.n_high) AS n_high,
          any_value(e.n_low) AS n_low, count(*) AS strata, max(gap_pp) > 0 AND min(gap_pp) < 0 AS is_sign_flip,
          max(gap_pp) AS widest_gap_pp, min(gap_pp) AS narrowest_gap_pp,
          arg_max(stratum, (gap_pp, stratum)) AS widest_stratum, arg_min(stratum, (gap_pp, stratum)) AS narrowest_stratum,
          any_value(on_high) AS on_time_high, any_value(on_low) AS on_time_low, {rnd('any_value(pooled)', 2)} AS pooled_gap_pp,
          {rnd('max(gap_pp) - min(gap_pp)', 2)} AS gap_range_pp,
          (max(gap_pp) - min(gap_pp) > 0.5 * abs(any_value(pooled))) OR (max(gap_pp) > 0 AND min(gap_pp) < 0) AS interaction_detected
        FROM strata, e""",
    ),
)
add(
    "stratified_gaps_by_region",
    lambda spark, folder: comparison.stratified_comparison(
        _dated(spark, folder), by="region", p_values=False
    ).strata,
    also(STRATA.replace("SELECT era AS stratum", "SELECT region AS stratum"), "SELECT * FROM strata"),
)
add("stratified_by_region", lambda spark, folder: comparison.stratified_comparison(_dated(spark, folder), by="region").strata)
add(
    "penalty_value",
    lambda spark, folder: comparison.with_penalty_value(
        comparison.compare_groups(_dated(spark, folder), "era", p_values=False).tests
    ).select("dimension", "annual_shipments", "annual_value_usd"),
    also(
        f"{ERA}, {ALL_RATES} ",
        f"""SELECT dimension, {rnd('total / 10.0', 0)} AS annual_shipments,
          {rnd(f'total / 10.0 * abs({rnd("CAST(best_n - best_late AS DOUBLE) / best_n - CAST(worst_n - worst_late AS DOUBLE) / worst_n", 5)}) * 1850.0', 0)} AS annual_value_usd
        FROM ends WHERE dimension = 'era'""",
    ),
)
add("decision_table", _rows(comparison.decision_table))
add(
    "power_and_detectable_gap",
    lambda spark, folder: comparison.decision_table(
        _dated(spark, folder), settings=replace(DEFAULTS, practical_lift_pct=5.0)
    ).select("dimension", "cohens_h", "achieved_power", "mde_pp", "n_required", "n_available", "decision"),
)
