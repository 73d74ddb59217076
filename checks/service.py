"""Scans, ingestion, scorecards and funnels beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import also, money, over, rnd, whole
from dockline.operators import filters, funnels, ingest, service
from dockline.sources import files
from dockline.sources import tables as t

QUERIES = {}
ORACLES = {}

DATES = ("date_pq_sent", "date_po_sent", "date_scheduled", "date_delivered", "date_recorded")


def add(name, build, sql=None):
    QUERIES[name] = build
    if sql is not None:
        ORACLES[name] = sql


def _ship(operator, **kwargs):
    return lambda spark, folder: operator(t.stored_shipments(spark, folder), **kwargs)


def _interpreted(spark, folder) -> DataFrame:
    """Text file read as published, then interpreted."""
    return ingest.interpret(t.stored_published(spark, folder), t.region_dimension(spark, folder))


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in DATES if c in df.columns})


# --- scans and row gates -------------------------------------------------------
add(
    "row_count_gate",
    lambda spark, folder: files.row_count_gate(
        {n: t.table(spark, folder, n) for n in ("nation", "region", "supplier")},
        {"nation": 25, "region": 5, "supplier": 7, "warehouse": 3},
    ),
    """SELECT d.dataset, d.n AS rows, d.expected,
         CASE WHEN d.n IS NULL THEN 'MISSING' WHEN d.n = d.expected THEN 'ok'
              ELSE 'ROW COUNT MISMATCH' END AS status
       FROM (SELECT 'nation' AS dataset, count(*) AS n, 25::BIGINT AS expected FROM nation UNION ALL
             SELECT 'region', count(*), 5 FROM region UNION ALL
             SELECT 'supplier', count(*), 7 FROM supplier UNION ALL
             SELECT 'warehouse', NULL, 3) d""",
)
add(
    "parquet_scan_by_segment",
    lambda spark, folder: t.table(spark, folder, "customer")
    .groupBy("c_mktsegment")
    .agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key")),
    "SELECT c_mktsegment, count(*) AS n, min(c_custkey) AS first_key FROM customer GROUP BY 1",
)

# --- ingestion -----------------------------------------------------------------
_date_list = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in DATES)
add(
    "interpreted_shipments",
    lambda spark, folder: _dates_as_text(_interpreted(spark, folder)),
    over(f"SELECT * EXCLUDE ({', '.join(DATES)}), {_date_list} FROM ship"),
)
add(
    "date_parsing_with_reasons",
    lambda spark, folder: _dates_as_text(
        _interpreted(spark, folder).select(
            "shipment_id", "po_number", *DATES, *[f"{c}_reason" for c in DATES]
        )
    ),
    over(
        f"SELECT shipment_id, po_number, {_date_list}, "
        + ", ".join(f"{c}_reason" for c in DATES)
        + " FROM ship"
    ),
)
add(
    "number_parsing_with_reasons",
    lambda spark, folder: _interpreted(spark, folder).select(
        "shipment_id", "po_number", "freight_cost_usd", "freight_cost_reason", "weight_kg", "weight_reason"
    ),
    over(
        "SELECT shipment_id, po_number, freight_cost_usd, freight_cost_reason, weight_kg, weight_reason FROM ship"
    ),
)
add(
    "renamed_and_trimmed_columns",
    lambda spark, folder: _interpreted(spark, folder)
    .groupBy("vendor", "shipment_mode", "inco_term", "managed_by")
    .agg(F.count("*").alias("n")),
    over("SELECT vendor, shipment_mode, inco_term, managed_by, count(*) AS n FROM ship GROUP BY ALL"),
)
add(
    "unknown_level_for_null_mode",
    lambda spark, folder: _interpreted(spark, folder).groupBy("shipment_mode").agg(F.count("*").alias("n")),
    """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Air' WHEN '2-HIGH' THEN 'Air Charter'
         WHEN '3-MEDIUM' THEN 'Truck' WHEN '5-LOW' THEN 'Ocean' ELSE 'Unknown' END AS shipment_mode,
         count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
add(
    "country_region_lookup",
    lambda spark, folder: _interpreted(spark, folder).groupBy("country", "region").agg(F.count("*").alias("n")),
    over("SELECT country, region, count(*) AS n FROM ship GROUP BY ALL"),
)
add(
    "product_name_lookup",
    lambda spark, folder: _interpreted(spark, folder)
    .groupBy("product_group", "product_group_name")
    .agg(F.count("*").alias("n")),
    over("SELECT product_group, product_group_name, count(*) AS n FROM ship GROUP BY ALL"),
)
add(
    "route_flag",
    lambda spark, folder: _interpreted(spark, folder).groupBy("fulfil_via", "is_from_rdc").agg(F.count("*").alias("n")),
    over("SELECT fulfil_via, is_from_rdc, count(*) AS n FROM ship GROUP BY ALL"),
)
add(
    "delay_and_late_flag",
    lambda spark, folder: _interpreted(spark, folder)
    .groupBy("delivery_delay_days", "is_late")
    .agg(F.count("*").alias("n")),
    over("SELECT delivery_delay_days, is_late, count(*) AS n FROM ship GROUP BY ALL"),
)
LEADS = ("vendor_lead_time_days", "total_lead_time_days", "recording_lag_days", "scheduled_lead_time_days")
add(
    "lead_times",
    lambda spark, folder: _interpreted(spark, folder).groupBy(*LEADS).agg(F.count("*").alias("n")),
    over(f"SELECT {', '.join(LEADS)}, count(*) AS n FROM ship GROUP BY ALL"),
)
add(
    "guarded_ratios",
    lambda spark, folder: _interpreted(spark, folder).select(
        "shipment_id", "po_number", "freight_pct_of_value", "freight_cost_per_kg"
    ),
    over("SELECT shipment_id, po_number, freight_pct_of_value, freight_cost_per_kg FROM ship"),
)
add(
    "packs_and_units",
    lambda spark, folder: _interpreted(spark, folder)
    .groupBy("product_group")
    .agg(F.sum("packs_ordered").alias("packs"), F.sum("units_ordered").alias("units")),
    over(
        "SELECT product_group, CAST(sum(packs_ordered) AS BIGINT) AS packs, "
        "CAST(sum(units_ordered) AS BIGINT) AS units FROM ship GROUP BY 1"
    ),
)
add(
    "calendar_keys",
    lambda spark, folder: _interpreted(spark, folder)
    .groupBy("delivery_year", "delivery_month", "delivery_quarter")
    .agg(F.count("*").alias("n")),
    over("SELECT delivery_year, delivery_month, delivery_quarter, count(*) AS n FROM ship GROUP BY ALL"),
)
add(
    "era_split",
    lambda spark, folder: ingest.with_era(t.stored_shipments(spark, folder), t.ERA_CUTOFF)
    .groupBy("era", "delivery_year")
    .agg(F.count("*").alias("n")),
    over(
        "SELECT CASE WHEN delivery_year <= 1998 THEN 'early' ELSE 'late' END AS era, delivery_year, "
        "count(*) AS n FROM ship GROUP BY ALL"
    ),
)
_reason_rows = " UNION ALL ".join(
    f"SELECT '{c.removesuffix('_reason')}' AS field, {c} AS reason FROM ship"
    for c in [f"{d}_reason" for d in DATES] + ["freight_cost_reason", "weight_reason"]
)
_reason_counts = ", ".join(
    f"count_if(reason = '{r}') AS {r}"
    for r in ("parsed", "structural", "missing", "cross_reference", "unparseable")
)
add(
    "parsing_report",
    lambda spark, folder: ingest.parsing_report(_interpreted(spark, folder)),
    also(
        f"r AS ({_reason_rows}) ",
        f"SELECT field, {_reason_counts}, {rnd("100.0 * count_if(reason = 'parsed') / count(*)", 2)} AS parsed_pct "
        "FROM r GROUP BY field",
    ),
)

# --- filters -------------------------------------------------------------------
add(
    "multi_field_filter",
    lambda spark, folder: filters.filter_levels(
        t.stored_shipments(spark, folder),
        {"shipment_mode": ["Air", "Ocean"], "region": ["ASIA", "EUROPE"], "vendor": []},
    )
    .groupBy("shipment_mode", "region")
    .agg(F.count("*").alias("n")),
    over(
        "SELECT shipment_mode, region, count(*) AS n FROM ship "
        "WHERE shipment_mode IN ('Air','Ocean') AND region IN ('ASIA','EUROPE') GROUP BY ALL"
    ),
)
add(
    "filter_options",
    lambda spark, folder: filters.filter_options(
        t.stored_shipments(spark, folder).withColumn("only", F.lit("x")), ["shipment_mode", "brand", "only"]
    ),
    over(
        "SELECT DISTINCT 'shipment_mode' AS field, shipment_mode AS level FROM ship UNION "
        "SELECT DISTINCT 'brand', brand FROM ship WHERE brand IS NOT NULL"
    ),
)
add(
    "reason_code_filter",
    lambda spark, folder: filters.parsed_only(t.stored_shipments(spark, folder), "freight_cost")
    .groupBy("region")
    .agg(F.count("*").alias("n")),
    over("SELECT region, count(*) AS n FROM ship WHERE freight_cost_reason = 'parsed' GROUP BY 1"),
)


# --- scorecards ----------------------------------------------------------------
def metrics_sql(keys: str, extra: str = "", where: str = "") -> str:
    names = [k.strip() for k in keys.split(",")]
    return f"""SELECT {keys}, count(*) AS shipments, {whole('is_late')} AS late_shipments,
      {rnd(f"100 * (1 - {whole('is_late')} / count(*))", 2)} AS on_time_pct,
      {rnd('avg(delivery_delay_days)', 2)} AS avg_delay_days,
      {rnd('quantile_cont(delivery_delay_days, 0.5)', 1)} AS median_delay_days,
      {rnd('quantile_cont(delivery_delay_days, 0.9)', 1)} AS p90_delay_days,
      {money('line_value_usd')} AS line_value_usd, {money('freight_cost_usd')} AS freight_cost_usd,
      {rnd('quantile_cont(freight_pct_of_value, 0.5)', 2)} AS median_freight_pct,
      {whole('packs_ordered')} AS packs, {whole('units_ordered')} AS units,
      {rnd(f"CASE WHEN {whole('packs_ordered')} > 0 THEN {money('freight_cost_usd')} / {whole('packs_ordered')} END", 4)}
        AS freight_per_pack_usd {extra}
    FROM ship {where} GROUP BY {', '.join(names)}"""


add("service_metrics_null_brand", _ship(service.service_metrics, keys=["brand"]), over(metrics_sql("brand")))
add(
    "vendor_scorecard",
    _ship(service.vendor_scorecard),
    also(
        f"m AS ({metrics_sql('vendor')} HAVING count(*) >= 30) ",
        """SELECT *, CASE WHEN on_time_pct >= 92 THEN 'Preferred' WHEN on_time_pct >= 85 THEN 'Approved'
             ELSE 'Watchlist' END AS performance_tier, on_time_pct >= 90 AS meets_target,
             row_number() OVER (ORDER BY on_time_pct, vendor NULLS LAST) AS rank FROM m""",
    ),
)
add(
    "country_performance",
    _ship(service.country_performance),
    over(metrics_sql("country, region") + " HAVING count(*) >= 30"),
)
add(
    "region_performance",
    _ship(service.region_performance),
    also(f"m AS ({metrics_sql('region')}) ", f"SELECT *, {rnd('on_time_pct - 90.0', 2)} AS target_gap_pct FROM m"),
)
add(
    "mode_performance",
    _ship(service.mode_performance),
    over(
        metrics_sql(
            "shipment_mode",
            f", {rnd('quantile_cont(freight_cost_per_kg, 0.5)', 2)} AS median_freight_per_kg_usd",
        )
    ),
)
add("product_performance", _ship(service.product_performance), over(metrics_sql("product_group, product_group_name")))
add(
    "manufacturing_site_analysis",
    _ship(service.manufacturing_site_analysis),
    over(metrics_sql("manufacturing_site") + " HAVING count(*) >= 30"),
)
FREIGHT = f"""SELECT shipment_mode, region, count(*) AS shipments,
    {rnd(money('freight_cost_usd'), 0)} AS freight_spend_usd,
    {rnd('quantile_cont(freight_cost_per_kg, 0.5)', 2)} AS median_freight_per_kg,
    {rnd('quantile_cont(freight_pct_of_value, 0.5)', 2)} AS median_freight_pct_of_value,
    {money('weight_kg')} AS total_weight_kg
  FROM ship WHERE freight_cost_reason = 'parsed' GROUP BY ALL HAVING count(*) >= 20"""
add("freight_economics", _ship(service.freight_economics), over(FREIGHT))
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "Other"]
add(
    "freight_heatmap",
    _ship(service.freight_heatmap, regions=REGIONS),
    also(
        f"f AS ({FREIGHT}) ",
        "SELECT shipment_mode, "
        + ", ".join(f"max(median_freight_per_kg) FILTER (region = '{r}') AS \"{r}\"" for r in REGIONS)
        + " FROM f GROUP BY 1",
    ),
)
for _period, _column in service.PERIODS.items():
    add(
        f"delivery_trend_by_{_period}",
        _ship(service.delivery_trend, period=_period),
        over(
            f"""SELECT {_column}, count(*) AS shipments, {whole('is_late')} AS late_shipments,
              {rnd('avg(delivery_delay_days)', 2)} AS avg_delay_days, {money('line_value_usd')} AS line_value_usd,
              {money('freight_cost_usd')} AS freight_cost_usd,
              {rnd(f"100 * (1 - {whole('is_late')} / count(*))", 2)} AS on_time_pct
            FROM ship WHERE {_column} IS NOT NULL GROUP BY 1"""
        ),
    )
BUCKETS = """b AS (SELECT CASE WHEN d < -30 THEN 'More than 30 days early' WHEN d < -7 THEN '8 to 30 days early'
    WHEN d < 0 THEN '1 to 7 days early' WHEN d = 0 THEN 'On the scheduled day' WHEN d <= 7 THEN '1 to 7 days late'
    WHEN d <= 30 THEN '8 to 30 days late' ELSE 'More than 30 days late' END AS bucket
    FROM (SELECT delivery_delay_days AS d FROM ship WHERE delivery_delay_days IS NOT NULL)),
  dist AS (SELECT names.bucket, count(b.bucket) AS shipments,
    """ + rnd("100.0 * count(b.bucket) / (SELECT count(*) FROM b)", 2) + """ AS share_pct
    FROM (SELECT unnest(['More than 30 days early','8 to 30 days early','1 to 7 days early','On the scheduled day',
      '1 to 7 days late','8 to 30 days late','More than 30 days late']) AS bucket) names
    LEFT JOIN b ON b.bucket = names.bucket GROUP BY names.bucket) """
add("delay_distribution", _ship(service.delay_distribution), also(BUCKETS, "SELECT * FROM dist"))
add(
    "early_share",
    lambda spark, folder: service.early_share(service.delay_distribution(t.stored_shipments(spark, folder))),
    also(BUCKETS, f"SELECT {rnd('sum(share_pct)', 2)} AS early_share_pct FROM dist WHERE bucket LIKE '%early%'"),
)
add(
    "lead_time_breakdown",
    _ship(service.lead_time_breakdown),
    over(
        " UNION ALL ".join(
            f"""SELECT '{label}' AS interval, count({c}) AS line_items,
              {rnd(f'100.0 * count({c}) / count(*)', 2)} AS coverage_pct, {rnd(f'avg({c})', 1)} AS mean_days,
              {rnd(f'quantile_cont({c}, 0.5)', 1)} AS median_days, {rnd(f'quantile_cont({c}, 0.9)', 1)} AS p90_days,
              '{basis}' AS basis FROM ship"""
            for label, c, basis in service.INTERVALS
        )
    ),
)
add(
    "shipment_kpis",
    _ship(service.shipment_kpis),
    also(
        f"""k AS (SELECT count(*) AS shipments, count(DISTINCT country) AS countries, count(DISTINCT vendor) AS vendors,
          count(DISTINCT manufacturing_site) AS manufacturing_sites,
          {rnd('100.0 * (1 - avg(is_late))', 2)} AS on_time_delivery_pct, {whole('is_late')} AS late_shipments,
          {rnd('avg(delivery_delay_days)', 2)} AS avg_delay_days,
          {rnd('quantile_cont(delivery_delay_days, 0.5)', 1)} AS median_delay_days,
          {rnd(money('line_value_usd'), 0)} AS total_commodity_value_usd,
          {rnd(money('freight_cost_usd'), 0)} AS total_freight_spend_usd,
          {rnd('quantile_cont(freight_pct_of_value, 0.5)', 2)} AS median_freight_pct_of_value,
          {whole('packs_ordered')} AS total_packs, {whole('units_ordered')} AS total_units,
          {rnd('quantile_cont(vendor_lead_time_days, 0.5)', 1)} AS median_vendor_lead_time_days,
          {rnd('100.0 * count(vendor_lead_time_days) / count(*)', 1)} AS vendor_lead_time_coverage_pct,
          CAST(min(date_delivered) AS VARCHAR) AS date_from, CAST(max(date_delivered) AS VARCHAR) AS date_to,
          90.0::DOUBLE AS on_time_target_pct FROM ship) """,
        "SELECT *, on_time_delivery_pct >= on_time_target_pct AS meets_on_time_target FROM k",
    ),
)

# --- funnels -------------------------------------------------------------------
_all, _good, _exact = (
    money("line_value_usd"),
    money("CASE WHEN is_late = 0 THEN line_value_usd END"),
    money("CASE WHEN delivery_delay_days = 0 THEN line_value_usd END"),
)
add(
    "value_funnel",
    _ship(funnels.value_funnel),
    over(
        " UNION ALL ".join(
            f"SELECT {i} AS stage_order, '{stage}' AS stage, {rnd(v, 0)} AS value_usd, "
            f"{rnd(f'100 * {v} / {_all}', 2)} AS share_pct, {n} AS line_items, '{basis}' AS basis FROM ship"
            for i, stage, v, n, basis in (
                (1, "Value ordered", _all, "count(*)", "all line items"),
                (2, "Value delivered", _all, "count(*)", "every line item was delivered"),
                (3, "Delivered on or before schedule", _good, "count_if(is_late = 0)", "delivery_delay_days <= 0"),
                (
                    4,
                    "Delivered exactly on the scheduled day",
                    _exact,
                    "count_if(delivery_delay_days = 0)",
                    "delivery_delay_days == 0",
                ),
            )
        )
    ),
)
add(
    "value_funnel_summary",
    _ship(funnels.value_funnel_summary),
    over(
        f"""SELECT {rnd(f'{_all} - {_good}', 0)} AS late_value_usd,
          {rnd(money('CASE WHEN delivery_delay_days < 0 THEN line_value_usd END'), 0)} AS early_value_usd,
          {rnd('100.0 * count_if(delivery_delay_days = 0) / count(*)', 2)} AS exact_day_share_pct FROM ship"""
    ),
)


def _within(days: int) -> str:
    value = money(f"CASE WHEN delivery_delay_days <= {days} THEN line_value_usd END")
    label = "On or before schedule" if days == 0 else f"Within {days} days late"
    rows = f"count_if(delivery_delay_days <= {days})"
    return (
        f"SELECT {days} AS threshold_days, '{label}' AS label, {rnd(value, 0)} AS value_usd, "
        f"{rnd(f'100 * {value} / {_all}', 2)} AS share_pct, {rows} AS line_items, "
        f"{rnd(f'100.0 * {rows} / count(*)', 2)} AS items_share_pct FROM ship"
    )


add(
    "lateness_funnel",
    _ship(funnels.lateness_funnel),
    over(
        " UNION ALL ".join(_within(d) for d in (0, 7, 30, 90))
        + f" UNION ALL SELECT max(delivery_delay_days), 'All deliveries (worst case)', {rnd(_all, 0)}, 100.0, "
        "count(*), 100.0 FROM ship"
    ),
)
add(
    "traceability",
    _ship(funnels.traceability),
    over(
        " UNION ALL ".join(
            f"""SELECT '{stage}' AS stage, count({c}) AS recorded, {rnd(f'100.0 * count({c}) / count(*)', 2)} AS coverage_pct,
              count_if({c}_reason = 'structural') AS structurally_absent,
              count_if({c}_reason = 'missing') AS genuinely_missing,
              CASE WHEN count_if({c}_reason = 'structural') > 0
                   THEN format('{{:,}}', count_if({c}_reason = 'structural')) || '{note}'
                   WHEN count_if({c}_reason = 'missing') > 0
                   THEN format('{{:,}}', count_if({c}_reason = 'missing')) || ' should have a date and have none'
                   ELSE 'Every row has a date' END AS interpretation FROM ship"""
            for stage, c, note in (
                (
                    s,
                    c,
                    " came from stock, which needs no order to a vendor"
                    if c == "date_po_sent"
                    else " are older than the quote records",
                )
                for s, c in funnels.MILESTONES
            )
        )
    ),
)
add(
    "funnel_kpis",
    _ship(funnels.funnel_kpis),
    over(
        f"""SELECT count(*) AS line_items, {rnd(_all, 0)} AS value_ordered_usd, {rnd(_good, 0)} AS value_on_time_usd,
          {rnd(f'{_all} - {_good}', 0)} AS value_late_usd, {rnd(f'100 * {_good} / {_all}', 2)} AS value_on_time_pct,
          {rnd('100.0 * count_if(is_late = 0) / count(is_late)', 2)} AS items_on_time_pct,
          {rnd('100.0 * count_if(delivery_delay_days = 0) / count(*)', 2)} AS exact_day_pct,
          {rnd('100.0 * count_if(delivery_delay_days < 0) / count(*)', 2)} AS early_pct,
          {rnd('100.0 * count_if(delivery_delay_days > 0) / count(*)', 2)} AS late_pct,
          {rnd('quantile_cont(total_lead_time_days, 0.5)', 1)} AS median_quote_to_delivery_days,
          {rnd('quantile_cont(total_lead_time_days, 0.9)', 1)} AS p90_quote_to_delivery_days,
          {rnd('100.0 * count(date_po_sent) / count(*)', 2)} AS po_traceability_pct FROM ship"""
    ),
)
