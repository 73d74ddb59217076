"""Catalogue, concentration and pricing beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import also, money, over, rnd, whole
from dockline.operators import products
from dockline.sources import tables as t

QUERIES = {}
ORACLES = {}

PRICED = "priced AS (SELECT * FROM ship WHERE unit_price_usd > 0 AND molecule IS NOT NULL AND dosage IS NOT NULL AND dosage_form IS NOT NULL)"
KEY = "molecule, dosage, dosage_form"


def add(name, build, sql=None):
    QUERIES[name] = build
    if sql is not None:
        ORACLES[name] = sql


def _ship(operator, **kwargs):
    return lambda spark, folder: operator(t.stored_shipments(spark, folder), **kwargs)


add(
    "priced_rows",
    lambda spark, folder: products.priced(t.stored_shipments(spark, folder))
    .groupBy("dosage", "dosage_form")
    .agg(F.count("*").alias("n")),
    also(PRICED, " SELECT dosage, dosage_form, count(*) AS n FROM priced GROUP BY ALL"),
)
add(
    "catalogue_kpis",
    _ship(products.catalogue_kpis),
    also(
        PRICED,
        " SELECT count(*) AS line_items, "
        + ", ".join(f"count(DISTINCT {c}) AS {n}" for n, c in products.CATALOGUE_COUNTS.items())
        + f""", count_if(brand = 'Generic') AS generic_line_items,
          {rnd("100.0 * count_if(brand = 'Generic') / count(*)", 2)} AS generic_share_pct,
          (SELECT count(*) FROM priced) AS priced_line_items,
          {rnd('100.0 * (SELECT count(*) FROM priced) / count(*)', 2)} AS priced_coverage_pct,
          {rnd(money('line_value_usd'), 0)} AS total_value_usd FROM ship""",
    ),
)
add(
    "product_mix",
    _ship(products.product_mix),
    over(
        f"""SELECT product_group, count(*) AS line_items, {rnd(money('line_value_usd'), 0)} AS value_usd,
          {rnd(f"100 * {money('line_value_usd')} / (SELECT {money('line_value_usd')} FROM ship)", 2)} AS value_share_pct,
          count(DISTINCT molecule) AS molecules,
          {rnd(f"100 * (1 - {whole('is_late')} / count(*))", 2)} AS on_time_pct FROM ship GROUP BY 1"""
    ),
)
add(
    "top_products",
    _ship(products.top_products),
    also(
        PRICED,
        f""" SELECT {KEY}, count(*) AS line_items, {rnd(money('line_value_usd'), 0)} AS value_usd,
          count(DISTINCT manufacturing_site) AS sites, count(DISTINCT vendor) AS vendors,
          {rnd('quantile_cont(unit_price_usd, 0.5)', 4)} AS median_unit_price_usd,
          {rnd('min(unit_price_usd)', 4)} AS min_unit_price_usd, {rnd('max(unit_price_usd)', 4)} AS max_unit_price_usd
        FROM priced GROUP BY {KEY} ORDER BY {money('line_value_usd')} DESC, {KEY} LIMIT 15""",
    ),
)
CONCENTRATION = f"""{PRICED}, g AS (SELECT {KEY}, count(*) AS line_items, {money('line_value_usd')} AS value,
    count(DISTINCT manufacturing_site) AS sites FROM priced GROUP BY {KEY}),
  s AS (SELECT *, {rnd('100 * value / (SELECT sum(value) FROM g)', 2)} AS value_share_pct FROM g),
  c AS (SELECT *, row_number() OVER (ORDER BY value DESC, {KEY}) AS rank,
    {rnd(f'sum(value_share_pct) OVER (ORDER BY value DESC, {KEY} ROWS UNBOUNDED PRECEDING)', 2)} AS cumulative_share_pct,
    molecule || ' ' || dosage || CASE WHEN count(*) OVER (PARTITION BY molecule || ' ' || dosage) > 1
      THEN ' (' || dosage_form || ')' ELSE '' END AS product FROM s)"""
add(
    "value_concentration",
    lambda spark, folder: products.value_concentration(t.stored_shipments(spark, folder)).products,
    also(
        CONCENTRATION,
        f" SELECT product, {KEY}, line_items, {rnd('value', 0)} AS value_usd, value_share_pct, cumulative_share_pct, sites, rank FROM c",
    ),
)
add(
    "value_concentration_top_10",
    lambda spark, folder: products.value_concentration(t.stored_shipments(spark, folder), 10).products,
    also(
        CONCENTRATION,
        f" SELECT product, {KEY}, line_items, {rnd('value', 0)} AS value_usd, value_share_pct, cumulative_share_pct, sites, rank FROM c WHERE rank <= 10",
    ),
)
add(
    "value_concentration_summary",
    lambda spark, folder: products.value_concentration(t.stored_shipments(spark, folder)).summary,
    also(
        CONCENTRATION,
        f""" SELECT count(*) AS products_total, {rnd('max(cumulative_share_pct) FILTER (rank = 5)', 1)} AS top_5_share_pct,
          {rnd('max(cumulative_share_pct) FILTER (rank = 15)', 1)} AS top_15_share_pct,
          {rnd('sum(value)', 0)} AS total_value_usd FROM c""",
    ),
)
add(
    "pareto_crossing",
    lambda spark, folder: products.pareto_crossing(
        products.value_concentration(t.stored_shipments(spark, folder)).products, 80.0
    ),
    also(CONCENTRATION, " SELECT min(rank) AS crossed_at FROM c WHERE cumulative_share_pct >= 80"),
)


def _spread_sql(keys: str, rows: str) -> str:
    return f"""SELECT {keys}, count(*) AS line_items, count(DISTINCT manufacturing_site) AS sites,
      count(DISTINCT vendor) AS vendors, {rnd(money('line_value_usd'), 0)} AS value_usd,
      {rnd('min(unit_price_usd)', 4)} AS min_price, {rnd('quantile_cont(unit_price_usd, 0.5)', 4)} AS median_price,
      {rnd('max(unit_price_usd)', 4)} AS max_price, {rnd('max(unit_price_usd) / min(unit_price_usd)', 1)} AS spread_x
    FROM {rows} GROUP BY {keys} HAVING count(*) >= 20 AND count(DISTINCT manufacturing_site) >= 3"""


DATED = "dated AS (SELECT * FROM priced WHERE delivery_year IS NOT NULL)"
WITHIN = _spread_sql(f"{KEY}, delivery_year", "dated")
add("price_spread", _ship(products.price_spread), also(PRICED, " " + _spread_sql(KEY, "priced")))
add("price_spread_within_year", _ship(products.price_spread_within_year), also(f"{PRICED}, {DATED} ", WITHIN))


def _trend_sql(molecule: str, dosage: str) -> str:
    return f"""SELECT delivery_year, count(*) AS line_items, count(DISTINCT manufacturing_site) AS sites,
      {rnd('min(unit_price_usd)', 4)} AS min_price, {rnd('quantile_cont(unit_price_usd, 0.5)', 4)} AS median_price,
      {rnd('max(unit_price_usd)', 4)} AS max_price
    FROM dated WHERE molecule = '{molecule}' AND dosage = '{dosage}' GROUP BY 1"""


TREND = f"{PRICED}, {DATED}, trend AS ({_trend_sql('hot ring', '600mg')}) "
DECLINE = rnd("100 * (1 - max_by(median_price, delivery_year) / min_by(median_price, delivery_year))", 1)


def _trend(spark, folder):
    return products.price_trend(t.stored_shipments(spark, folder), "hot ring", "600mg")


add("price_trend", _trend, also(TREND, "SELECT * FROM trend"))
add(
    "price_decline",
    lambda spark, folder: products.price_decline(_trend(spark, folder)),
    also(TREND, f"SELECT {DECLINE} AS decline_pct FROM trend"),
)
add(
    "recent_price_gap",
    lambda spark, folder: products.recent_price_gap(_trend(spark, folder), 1999),
    also(
        TREND,
        f"""SELECT quantile_cont(max_price, 0.5) AS median_of_max, quantile_cont(median_price, 0.5) AS median_of_median,
          {rnd('quantile_cont(max_price, 0.5) / quantile_cont(median_price, 0.5)', 1)} AS gap_x
        FROM trend WHERE delivery_year >= 1999""",
    ),
)


def _sites_sql(where: str) -> str:
    return f""" SELECT manufacturing_site, count(*) AS line_items,
      {rnd('quantile_cont(unit_price_usd, 0.5)', 4)} AS median_unit_price_usd,
      {rnd(money('line_value_usd'), 0)} AS value_usd,
      {rnd(f"100 * (1 - {whole('is_late')} / count(*))", 2)} AS on_time_pct
    FROM priced WHERE {where} GROUP BY 1"""


add(
    "site_prices",
    _ship(products.site_prices, molecule="hot ring", dosage="200mg"),
    also(PRICED, _sites_sql("molecule = 'hot ring' AND dosage = '200mg'")),
)
add(
    "site_prices_one_year",
    _ship(products.site_prices, molecule="hot ring", dosage=None, year=1997),
    also(PRICED, _sites_sql("molecule = 'hot ring' AND delivery_year = 1997")),
)
PREMIUM = f"""{PRICED}, {DATED}, premium AS (
  SELECT molecule, dosage, delivery_year, molecule || ' ' || dosage || ' (' || delivery_year || ')' AS label,
    count(*) AS line_items,
    {rnd("quantile_cont(unit_price_usd, 0.5) FILTER (brand = 'Generic')", 4)} AS generic_price,
    {rnd("quantile_cont(unit_price_usd, 0.5) FILTER (brand <> 'Generic')", 4)} AS branded_price,
    {rnd("quantile_cont(unit_price_usd, 0.5) FILTER (brand <> 'Generic') / quantile_cont(unit_price_usd, 0.5) FILTER (brand = 'Generic')", 1)} AS premium_x,
    array_to_string(list_sort(list(DISTINCT brand) FILTER (brand <> 'Generic'))[1:2], ', ') AS branded_brand
  FROM dated GROUP BY molecule, dosage, delivery_year
  HAVING count(*) >= 20 AND count_if(brand = 'Generic') > 0 AND count_if(brand <> 'Generic') > 0) """
add(
    "brand_premium",
    lambda spark, folder: products.brand_premium(t.stored_shipments(spark, folder)).rows,
    also(PREMIUM, "SELECT * FROM premium"),
)
add(
    "brand_premium_summary",
    lambda spark, folder: products.brand_premium(t.stored_shipments(spark, folder)).summary,
    also(
        PREMIUM,
        f"SELECT {rnd('quantile_cont(premium_x, 0.5)', 1)} AS median_premium_x, count(*) AS product_years FROM premium",
    ),
)
add(
    "pricing_summary",
    lambda spark, folder: products.pricing_summary(
        t.stored_shipments(spark, folder), "hot ring", "600mg"
    ).drop("verdict"),
    also(
        f"""{PREMIUM}, pooled AS ({_spread_sql(KEY, 'priced')}), within_year AS ({WITHIN}),
          trend AS ({_trend_sql('hot ring', '600mg')}),
          worst AS (SELECT * FROM within_year ORDER BY spread_x DESC, {KEY}, delivery_year LIMIT 1) """,
        f"""SELECT {rnd('(SELECT quantile_cont(spread_x, 0.5) FROM pooled)', 1)} AS pooled_median_spread_x,
          (SELECT count(*) FROM pooled) AS pooled_products,
          {rnd('(SELECT quantile_cont(spread_x, 0.5) FROM within_year)', 1)} AS within_year_median_spread_x,
          (SELECT count(*) FROM within_year) AS within_year_products,
          (SELECT printf('%s %s in %d: $%.2f to $%.2f (%.1fx across %d factories)', molecule, dosage, delivery_year,
                  min_price, max_price, spread_x, sites) FROM worst) AS widest_case,
          (SELECT spread_x FROM worst) AS widest_spread_x,
          (SELECT {DECLINE} FROM trend) AS reference_decline_pct,
          {rnd('(SELECT quantile_cont(premium_x, 0.5) FROM premium)', 1)} AS brand_premium_x,
          (SELECT count(*) FROM premium) AS brand_premium_product_years,
          {rnd('(SELECT quantile_cont(spread_x, 0.5) FROM pooled) / (SELECT quantile_cont(spread_x, 0.5) FROM within_year)', 2)} AS inflation_factor""",
    ),
)
add(
    "value_reconciliation",
    _ship(products.value_reconciliation),
    over(
        f"""SELECT count(*) AS line_items,
          count_if(abs(pack_price_usd * quantity - line_value_usd) <= 0.01) AS reconciled,
          {rnd('100.0 * count_if(abs(pack_price_usd * quantity - line_value_usd) <= 0.01) / count(*)', 2)} AS reconciled_pct FROM ship"""
    ),
)
