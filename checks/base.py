"""Shared pieces of the SQL cross-checks.

``SHIP`` restates the shipment view in DuckDB SQL straight from the integers the
texts were rendered from, so it checks parsing and derivation independently.
"""

from __future__ import annotations

SHIP = """
WITH lines AS (
  SELECT *, CAST(l_shipdate AS DATE) AS shipped, l_suppkey % 2 = 0 AS rdc,
         (l_orderkey*7 + l_partkey*3 + l_suppkey*5 + l_linenumber) % 100 AS h
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
), delayed AS (
  SELECT *, CAST(CASE WHEN h < 61 THEN 0
                      WHEN h < (CASE WHEN rdc AND year(shipped) > 1998 THEN 70 ELSE 88 END) THEN -1 - h % 40
                      ELSE 1 + (h % 12) * 3 END AS INTEGER) AS delay0,
         CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS INTEGER) AS brand_no
  FROM lines
), planned AS (
  SELECT *, shipped - delay0 AS planned FROM delayed
), quoted AS (
  SELECT *, planned - CAST(30 + l_partkey % 200 AS INTEGER) AS quoted FROM planned
), bound AS (
  SELECT *,
    CASE WHEN h >= 26 THEN quoted END AS date_pq_sent,
    CASE WHEN NOT rdc AND h NOT IN (50, 51) THEN quoted + 14 END AS date_po_sent,
    CASE WHEN NOT (h = 59 AND l_linenumber = 5) THEN planned END AS date_scheduled,
    CASE WHEN NOT (h = 37 AND l_linenumber % 3 = 0) THEN shipped END AS date_delivered,
    CASE WHEN NOT (h = 11 AND l_linenumber = 2)
         THEN CASE WHEN h = 13 THEN shipped - 1 ELSE shipped + CAST(l_linenumber % 4 AS INTEGER) END
         END AS date_recorded,
    CASE WHEN h > 40 THEN floor(l_extendedprice * l_tax * 100.0) / 100.0 END AS freight_cost_usd,
    CASE WHEN h < 20 OR h >= 45
         THEN CASE WHEN h = 77 THEN 0.0::DOUBLE ELSE l_quantity * p_size END END AS weight_kg,
    CASE WHEN h = 7 AND l_linenumber = 1 THEN 0.0::DOUBLE ELSE l_extendedprice END AS line_value_usd,
    l_extendedprice / l_quantity AS pack_price0,
    CASE p_type WHEN 'SMALL' THEN 'ARV' WHEN 'LARGE' THEN 'HRDT' WHEN 'MEDIUM' THEN 'ACT'
                WHEN 'STANDARD' THEN 'MRDT' WHEN 'ECONOMY' THEN 'ANTM' ELSE p_type END AS product_group
  FROM quoted
), ship AS (
  SELECT
    l_orderkey * 8 + l_linenumber AS shipment_id,
    'P' || c_nationkey AS project_code, 'PQ-' || l_orderkey AS pq_number,
    'SO-' || l_partkey || '-' || l_suppkey AS po_number, 'DN-' || l_orderkey AS asn_number,
    n_name AS country, c_mktsegment AS managed_by,
    CASE WHEN rdc THEN 'From RDC' ELSE 'Direct Drop' END AS fulfil_via,
    CASE WHEN rdc THEN 'N/A - From RDC' WHEN l_suppkey % 3 = 0 THEN 'EXW'
         WHEN l_suppkey % 3 = 1 THEN 'DDP' ELSE 'FCA' END AS inco_term,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Air' WHEN '2-HIGH' THEN 'Air Charter'
         WHEN '3-MEDIUM' THEN 'Truck' WHEN '5-LOW' THEN 'Ocean' ELSE 'Unknown' END AS shipment_mode,
    product_group, p_type AS sub_classification, s_name AS vendor,
    p_name || ' ' || p_type AS item_description, p_name AS molecule,
    CASE WHEN brand_no <= 12 THEN 'Generic' WHEN brand_no = 25 THEN NULL ELSE p_brand END AS brand,
    CASE p_type WHEN 'SMALL' THEN '100mg' WHEN 'MEDIUM' THEN '200mg' WHEN 'LARGE' THEN '200mg'
         WHEN 'STANDARD' THEN '600mg' WHEN 'ECONOMY' THEN '10mg/ml' END AS dosage,
    p_type AS dosage_form, CAST(p_size AS BIGINT) AS units_per_pack,
    CAST(l_quantity AS BIGINT) AS quantity, line_value_usd,
    CASE WHEN h = 5 THEN pack_price0 + 1.0 ELSE pack_price0 END AS pack_price_usd,
    CASE WHEN h = 3 THEN 0.0::DOUBLE ELSE pack_price0 END AS unit_price_usd,
    p_brand AS manufacturing_site,
    CASE WHEN h >= 16 AND h < 40 THEN 'No' ELSE 'Yes' END AS first_line_designation,
    floor(l_extendedprice * l_discount) / 100.0 AS insurance_usd,
    date_pq_sent, date_po_sent, date_scheduled, date_delivered, date_recorded,
    CASE WHEN h < 24 THEN 'structural' WHEN h < 26 THEN 'missing' ELSE 'parsed' END AS date_pq_sent_reason,
    CASE WHEN rdc THEN 'structural' WHEN h IN (50, 51) THEN 'missing' ELSE 'parsed' END AS date_po_sent_reason,
    CASE WHEN date_scheduled IS NULL THEN 'unparseable' ELSE 'parsed' END AS date_scheduled_reason,
    CASE WHEN date_delivered IS NULL THEN 'missing' ELSE 'parsed' END AS date_delivered_reason,
    CASE WHEN date_recorded IS NULL THEN 'missing' ELSE 'parsed' END AS date_recorded_reason,
    freight_cost_usd,
    CASE WHEN h < 16 THEN 'structural' WHEN h < 40 THEN 'cross_reference' WHEN h = 40 THEN 'missing'
         ELSE 'parsed' END AS freight_cost_reason,
    weight_kg,
    CASE WHEN h < 20 OR h >= 45 THEN 'parsed' WHEN h < 35 THEN 'structural'
         ELSE 'cross_reference' END AS weight_reason,
    CASE WHEN n_name = 'NATION_24' THEN 'Other' ELSE r_name END AS region,
    CASE product_group WHEN 'ARV' THEN 'Antiretroviral (ARV)' WHEN 'HRDT' THEN 'HIV Rapid Diagnostic Test'
         WHEN 'ACT' THEN 'Artemisinin Combination Therapy' WHEN 'MRDT' THEN 'Malaria Rapid Diagnostic Test'
         WHEN 'ANTM' THEN 'Anti-malarial' ELSE product_group END AS product_group_name,
    CAST(rdc AS INTEGER) AS is_from_rdc,
    date_delivered - date_scheduled AS delivery_delay_days,
    CASE WHEN date_delivered - date_scheduled IS NOT NULL
         THEN CAST(date_delivered - date_scheduled > 0 AS INTEGER) END AS is_late,
    date_delivered - date_po_sent AS vendor_lead_time_days,
    date_delivered - date_pq_sent AS total_lead_time_days,
    date_recorded - date_delivered AS recording_lag_days,
    date_scheduled - date_pq_sent AS scheduled_lead_time_days,
    CASE WHEN line_value_usd > 0 THEN 100.0 * freight_cost_usd / line_value_usd END AS freight_pct_of_value,
    CASE WHEN weight_kg > 0 THEN freight_cost_usd / weight_kg END AS freight_cost_per_kg,
    CAST(l_quantity AS BIGINT) AS packs_ordered,
    CAST(l_quantity AS BIGINT) * p_size AS units_ordered,
    CAST(year(date_delivered) AS INTEGER) AS delivery_year,
    strftime(date_delivered, '%Y-%m') AS delivery_month,
    year(date_delivered) || 'Q' || quarter(date_delivered) AS delivery_quarter
  FROM bound JOIN region ON n_regionkey = r_regionkey
)
"""


def rnd(value: str, places: int) -> str:
    """Half-even rounding by scaling, the rule of the published figures."""
    if places == 0:
        return f"CAST(round_even(CAST({value} AS DOUBLE), 0) AS DOUBLE)"
    scale = f"1e{places}"
    return f"(CAST(round_even(CAST({value} AS DOUBLE) * {scale}, 0) AS DOUBLE) / {scale})"


def money(value: str) -> str:
    return f"coalesce(CAST(sum(CAST({value} AS DECIMAL(18,2))) AS DOUBLE), 0.0)"


def whole(value: str) -> str:
    return f"coalesce(CAST(sum({value}) AS BIGINT), 0)"


def over(sql: str) -> str:
    """A query over the shipment view."""
    return SHIP + sql


def also(ctes: str, sql: str) -> str:
    """A query over the shipment view and further named steps."""
    return SHIP + ", " + ctes + sql
