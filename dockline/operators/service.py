"""Service and cost scorecards over the interpreted shipment table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockline.config import DEFAULTS, Settings
from dockline.functions.columns import (
    distinct_per_column,
    inline_rows,
    match_rows,
    merge_single_rows,
    money_sum,
    on_time_pct,
    percent,
    ratio,
    rounded,
    tally,
    whole_sum,
)
from dockline.plans.moments import column_medians
from dockline.plans.quantiles import grouped_quantiles
from dockline.plans.ranking import running

KPI_COUNTS = {"countries": "country", "vendors": "vendor", "manufacturing_sites": "manufacturing_site"}
KPI_MEDIANS = ("delivery_delay_days", "freight_pct_of_value", "vendor_lead_time_days")
PERIODS = {"quarter": "delivery_quarter", "month": "delivery_month", "year": "delivery_year"}
# Interval names. The last entry says what rows an interval rests on.
INTERVALS = (
    ("Price quote to delivery", "total_lead_time_days", "rows with a quote date"),
    ("Vendor PO to delivery", "vendor_lead_time_days", "rows with an order date, none from stock"),
    ("Planned quote-to-scheduled", "scheduled_lead_time_days", "rows with both planned dates"),
    ("Scheduled versus actual delivery", "delivery_delay_days", "days before the planned date count below zero"),
    ("Delivery to system recording", "recording_lag_days", "rows with an entry date"),
)


def _delay_buckets() -> list[tuple[str, Column]]:
    d = F.col("delivery_delay_days")
    return [
        ("More than 30 days early", d < -30),
        ("8 to 30 days early", (d >= -30) & (d < -7)),
        ("1 to 7 days early", (d >= -7) & (d < 0)),
        ("On the scheduled day", d == 0),
        ("1 to 7 days late", (d > 0) & (d <= 7)),
        ("8 to 30 days late", (d > 7) & (d <= 30)),
        ("More than 30 days late", d > 30),
    ]


def service_metrics(
    df: DataFrame, keys: list[str], extra: dict[str, tuple[str, float]] | None = None
) -> DataFrame:
    """The standard service and cost metrics per group; a null key is a group.

    ``extra`` adds rounded quantile columns: name -> (value column, fraction).
    On-time share divides by all rows of the group, null delays included.
    """
    sums = df.groupBy(*keys).agg(
        F.count("*").alias("shipments"),
        whole_sum("is_late").alias("late_shipments"),
        F.avg("delivery_delay_days").alias("avg_delay_days"),
        money_sum("line_value_usd").alias("line_value_usd"),
        money_sum("freight_cost_usd").alias("freight_cost_usd"),
        whole_sum("packs_ordered").alias("packs"),
        whole_sum("units_ordered").alias("units"),
    )
    wanted = {
        "median_delay_days": ("delivery_delay_days", 0.5),
        "p90_delay_days": ("delivery_delay_days", 0.9),
        "median_freight_pct": ("freight_pct_of_value", 0.5),
        **(extra or {}),
    }
    joined = match_rows(sums, grouped_quantiles(df, keys, wanted), keys)
    return joined.select(
        *keys,
        "shipments",
        "late_shipments",
        on_time_pct(F.col("late_shipments"), F.col("shipments")).alias("on_time_pct"),
        rounded(F.col("avg_delay_days"), 2).alias("avg_delay_days"),
        rounded(F.col("median_delay_days"), 1).alias("median_delay_days"),
        rounded(F.col("p90_delay_days"), 1).alias("p90_delay_days"),
        "line_value_usd",
        "freight_cost_usd",
        rounded(F.col("median_freight_pct"), 2).alias("median_freight_pct"),
        "packs",
        "units",
        rounded(ratio(F.col("freight_cost_usd"), F.col("packs")), 4).alias("freight_per_pack_usd"),
        *[rounded(F.col(name), 2).alias(name) for name in (extra or {})],
    )


def performance_tier(score: Column, settings: Settings = DEFAULTS) -> Column:
    return (
        F.when(score >= settings.preferred_pct, "Preferred")
        .when(score >= settings.approved_pct, "Approved")
        .otherwise("Watchlist")
    )


def vendor_scorecard(
    df: DataFrame, min_shipments: int | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Vendors ranked worst first, with tier and target flag."""
    floor = settings.min_shipments_for_scoring if min_shipments is None else min_shipments
    score = F.col("on_time_pct")
    card = (
        service_metrics(df, ["vendor"])
        .filter(F.col("shipments") >= floor)
        .withColumn("performance_tier", performance_tier(score, settings))
        .withColumn("meets_target", score >= settings.on_time_target_pct)
    )
    order = [F.col("on_time_pct").asc(), F.col("vendor").asc_nulls_last()]
    return running(card, order, row_number="rank").orderBy("rank")


def country_performance(
    df: DataFrame, min_shipments: int | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    floor = settings.min_shipments_for_scoring if min_shipments is None else min_shipments
    out = service_metrics(df, ["country", "region"]).filter(F.col("shipments") >= floor)
    return out.orderBy("on_time_pct", "country", "region")


def region_performance(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    gap = rounded(F.col("on_time_pct") - settings.on_time_target_pct, 2)
    out = service_metrics(df, ["region"]).withColumn("target_gap_pct", gap)
    return out.orderBy("on_time_pct", "region")


def mode_performance(df: DataFrame) -> DataFrame:
    """Service and cost by transport mode, with the median freight per kilogram."""
    extra = {"median_freight_per_kg_usd": ("freight_cost_per_kg", 0.5)}
    return service_metrics(df, ["shipment_mode"], extra).orderBy("on_time_pct", "shipment_mode")


def product_performance(df: DataFrame) -> DataFrame:
    out = service_metrics(df, ["product_group", "product_group_name"])
    return out.orderBy(F.col("line_value_usd").desc(), "product_group")


def manufacturing_site_analysis(
    df: DataFrame, min_shipments: int | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    floor = settings.min_shipments_for_scoring if min_shipments is None else min_shipments
    out = service_metrics(df, ["manufacturing_site"]).filter(F.col("shipments") >= floor)
    return out.orderBy("on_time_pct", "manufacturing_site")


def freight_economics(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Freight cost by mode and region, on rows whose freight was a real number."""
    priced = df.filter(F.col("freight_cost_reason") == "parsed")
    keys = ["shipment_mode", "region"]
    sums = priced.groupBy(*keys).agg(
        F.count("*").alias("shipments"),
        money_sum("freight_cost_usd").alias("freight_spend_usd"),
        money_sum("weight_kg").alias("total_weight_kg"),
    )
    sums = sums.filter(F.col("shipments") >= settings.min_shipments_for_freight)
    wanted = {
        "median_freight_per_kg": ("freight_cost_per_kg", 0.5),
        "median_freight_pct_of_value": ("freight_pct_of_value", 0.5),
    }
    joined = match_rows(sums, grouped_quantiles(priced, keys, wanted), keys)
    return joined.select(
        *keys,
        "shipments",
        rounded(F.col("freight_spend_usd"), 0).alias("freight_spend_usd"),
        *[rounded(F.col(name), 2).alias(name) for name in wanted],
        "total_weight_kg",
    ).orderBy(F.col("median_freight_per_kg").desc(), *keys)


def freight_heatmap(df: DataFrame, regions: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Median freight per kilogram: a row per mode, a column per listed region."""
    cells = freight_economics(df, settings)
    return (
        cells.groupBy("shipment_mode")
        .pivot("region", regions)
        .agg(F.first("median_freight_per_kg"))
        .orderBy("shipment_mode")
    )


def delivery_trend(df: DataFrame, period: str = "quarter") -> DataFrame:
    """On-time share and spend per month, quarter or year; an unknown period is left out."""
    column = PERIODS[period]
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(
            F.count("*").alias("shipments"),
            whole_sum("is_late").alias("late_shipments"),
            rounded(F.avg("delivery_delay_days"), 2).alias("avg_delay_days"),
            money_sum("line_value_usd").alias("line_value_usd"),
            money_sum("freight_cost_usd").alias("freight_cost_usd"),
        )
        .withColumn("on_time_pct", on_time_pct(F.col("late_shipments"), F.col("shipments")))
        .orderBy(column)
    )


def delay_distribution(df: DataFrame) -> DataFrame:
    """Seven exclusive timing buckets over non-null delays; empty ones are shown."""
    buckets = _delay_buckets()
    wide = df.agg(
        F.count("delivery_delay_days").alias("total"),
        *[tally(test).alias(f"b{i}") for i, (_, test) in enumerate(buckets)],
    )
    return inline_rows(
        wide,
        [
            {
                "bucket": F.lit(label),
                "shipments": F.col(f"b{i}"),
                "share_pct": percent(F.col(f"b{i}"), F.col("total"), 2),
            }
            for i, (label, _) in enumerate(buckets)
        ],
    )


def early_share(distribution: DataFrame) -> DataFrame:
    """Total share of the early buckets of a delay distribution."""
    return distribution.filter(F.col("bucket").contains("early")).agg(
        rounded(F.sum("share_pct"), 2).alias("early_share_pct")
    )


def lead_time_breakdown(df: DataFrame) -> DataFrame:
    """Five intervals, each with its own denominator."""
    sums = df.agg(
        F.count("*").alias("rows"),
        *[F.count(c).alias(f"n{i}") for i, (_, c, _) in enumerate(INTERVALS)],
        *[F.avg(c).alias(f"mean{i}") for i, (_, c, _) in enumerate(INTERVALS)],
    )
    wanted = {}
    for i, (_, column, _) in enumerate(INTERVALS):
        wanted[f"median{i}"] = (column, 0.5)
        wanted[f"tail{i}"] = (column, 0.9)
    wide = merge_single_rows(sums, grouped_quantiles(df, [], wanted))
    return inline_rows(
        wide,
        [
            {
                "interval": F.lit(label),
                "line_items": F.col(f"n{i}"),
                "coverage_pct": percent(F.col(f"n{i}"), F.col("rows"), 2),
                "mean_days": rounded(F.col(f"mean{i}"), 1),
                "median_days": rounded(F.col(f"median{i}"), 1),
                "p90_days": rounded(F.col(f"tail{i}"), 1),
                "basis": F.lit(basis),
            }
            for i, (label, _, basis) in enumerate(INTERVALS)
        ],
    )


def shipment_kpis(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Headline figures in one row. Lateness averages over known delays only."""
    parsed_freight = F.when(F.col("freight_cost_reason") == "parsed", F.col("freight_cost_usd"))
    sums = df.agg(
        F.count("*").alias("shipments"),
        rounded(F.lit(100.0) * (F.lit(1.0) - F.avg("is_late")), 2).alias("on_time_delivery_pct"),
        whole_sum("is_late").alias("late_shipments"),
        rounded(F.avg("delivery_delay_days"), 2).alias("avg_delay_days"),
        rounded(money_sum("line_value_usd"), 0).alias("total_commodity_value_usd"),
        rounded(money_sum(parsed_freight), 0).alias("total_freight_spend_usd"),
        whole_sum("packs_ordered").alias("total_packs"),
        whole_sum("units_ordered").alias("total_units"),
        percent(F.count("vendor_lead_time_days"), F.count("*"), 1).alias(
            "vendor_lead_time_coverage_pct"
        ),
        F.min("date_delivered").cast("string").alias("date_from"),
        F.max("date_delivered").cast("string").alias("date_to"),
    )
    # a distinct count in the same aggregate would expand every row
    levels = distinct_per_column(df, KPI_COUNTS)
    delay, freight, lead = column_medians(df, list(KPI_MEDIANS))
    target = F.lit(settings.on_time_target_pct)
    return merge_single_rows(sums, levels).withColumns(
        {
            "median_delay_days": rounded(F.lit(delay).cast("double"), 1),
            "median_freight_pct_of_value": rounded(F.lit(freight).cast("double"), 2),
            "median_vendor_lead_time_days": rounded(F.lit(lead).cast("double"), 1),
            "on_time_target_pct": target,
            "meets_on_time_target": F.col("on_time_delivery_pct") >= target,
        }
    )
