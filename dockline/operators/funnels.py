"""Value and lateness funnels, milestone traceability and their headline figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockline.config import DEFAULTS
from dockline.functions.columns import (
    inline_rows,
    merge_single_rows,
    money_sum,
    percent,
    rounded,
    tally,
)
from dockline.plans.quantiles import grouped_quantiles

MILESTONES = (
    ("Price quote sent to client", "date_pq_sent"),
    ("Purchase order sent to vendor", "date_po_sent"),
    ("Delivery scheduled", "date_scheduled"),
    ("Delivered to client", "date_delivered"),
    ("Delivery recorded in system", "date_recorded"),
)


def _value_if(test: Column) -> Column:
    return money_sum(F.when(test, F.col("line_value_usd")))


def value_funnel(df: DataFrame) -> DataFrame:
    """Four nested delivery standards by value and count; each stage is a subset of the last."""
    on_time, exact = F.col("is_late") == 0, F.col("delivery_delay_days") == 0
    wide = df.agg(
        F.count("*").alias("n1"),
        money_sum("line_value_usd").alias("v1"),
        tally(on_time).alias("n3"),
        _value_if(on_time).alias("v3"),
        tally(exact).alias("n4"),
        _value_if(exact).alias("v4"),
    )
    stages = [
        ("Value ordered", "1", "all line items"),
        ("Value delivered", "1", "every line item was delivered"),
        ("Delivered on or before schedule", "3", "delivery_delay_days <= 0"),
        ("Delivered exactly on the scheduled day", "4", "delivery_delay_days == 0"),
    ]
    return inline_rows(
        wide,
        [
            {
                "stage_order": F.lit(i),
                "stage": F.lit(stage),
                "value_usd": rounded(F.col(f"v{k}"), 0),
                "share_pct": rounded(F.lit(100.0) * F.try_divide(F.col(f"v{k}"), F.col("v1")), 2),
                "line_items": F.col(f"n{k}"),
                "basis": F.lit(basis),
            }
            for i, (stage, k, basis) in enumerate(stages, 1)
        ],
    )


def value_funnel_summary(df: DataFrame) -> DataFrame:
    """Late and early value and the share of rows delivered on the exact day."""
    delay = F.col("delivery_delay_days")
    return df.agg(
        rounded(money_sum("line_value_usd") - _value_if(F.col("is_late") == 0), 0).alias(
            "late_value_usd"
        ),
        rounded(_value_if(delay < 0), 0).alias("early_value_usd"),
        percent(tally(delay == 0), F.count("*"), 2).alias("exact_day_share_pct"),
    )


def lateness_funnel(
    df: DataFrame, thresholds: tuple[int, ...] = DEFAULTS.lateness_thresholds
) -> DataFrame:
    """Share arriving within N days of schedule, and a worst-case row over all rows."""
    delay = F.col("delivery_delay_days")
    wide = df.agg(
        F.count("*").alias("n"),
        money_sum("line_value_usd").alias("v"),
        F.max(delay).alias("worst"),
        *[tally(delay <= t).alias(f"n{i}") for i, t in enumerate(thresholds)],
        *[_value_if(delay <= t).alias(f"v{i}") for i, t in enumerate(thresholds)],
    )
    rows = [
        {
            "threshold_days": F.lit(t),
            "label": F.lit("On or before schedule" if t == 0 else f"Within {t} days late"),
            "value_usd": rounded(F.col(f"v{i}"), 0),
            "share_pct": rounded(F.lit(100.0) * F.try_divide(F.col(f"v{i}"), F.col("v")), 2),
            "line_items": F.col(f"n{i}"),
            "items_share_pct": percent(F.col(f"n{i}"), F.col("n"), 2),
        }
        for i, t in enumerate(thresholds)
    ]
    rows.append(
        {
            "threshold_days": F.col("worst"),
            "label": F.lit("All deliveries (worst case)"),
            "value_usd": rounded(F.col("v"), 0),
            "share_pct": F.lit(100.0),
            "line_items": F.col("n"),
            "items_share_pct": F.lit(100.0),
        }
    )
    return inline_rows(wide, rows)


def traceability(df: DataFrame) -> DataFrame:
    """Recording coverage per milestone, structural absence apart from real gaps."""
    counts = []
    for i, (_, column) in enumerate(MILESTONES):
        reason = F.col(f"{column}_reason") if f"{column}_reason" in df.columns else F.lit(None)
        counts += [
            F.count(column).alias(f"r{i}"),
            tally(reason == "structural").alias(f"s{i}"),
            tally(reason == "missing").alias(f"m{i}"),
        ]
    wide = df.agg(F.count("*").alias("n"), *counts)
    rows = []
    for i, (stage, column) in enumerate(MILESTONES):
        absent, missing = F.col(f"s{i}"), F.col(f"m{i}")
        absent_note = (
            " came from stock, which needs no order to a vendor"
            if column == "date_po_sent"
            else " are older than the quote records"
        )
        note = (
            F.when(absent > 0, F.concat(F.format_number(absent, 0), F.lit(absent_note)))
            .when(missing > 0, F.concat(F.format_number(missing, 0), F.lit(" should have a date and have none")))
            .otherwise("Every row has a date")
        )
        rows.append(
            {
                "stage": F.lit(stage),
                "recorded": F.col(f"r{i}"),
                "coverage_pct": percent(F.col(f"r{i}"), F.col("n"), 2),
                "structurally_absent": absent,
                "genuinely_missing": missing,
                "interpretation": note,
            }
        )
    return inline_rows(wide, rows)


def funnel_kpis(df: DataFrame) -> DataFrame:
    """Headline value, timing and traceability figures in one row."""
    delay, on_time = F.col("delivery_delay_days"), F.col("is_late") == 0
    value, good = money_sum("line_value_usd"), _value_if(on_time)
    sums = df.agg(
        F.count("*").alias("line_items"),
        rounded(value, 0).alias("value_ordered_usd"),
        rounded(good, 0).alias("value_on_time_usd"),
        rounded(value - good, 0).alias("value_late_usd"),
        rounded(F.lit(100.0) * F.try_divide(good, value), 2).alias("value_on_time_pct"),
        percent(tally(on_time), F.count("is_late"), 2).alias("items_on_time_pct"),
        percent(tally(delay == 0), F.count("*"), 2).alias("exact_day_pct"),
        percent(tally(delay < 0), F.count("*"), 2).alias("early_pct"),
        percent(tally(delay > 0), F.count("*"), 2).alias("late_pct"),
        percent(F.count("date_po_sent"), F.count("*"), 2).alias("po_traceability_pct"),
    )
    tails = grouped_quantiles(
        df,
        [],
        {
            "median_quote_to_delivery_days": ("total_lead_time_days", 0.5),
            "p90_quote_to_delivery_days": ("total_lead_time_days", 0.9),
        },
    )
    return merge_single_rows(sums, tails).withColumns(
        {
            "median_quote_to_delivery_days": rounded(F.col("median_quote_to_delivery_days"), 1),
            "p90_quote_to_delivery_days": rounded(F.col("p90_quote_to_delivery_days"), 1),
        }
    )
