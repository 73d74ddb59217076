"""Catalogue structure, spend concentration and unit-price analysis."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dockline.config import DEFAULTS, Settings
from dockline.functions.columns import (
    distinct_per_column,
    match_rows,
    merge_single_rows,
    money_sum,
    on_time_pct,
    percent,
    rounded,
    tally,
    whole_sum,
)
from dockline.plans.quantiles import grouped_quantiles
from dockline.plans.ranking import running, settled

PRODUCT_KEY = ["molecule", "dosage", "dosage_form"]
CATALOGUE_COUNTS = {
    "catalogue_items": "item_description",
    "molecules": "molecule",
    "brands": "brand",
    "dosages": "dosage",
    "dosage_forms": "dosage_form",
    "manufacturing_sites": "manufacturing_site",
    "vendors": "vendor",
    "product_groups": "product_group",
}


def _is_priced() -> Column:
    test = F.col("unit_price_usd") > 0
    for name in PRODUCT_KEY:
        test = test & F.col(name).isNotNull()
    return test


def priced(df: DataFrame) -> DataFrame:
    """Rows with a recorded unit price and a complete product key."""
    return df.filter(_is_priced())


def catalogue_kpis(df: DataFrame) -> DataFrame:
    """Distinct counts per catalogue dimension, generic share and priced coverage."""
    rows = F.count("*")
    generic = tally(F.col("brand") == "Generic")
    usable = tally(_is_priced())
    sums = df.agg(
        rows.alias("line_items"),
        generic.alias("generic_line_items"),
        percent(generic, rows, 2).alias("generic_share_pct"),
        usable.alias("priced_line_items"),
        percent(usable, rows, 2).alias("priced_coverage_pct"),
        rounded(money_sum("line_value_usd"), 0).alias("total_value_usd"),
    )
    return merge_single_rows(sums, distinct_per_column(df, CATALOGUE_COUNTS))


def product_mix(df: DataFrame) -> DataFrame:
    """Value, share and on-time rate by product group, largest first."""
    groups = df.groupBy("product_group").agg(
        F.count("*").alias("line_items"),
        money_sum("line_value_usd").alias("value"),
        F.countDistinct("molecule").alias("molecules"),
        whole_sum("is_late").alias("late"),
    )
    total = df.agg(money_sum("line_value_usd")).scalar()
    return groups.select(
        "product_group",
        "line_items",
        rounded(F.col("value"), 0).alias("value_usd"),
        rounded(F.lit(100.0) * F.try_divide(F.col("value"), total), 2).alias("value_share_pct"),
        "molecules",
        on_time_pct(F.col("late"), F.col("line_items")).alias("on_time_pct"),
    ).orderBy(F.col("value_usd").desc(), "product_group")


def top_products(df: DataFrame, top_n: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Highest-value products with the price range paid; sorted on the unrounded value."""
    limit = settings.top_n_products if top_n is None else top_n
    rows = priced(df)
    best = (
        rows.groupBy(*PRODUCT_KEY)
        .agg(money_sum("line_value_usd").alias("value"))
        .orderBy(F.col("value").desc(), *PRODUCT_KEY)
        .limit(limit)
    )
    best = settled(best)
    kept = rows.join(F.broadcast(best), PRODUCT_KEY, "left_semi")  # at most top_n rows
    sums = kept.groupBy(*PRODUCT_KEY).agg(
        F.count("*").alias("line_items"),
        F.countDistinct("manufacturing_site").alias("sites"),
        F.countDistinct("vendor").alias("vendors"),
        F.min("unit_price_usd").alias("low"),
        F.max("unit_price_usd").alias("high"),
    )
    middle = grouped_quantiles(kept, PRODUCT_KEY, {"middle": ("unit_price_usd", 0.5)})
    return (
        best.join(sums, PRODUCT_KEY)
        .join(middle, PRODUCT_KEY)
        .orderBy(F.col("value").desc(), *PRODUCT_KEY)
        .select(
            *PRODUCT_KEY,
            "line_items",
            rounded(F.col("value"), 0).alias("value_usd"),
            "sites",
            "vendors",
            rounded(F.col("middle"), 4).alias("median_unit_price_usd"),
            rounded(F.col("low"), 4).alias("min_unit_price_usd"),
            rounded(F.col("high"), 4).alias("max_unit_price_usd"),
        )
    )


def _with_labels(products: DataFrame) -> DataFrame:
    """Display label; the form is added only where molecule and dosage are ambiguous."""
    base = F.concat_ws(" ", "molecule", "dosage")
    labelled = products.withColumn("_base", base)
    repeats = labelled.groupBy("_base").agg(F.count("*").alias("_same"))
    full = F.concat(F.col("_base"), F.lit(" ("), F.col("dosage_form"), F.lit(")"))
    return (
        labelled.join(repeats, "_base")
        .withColumn("product", F.when(F.col("_same") > 1, full).otherwise(F.col("_base")))
        .drop("_base", "_same")
    )


class Concentration(NamedTuple):
    products: DataFrame
    summary: DataFrame


def value_concentration(df: DataFrame, top_n: int | None = None) -> Concentration:
    """Products by value with share and running share, and the top-5/top-15 summary.

    The running share adds the shares already rounded to two places.
    """
    rows = priced(df)
    total = rows.agg(money_sum("line_value_usd")).scalar()
    grouped = rows.groupBy(*PRODUCT_KEY).agg(
        F.count("*").alias("line_items"),
        money_sum("line_value_usd").alias("value"),
        F.countDistinct("manufacturing_site").alias("sites"),
    )
    share = rounded(F.lit(100.0) * F.try_divide(F.col("value"), total), 2)
    grouped = _with_labels(grouped.withColumn("value_share_pct", share))
    order = [F.col("value").desc(), *[F.col(k).asc() for k in PRODUCT_KEY]]
    ranked = running(grouped, order, row_number="rank", sums={"upto": "value_share_pct"})
    ranked = ranked.withColumn("cumulative_share_pct", rounded(F.col("upto"), 2))
    summary = ranked.agg(
        F.count("*").alias("products_total"),
        rounded(F.max(F.when(F.col("rank") == 5, F.col("cumulative_share_pct"))), 1).alias("top_5_share_pct"),
        rounded(F.max(F.when(F.col("rank") == 15, F.col("cumulative_share_pct"))), 1).alias("top_15_share_pct"),
        rounded(money_sum("value"), 0).alias("total_value_usd"),
    )
    shown = ranked if top_n is None else ranked.filter(F.col("rank") <= top_n)
    products = shown.orderBy("rank").select(
        "product",
        *PRODUCT_KEY,
        "line_items",
        rounded(F.col("value"), 0).alias("value_usd"),
        "value_share_pct",
        "cumulative_share_pct",
        "sites",
        "rank",
    )
    return Concentration(products, summary)


def pareto_crossing(concentration: DataFrame, level: float) -> DataFrame:
    """First rank whose cumulative share reaches ``level``; null if none does."""
    reached = F.col("cumulative_share_pct") >= level
    return concentration.agg(F.min(F.when(reached, F.col("rank"))).alias("crossed_at"))


def _spread(rows: DataFrame, keys: list[str], settings: Settings, median: bool) -> DataFrame:
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("line_items"),
        F.countDistinct("manufacturing_site").alias("sites"),
        F.countDistinct("vendor").alias("vendors"),
        money_sum("line_value_usd").alias("value"),
        F.min("unit_price_usd").alias("min_price"),
        F.max("unit_price_usd").alias("max_price"),
    )
    out = out.filter(
        (F.col("line_items") >= settings.min_shipments_for_spread)
        & (F.col("sites") >= settings.min_sites_for_spread)
    ).withColumn("spread_x", rounded(F.col("max_price") / F.col("min_price"), 1))
    if not median:
        return out
    middle = grouped_quantiles(rows, keys, {"median_price": ("unit_price_usd", 0.5)})
    return out.join(middle, keys, "left").select(
        *keys,
        "line_items",
        "sites",
        "vendors",
        rounded(F.col("value"), 0).alias("value_usd"),
        *[rounded(F.col(c), 4).alias(c) for c in ("min_price", "median_price", "max_price")],
        "spread_x",
        "value",
    )


def _dated(df: DataFrame) -> DataFrame:
    return priced(df).filter(F.col("delivery_year").isNotNull())


def price_spread(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Price range per product over all years pooled (inflated by market-wide change)."""
    out = _spread(priced(df), PRODUCT_KEY, settings, median=True)
    return out.orderBy(F.col("value").desc(), *PRODUCT_KEY).drop("value")


def price_spread_within_year(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Price range per product inside one delivery year, widest first."""
    keys = [*PRODUCT_KEY, "delivery_year"]
    out = _spread(_dated(df), keys, settings, median=True)
    return out.drop("value").orderBy(F.col("spread_x").desc(), *keys)


def _one_product(rows: DataFrame, molecule: str, dosage: str | None) -> DataFrame:
    rows = rows.filter(F.col("molecule") == molecule)
    return rows if dosage is None else rows.filter(F.col("dosage") == dosage)


def price_trend(df: DataFrame, molecule: str = "Efavirenz", dosage: str | None = "600mg") -> DataFrame:
    """Unit-price range of one product per delivery year."""
    rows = _one_product(_dated(df), molecule, dosage)
    keys = ["delivery_year"]
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("line_items"),
        F.countDistinct("manufacturing_site").alias("sites"),
        rounded(F.min("unit_price_usd"), 4).alias("min_price"),
        rounded(F.max("unit_price_usd"), 4).alias("max_price"),
    )
    middle = grouped_quantiles(rows, keys, {"median_price": ("unit_price_usd", 0.5)})
    return (
        sums.join(middle, keys)
        .withColumn("median_price", rounded(F.col("median_price"), 4))
        .select(*keys, "line_items", "sites", "min_price", "median_price", "max_price")
        .orderBy(*keys)
    )


def price_decline(trend: DataFrame) -> DataFrame:
    """Fall of the median price from the first to the last year, in percent."""
    first = F.min_by("median_price", "delivery_year")
    last = F.max_by("median_price", "delivery_year")
    fall = rounded(F.lit(100.0) * (F.lit(1.0) - last / first), 1)
    return trend.agg(F.when(first == 0, F.lit(0.0)).otherwise(fall).alias("decline_pct"))


def recent_price_gap(trend: DataFrame, from_year: int = 2013) -> DataFrame:
    """Median yearly maximum over the median yearly median, from a given year on."""
    recent = trend.filter(F.col("delivery_year") >= from_year)
    middles = grouped_quantiles(
        recent, [], {"median_of_max": ("max_price", 0.5), "median_of_median": ("median_price", 0.5)}
    )
    gap = F.try_divide(F.col("median_of_max"), F.col("median_of_median"))
    return middles.withColumn("gap_x", rounded(gap, 1))


def site_prices(
    df: DataFrame,
    molecule: str = "Nevirapine",
    dosage: str | None = "200mg",
    year: int | None = None,
) -> DataFrame:
    """What each factory charged for one product, cheapest first."""
    rows = _one_product(priced(df), molecule, dosage)
    if year is not None:
        rows = rows.filter(F.col("delivery_year") == year)
    keys = ["manufacturing_site"]
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("line_items"),
        money_sum("line_value_usd").alias("value"),
        whole_sum("is_late").alias("late"),
    )
    middle = grouped_quantiles(rows, keys, {"middle": ("unit_price_usd", 0.5)})
    return (
        match_rows(sums, middle, keys)
        .select(
            *keys,
            "line_items",
            rounded(F.col("middle"), 4).alias("median_unit_price_usd"),
            rounded(F.col("value"), 0).alias("value_usd"),
            on_time_pct(F.col("late"), F.col("line_items")).alias("on_time_pct"),
        )
        .orderBy("median_unit_price_usd", *keys)
    )


class Premium(NamedTuple):
    rows: DataFrame
    summary: DataFrame


def brand_premium(df: DataFrame, settings: Settings = DEFAULTS) -> Premium:
    """Generic against branded unit price per molecule, dosage and year.

    Both arms must be present. A row without a brand counts towards the group
    size but enters neither arm.
    """
    keys = ["molecule", "dosage", "delivery_year"]
    generic = F.col("brand") == "Generic"
    rows = _dated(df)
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("line_items"),
        tally(generic).alias("_generic"),
        tally(~generic).alias("_branded"),
    )
    sums = sums.filter(
        (F.col("line_items") >= settings.min_shipments_for_spread)
        & (F.col("_generic") > 0)
        & (F.col("_branded") > 0)
    )
    prices = grouped_quantiles(
        rows,
        keys,
        {
            "generic": (F.when(generic, F.col("unit_price_usd")), 0.5),
            "branded": (F.when(~generic, F.col("unit_price_usd")), 0.5),
        },
    )
    # Row limit per group: each task keeps two brands per group before the shuffle.
    place = F.row_number().over(W.partitionBy(*keys).orderBy("brand"))
    names = rows.filter(~generic).select(*keys, "brand").distinct()
    names = names.withColumn("_place", place).filter("_place <= 2")
    names = names.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("brand")), ", ").alias("branded_brand"))
    label = F.concat(
        F.col("molecule"), F.lit(" "), F.col("dosage"),
        F.lit(" ("), F.col("delivery_year").cast("string"), F.lit(")"),
    )
    out = (
        sums.join(prices, keys)
        .join(names, keys)
        .select(
            *keys,
            label.alias("label"),
            "line_items",
            rounded(F.col("generic"), 4).alias("generic_price"),
            rounded(F.col("branded"), 4).alias("branded_price"),
            rounded(F.col("branded") / F.col("generic"), 1).alias("premium_x"),
            "branded_brand",
        )
    )
    out = settled(out)
    middle = grouped_quantiles(out, [], {"median_premium_x": ("premium_x", 0.5)})
    summary = merge_single_rows(
        middle.select(rounded(F.col("median_premium_x"), 1).alias("median_premium_x")),
        out.agg(F.count("*").alias("product_years")),
    )
    return Premium(out.orderBy(F.col("premium_x").desc(), *keys), summary)


def pricing_summary(
    df: DataFrame,
    molecule: str = "Efavirenz",
    dosage: str | None = "600mg",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Pooled against within-year spread, the premium and the text to quote, in one row."""
    keys = [*PRODUCT_KEY, "delivery_year"]
    pooled = settled(_spread(priced(df), PRODUCT_KEY, settings, median=False))
    within = settled(_spread(_dated(df), keys, settings, median=False))
    worst = within.orderBy(F.col("spread_x").desc(), *keys).limit(1)
    case = F.format_string(
        "%s %s in %d: $%.2f to $%.2f (%.1fx across %d factories)",
        "molecule", "dosage", "delivery_year",
        rounded(F.col("min_price"), 4), rounded(F.col("max_price"), 4), "spread_x", "sites",
    )
    parts = merge_single_rows(
        grouped_quantiles(pooled, [], {"_pooled": ("spread_x", 0.5)}),
        pooled.agg(F.count("*").alias("pooled_products")),
        grouped_quantiles(within, [], {"_within": ("spread_x", 0.5)}),
        within.agg(F.count("*").alias("within_year_products")),
        worst.select(case.alias("widest_case"), F.col("spread_x").alias("widest_spread_x")),
        price_decline(price_trend(df, molecule, dosage)).withColumnRenamed("decline_pct", "reference_decline_pct"),
        brand_premium(df, settings).summary.withColumnsRenamed(
            {"median_premium_x": "brand_premium_x", "product_years": "brand_premium_product_years"}
        ),
    )
    product = f"{molecule} {dosage or ''}".strip()
    verdict = F.format_string(
        "Pooled over all years the median spread is %.1fx, which mixes supplier differences with market-wide "
        f"change ({product}: %.0f%% decline). Within one year it is %.1fx over %d product-years; quote that. "
        "Branded product costs a median of %.1fx the generic price in the same year.",
        "_pooled", "reference_decline_pct", "_within", "within_year_products", "brand_premium_x",
    )
    return parts.select(
        rounded(F.col("_pooled"), 1).alias("pooled_median_spread_x"),
        "pooled_products",
        rounded(F.col("_within"), 1).alias("within_year_median_spread_x"),
        "within_year_products",
        F.coalesce("widest_case", F.lit("none")).alias("widest_case"),
        "widest_spread_x",
        "reference_decline_pct",
        "brand_premium_x",
        "brand_premium_product_years",
        rounded(F.try_divide(F.col("_pooled"), F.col("_within")), 2).alias("inflation_factor"),
        verdict.alias("verdict"),
    )


def value_reconciliation(df: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Share of rows where pack price times quantity equals the line value."""
    gap = F.abs(F.col("pack_price_usd") * F.col("quantity") - F.col("line_value_usd"))
    return df.agg(
        F.count("*").alias("line_items"),
        tally(gap <= tolerance).alias("reconciled"),
        percent(tally(gap <= tolerance), F.count("*"), 2).alias("reconciled_pct"),
    )
