"""From the shipment table as published (text) to its interpreted form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockline.functions.columns import inline_rows, match_rows, percent, ratio, tally
from dockline.functions.parsing import (
    DAY_FIRST,
    MONTH_FIRST,
    REASONS,
    date_reason,
    number_reason,
    parsed_date,
    parsed_number,
)

# Published header -> column name.
COLUMN_NAMES = {
    "ID": "shipment_id",
    "Project Code": "project_code",
    "PQ #": "pq_number",
    "PO / SO #": "po_number",
    "ASN/DN #": "asn_number",
    "Country": "country",
    "Managed By": "managed_by",
    "Fulfill Via": "fulfil_via",
    "Vendor INCO Term": "inco_term",
    "Shipment Mode": "shipment_mode",
    "Product Group": "product_group",
    "Sub Classification": "sub_classification",
    "Vendor": "vendor",
    "Item Description": "item_description",
    "Molecule/Test Type": "molecule",
    "Brand": "brand",
    "Dosage": "dosage",
    "Dosage Form": "dosage_form",
    "Unit of Measure (Per Pack)": "units_per_pack",
    "Line Item Quantity": "quantity",
    "Line Item Value": "line_value_usd",
    "Pack Price": "pack_price_usd",
    "Unit Price": "unit_price_usd",
    "Manufacturing Site": "manufacturing_site",
    "First Line Designation": "first_line_designation",
    "Line Item Insurance (USD)": "insurance_usd",
    "PQ First Sent to Client Date": "date_pq_sent",
    "PO Sent to Vendor Date": "date_po_sent",
    "Scheduled Delivery Date": "date_scheduled",
    "Delivered to Client Date": "date_delivered",
    "Delivery Recorded Date": "date_recorded",
}
MIXED_NUMBERS = {
    "Freight Cost (USD)": ("freight_cost_usd", "freight_cost_reason"),
    "Weight (Kilograms)": ("weight_kg", "weight_reason"),
}
PUBLISHED_COLUMNS = [*COLUMN_NAMES, *MIXED_NUMBERS]
WHOLE_NUMBERS = ("shipment_id", "units_per_pack", "quantity")
DECIMAL_NUMBERS = ("line_value_usd", "pack_price_usd", "unit_price_usd", "insurance_usd")
DATE_PATTERNS = {
    "date_pq_sent": MONTH_FIRST,
    "date_po_sent": MONTH_FIRST,
    "date_scheduled": DAY_FIRST,
    "date_delivered": DAY_FIRST,
    "date_recorded": DAY_FIRST,
}
TRIMMED = (
    "country",
    "vendor",
    "manufacturing_site",
    "shipment_mode",
    "product_group",
    "sub_classification",
    "dosage_form",
    "brand",
    "molecule",
    "managed_by",
    "fulfil_via",
    "inco_term",
)
# Commodity code -> readable name.
PRODUCT_GROUP_NAMES = {
    "ARV": "Antiretroviral (ARV)",
    "HRDT": "HIV Rapid Diagnostic Test",
    "ACT": "Artemisinin Combination Therapy",
    "MRDT": "Malaria Rapid Diagnostic Test",
    "ANTM": "Anti-malarial",
}
# Region -> destination countries.
REGION_COUNTRIES = {
    "Southern Africa": (
        "South Africa", "Zimbabwe", "Zambia", "Mozambique", "Namibia", "Botswana", "Lesotho",
        "Swaziland", "Malawi", "Angola",
    ),
    "East Africa": (
        "Kenya", "Tanzania", "Uganda", "Ethiopia", "Rwanda", "Burundi", "South Sudan", "Sudan",
    ),
    "West & Central Africa": (
        "Nigeria", "Ghana", "Côte d'Ivoire", "Cameroon", "Congo, DRC", "Benin", "Burkina Faso",
        "Mali", "Senegal", "Guinea", "Liberia", "Sierra Leone", "Togo",
    ),
    "Latin America & Caribbean": (
        "Haiti", "Guyana", "Guatemala", "Belize", "Dominican Republic",
    ),
    "Asia": ("Vietnam", "Pakistan", "Afghanistan"),
    "Central Asia": ("Kazakhstan", "Kyrgyzstan"),
    "Middle East & North Africa": ("Lebanon", "Libya"),
}


def rename_published(published: DataFrame) -> DataFrame:
    """Readable snake_case names; unlisted columns keep theirs."""
    return published.withColumnsRenamed(COLUMN_NAMES)


def published_types(published: DataFrame) -> DataFrame:
    """The published table with its seven purely numeric columns as numbers.

    This is the form the audit of the published layer works on: mixed columns
    stay text, because text is what they hold.
    """
    by_name = {v: k for k, v in COLUMN_NAMES.items()}
    whole = {by_name[c]: F.col(f"`{by_name[c]}`").try_cast("long") for c in WHOLE_NUMBERS}
    real = {by_name[c]: F.col(f"`{by_name[c]}`").try_cast("double") for c in DECIMAL_NUMBERS}
    return published.withColumns({**whole, **real})


def region_of(country: Column) -> Column:
    """Region of a country from the fixed table, ``Other`` when unlisted."""
    region = None
    for name, countries in REGION_COUNTRIES.items():
        test = country.isin(*countries)
        region = F.when(test, name) if region is None else region.when(test, name)
    return region.otherwise("Other")


def group_name_of(code: Column) -> Column:
    """Readable commodity name, or the code itself."""
    name = None
    for key, text in PRODUCT_GROUP_NAMES.items():
        test = code == key
        name = F.when(test, text) if name is None else name.when(test, text)
    return name.otherwise(code)


def derived_columns() -> dict[str, Column]:
    """Delay, lead times, guarded ratios, quantities and calendar keys."""
    delivered, scheduled = F.col("date_delivered"), F.col("date_scheduled")
    delay = F.datediff(delivered, scheduled)
    return {
        "delivery_delay_days": delay,
        "is_late": F.when(delay.isNotNull(), (delay > 0).cast("int")),
        "vendor_lead_time_days": F.datediff(delivered, F.col("date_po_sent")),
        "total_lead_time_days": F.datediff(delivered, F.col("date_pq_sent")),
        "recording_lag_days": F.datediff(F.col("date_recorded"), delivered),
        "scheduled_lead_time_days": F.datediff(scheduled, F.col("date_pq_sent")),
        "freight_pct_of_value": ratio(
            F.lit(100.0) * F.col("freight_cost_usd"), F.col("line_value_usd")
        ),
        "freight_cost_per_kg": ratio(F.col("freight_cost_usd"), F.col("weight_kg")),
        "packs_ordered": F.col("quantity"),
        "units_ordered": F.col("quantity") * F.col("units_per_pack"),
        "delivery_year": F.year(delivered),
        "delivery_month": F.date_format(delivered, "yyyy-MM"),
        "delivery_quarter": F.concat(
            F.year(delivered).cast("string"), F.lit("Q"), F.quarter(delivered).cast("string")
        ),
    }


def interpret(published: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Typed, reason-coded shipment table from the text table.

    ``regions`` (columns ``country``, ``region``, one row per country) replaces
    the built-in country table. Row-local except for that join.
    """
    renamed = rename_published(published)
    dates = {}
    for name, pattern in DATE_PATTERNS.items():
        day = parsed_date(F.col(name), pattern)
        dates[name] = day
        dates[f"{name}_reason"] = date_reason(F.col(name), day)
    numbers = {}
    for source, (name, reason) in MIXED_NUMBERS.items():
        text = F.col(f"`{source}`")
        numbers[name] = parsed_number(text)
        numbers[reason] = number_reason(text, parsed_number(text))
    typed = {c: F.trim(F.col(c)).try_cast("long") for c in WHOLE_NUMBERS}
    typed |= {c: parsed_number(F.col(c)) for c in DECIMAL_NUMBERS}
    trimmed = {c: F.trim(F.col(c)) for c in TRIMMED}
    trimmed["shipment_mode"] = F.coalesce(trimmed["shipment_mode"], F.lit("Unknown"))
    table = renamed.withColumns({**dates, **numbers, **typed, **trimmed}).drop(*MIXED_NUMBERS)

    if regions is None:
        table = table.withColumn("region", region_of(F.col("country")))
    else:
        table = table.join(regions.select("country", "region"), "country", "left")
        table = table.withColumn("region", F.coalesce("region", F.lit("Other")))
    table = table.withColumns(
        {
            "product_group_name": group_name_of(F.col("product_group")),
            "is_from_rdc": F.coalesce((F.col("fulfil_via") == "From RDC").cast("int"), F.lit(0)),
        }
    )
    return table.withColumns(derived_columns())


def parsing_report(df: DataFrame) -> DataFrame:
    """How every reason-coded field was resolved: one row per field."""
    fields = [c for c in df.columns if c.endswith("_reason")]
    wide = df.agg(
        F.count("*").alias("rows"),
        *[F.count(c).alias(f"total{i}") for i, c in enumerate(fields)],
        *[tally(F.col(c) == reason).alias(f"{reason}{i}") for i, c in enumerate(fields) for reason in REASONS],
    )
    counted = inline_rows(
        wide.filter("rows > 0"),
        [
            {
                "field": F.lit(c.removesuffix("_reason")),
                **{reason: F.col(f"{reason}{i}") for reason in REASONS},
                "parsed_pct": percent(F.col(f"parsed{i}"), F.col(f"total{i}"), 2),
            }
            for i, c in enumerate(fields)
        ],
    )
    return counted.orderBy("parsed_pct", "field")


def with_era(
    df: DataFrame, cutoff_year: int, early: str = "early", late: str = "late"
) -> DataFrame:
    """Era label by delivery year; a null year falls in the later era."""
    if "era" in df.columns:
        return df
    return df.withColumn(
        "era", F.when(F.col("delivery_year") <= cutoff_year, early).otherwise(late)
    )


def with_flat_containers(df: DataFrame) -> DataFrame:
    """Array cells joined to text and map or struct cells as JSON, so rows can be hashed."""
    flat = {}
    for part in df.schema.fields:
        kind = part.dataType.typeName()
        if kind == "array":
            flat[part.name] = F.array_join(
                F.transform(F.col(f"`{part.name}`"), lambda v: v.cast("string")), ", ", "None"
            )
        elif kind in ("map", "struct"):
            flat[part.name] = F.to_json(F.col(f"`{part.name}`"))
    return df.withColumns(flat) if flat else df
