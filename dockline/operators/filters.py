"""Row filters shared by reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockline.plans.ranking import small_or_stored


def filter_options(df: DataFrame, fields: list[str]) -> DataFrame:
    """Distinct levels per field, for fields with more than one level."""
    present = [f for f in fields if f in df.columns]
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("level"))
                for f in present
            ]
        )
    )
    levels = df.select(cells.alias("c")).select("c.*").filter("level is not null").distinct()
    several = levels.groupBy("field").agg(F.count("*").alias("n")).filter("n > 1")
    kept = small_or_stored(several.select("field"))
    return levels.join(kept, "field", "left_semi").orderBy("field", "level")


def filter_levels(df: DataFrame, selections: dict[str, list]) -> DataFrame:
    """Keep rows whose fields hold a selected level; an empty selection keeps all."""
    for name, levels in selections.items():
        if levels and name in df.columns:
            df = df.filter(F.col(name).isin(*levels))
    return df


def parsed_only(df: DataFrame, field: str) -> DataFrame:
    """Rows whose value of a reason-coded field was a real value."""
    return df.filter(F.col(f"{field}_reason") == "parsed")
