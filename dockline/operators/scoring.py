"""Scoring rows with a stored model, and the text and bands read off the score."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockline.config import DEFAULTS, Settings
from dockline.functions.columns import rounded
from dockline.operators import clinical, evaluation
from dockline.operators.training import LATE_CATEGORICAL, LATE_NUMERIC, with_class_columns
from dockline.plans.ranking import stored_copy

# Levels named as drivers of late delivery.
SLOW_MODES = ("Ocean", "Truck")
WEAK_REGIONS = ("West & Central Africa", "Southern Africa", "East Africa")
LONG_LEAD_DAYS = 250


def clinical_explanation() -> Column:
    """One sentence per scored patient from the engineered features."""
    high = F.when(F.col("high_na_to_k") == 1, ", which decides most such cases").otherwise("")
    return F.concat(
        F.format_string("Age group %s, pressure %s, cholesterol %s, risk points %d of 4; ",
                        "age_group", "BP", "Cholesterol", F.col("combined_risk_score").cast("int")),
        F.format_string("Na/K ratio %.2f, band %s", "Na_to_K", "na_to_k_band"),
        high,
        F.format_string(". The model says %s (%.1f%%).", "prediction", F.col("confidence") * 100),
    )


def known_levels(model: PipelineModel) -> dict[str, tuple[str, ...]]:
    """Levels the fitted indexer was trained on, per categorical column."""
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel):
            return {c: tuple(v) for c, v in zip(stage.getInputCols(), stage.labelsArray)}
    return {}


def probability_map(labels: list[str]) -> Column:
    """Label to rounded probability, highest first."""
    pairs = [F.struct(rounded(F.col(f"proba_{v}"), 4).alias("p"), F.lit(v).alias("label")) for v in labels]
    ordered = F.sort_array(F.array(*pairs), asc=False)
    return F.map_from_entries(F.transform(ordered, lambda s: F.struct(s["label"], s["p"])))


def predict_patients(
    model: PipelineModel, metadata: dict, patients: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Scored cohort and quarantined rows.

    Other columns are kept and rows are never merged. Accepted levels are those
    the fitted encoder knows. A single patient is a frame of one row.
    """
    labels = metadata["class_labels"]
    levels = known_levels(model)
    allowed = {c: levels[c] for c in clinical.CATEGORICAL if c in levels}
    screened = clinical.screen_inputs(patients, allowed)
    numbers = {c: F.col(c).cast("double") for c in metadata["numeric_features"]}
    ready = clinical.engineer_features(screened.accepted).withColumns(numbers)
    scored = with_class_columns(model.transform(ready), labels).drop("prediction")
    scored = scored.withColumnRenamed("predicted", "prediction")
    out = scored.select(
        *patients.columns,
        "prediction",
        rounded(F.col("confidence"), 4).alias("confidence"),
        *[rounded(F.col(f"proba_{v}"), 4).alias(f"proba_{v}") for v in labels],
        probability_map(labels).alias("probabilities"),
        clinical_explanation().alias("explanation"),
    )
    return out, screened.quarantined


def _late_design(shipments: DataFrame) -> DataFrame:
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) for c in LATE_CATEGORICAL}
    numbers = {c: F.col(c).cast("double") for c in LATE_NUMERIC}
    return shipments.withColumns(filled | numbers)


def late_probability(model: PipelineModel, metadata: dict, shipments: DataFrame) -> DataFrame:
    """Shipments with their predicted probability of arriving late.

    The untouched columns of the input are kept; model columns are dropped.
    """
    labels = metadata["class_labels"]
    name = f"proba_{'Late' if 'Late' in labels else labels[1]}"
    scored = with_class_columns(model.transform(_late_design(shipments)), labels)
    return scored.select(*shipments.columns, F.col(name).alias("late_risk_probability"))


def score_late_risk(
    model: PipelineModel, metadata: dict, shipments: DataFrame, ties: list[str]
) -> DataFrame:
    """Late probability of every shipment and its decile (1 is the highest risk).

    The model runs once: the scored rows are stored, and the passes of the rank selection read
    scores and ties from there.
    """
    scored = stored_copy(late_probability(model, metadata, shipments))
    return evaluation.with_deciles(scored, "late_risk_probability", ties, "late_risk_decile")


def with_risk_band(df: DataFrame, probability: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Call, band and driver text per scored shipment."""
    p = F.col(probability)
    band = F.when(p >= settings.high_risk, "High").when(p >= settings.elevated_risk, "Elevated").otherwise("Low")
    lead = F.col("scheduled_lead_time_days")
    drivers = F.array_compact(
        F.array(
            F.when(F.col("fulfil_via") == "From RDC", F.lit("distribution centre fulfilment")),
            F.when(F.col("shipment_mode").isin(*SLOW_MODES), F.concat("shipment_mode", F.lit(" transport"))),
            F.when(F.col("region").isin(*WEAK_REGIONS), F.concat("region", F.lit(" destination"))),
            F.when(
                lead > LONG_LEAD_DAYS,
                F.concat(F.lit("long planned lead time ("), lead.cast("int").cast("string"), F.lit(" days)")),
            ),
        )
    )
    # format_string would round half up on the decimal text; the probability is rounded first
    lead_text = F.concat(F.lit("Late with probability "), F.format_string("%.1f", rounded(100.0 * p, 1)), F.lit(" % ("), F.lower(band), F.lit(" risk). "))
    listed = F.concat(lead_text, F.when(
        F.size(drivers) > 0, F.concat(F.lit("Drivers: "), F.array_join(drivers, "; "), F.lit("."))
    ).otherwise("No dominant driver."))
    return df.withColumns(
        {
            "prediction": F.when(p >= 0.5, "Late").otherwise("On Time"),
            "late_probability": rounded(p, 4),
            "risk_band": band,
            "explanation": listed,
        }
    )
