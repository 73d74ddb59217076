"""Cleaning, validating and deriving features of the patient table."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockline.config import DEFAULTS, Settings
from dockline.functions.columns import inline_rows, merge_single_rows, rounded, tally
from dockline.functions.parsing import NUMBER_SHAPE
from dockline.operators.quality import duplicate_report, most_frequent
from dockline.plans.quantiles import grouped_quantiles
from dockline.plans.ranking import settled

CATEGORICAL = ("Sex", "BP", "Cholesterol")
NUMERIC = ("Age", "Na_to_K")
TARGET = "Drug"
# Accepted levels and the ordinal severity of a level.
ALLOWED = {"Sex": ("F", "M"), "BP": ("HIGH", "LOW", "NORMAL"), "Cholesterol": ("HIGH", "NORMAL")}
SEVERITY = {"HIGH": 2.0, "NORMAL": 1.0, "LOW": 0.0}
ENGINEERED_NUMERIC = ("bp_risk_score", "cholesterol_risk", "combined_risk_score", "high_na_to_k")
ENGINEERED_CATEGORICAL = ("age_group", "na_to_k_band")


class Cleaned(NamedTuple):
    frame: DataFrame
    log: DataFrame


def _require(df: DataFrame) -> None:
    absent = sorted(set(CATEGORICAL + NUMERIC) - set(df.columns))
    if absent:
        raise ValueError(f"patient table lacks column(s) {absent}; present: {sorted(df.columns)}")


def as_number(df: DataFrame, name: str) -> Column:
    """The column as a double; text that is no number becomes null."""
    if df.schema[name].dataType.typeName() == "string":
        text = F.trim(F.col(name))
        return F.when(text.rlike(NUMBER_SHAPE), text.try_cast("double"))
    return F.col(name).cast("double")


def standard_text(name: str) -> Column:
    return F.upper(F.trim(F.col(name)))


def clean_patients(df: DataFrame) -> Cleaned:
    """Standardised text, numbers, trimmed target, exact duplicates dropped.

    The log counts real edits per column and the dropped copies.
    """
    _require(df)
    blank = F.lit("")
    edits = [
        tally(F.coalesce(F.col(c), blank) != F.coalesce(standard_text(c), blank)).alias(f"{c}_edited")
        for c in CATEGORICAL
    ]
    edits += [
        tally(F.col(c).isNotNull() & as_number(df, c).isNull()).alias(f"{c}_not_numeric") for c in NUMERIC
    ]
    columns = {c: standard_text(c) for c in CATEGORICAL} | {c: as_number(df, c) for c in NUMERIC}
    if TARGET in df.columns:
        columns[TARGET] = F.trim(F.col(TARGET))
    out = df.withColumns(columns).dropDuplicates()
    counts = merge_single_rows(
        df.agg(F.count("*").alias("rows_in"), *edits), out.agg(F.count("*").alias("rows_out"))
    )
    return Cleaned(
        out, counts.withColumn("duplicates_dropped", F.col("rows_in") - F.col("rows_out"))
    )


def clean_and_impute(df: DataFrame, max_age: float = 120.0) -> Cleaned:
    """Standardise, null impossible ages, deduplicate, then impute; one log row per step.

    Numbers take the median and categories the most frequent level (the smaller
    one on a tie), both of the deduplicated rows.
    """
    _require(df)
    age = as_number(df, "Age")
    impossible = (age < 0) | (age > max_age)
    ranged = df.withColumns(
        {
            **{c: standard_text(c) for c in CATEGORICAL},
            "Age": F.when(~impossible, age),
            "Na_to_K": as_number(df, "Na_to_K"),
        }
    )
    unique = settled(ranged.dropDuplicates())
    medians = grouped_quantiles(unique, [], {c: (c, 0.5) for c in NUMERIC})
    modes = settled(most_frequent(unique, list(CATEGORICAL)))
    filled = {c: F.coalesce(F.col(c), medians.select(c).scalar()) for c in NUMERIC}
    for c in CATEGORICAL:
        filled[c] = F.coalesce(F.col(c), modes.filter(F.col("column") == c).select("top").scalar())
    out = unique.withColumns(filled)

    before = df.agg(
        F.count("*").alias("rows"),
        *[tally(F.col(c) != standard_text(c)).alias(f"s_{c}") for c in CATEGORICAL],
        tally(impossible).alias("ranged"),
    )
    after = unique.agg(
        F.count("*").alias("kept"),
        *[tally(F.col(c).isNull()).alias(f"m_{c}") for c in NUMERIC + CATEGORICAL],
    )
    steps = [("standardise text", c, F.col(f"s_{c}")) for c in CATEGORICAL]
    steps.append(("range check", "Age", F.col("ranged")))
    steps.append(("deduplicate", "<all>", F.col("rows") - F.col("kept")))
    steps += [("median imputation", c, F.col(f"m_{c}")) for c in NUMERIC]
    steps += [("mode imputation", c, F.col(f"m_{c}")) for c in CATEGORICAL]
    log = inline_rows(
        merge_single_rows(before, after),
        [
            {"step_order": F.lit(i), "step": F.lit(step), "column": F.lit(c), "rows_fixed": n}
            for i, (step, c, n) in enumerate(steps, 1)
        ],
    )
    return Cleaned(out, log)


def cleaning_assertions(df: DataFrame, max_age: float = 120.0) -> DataFrame:
    """Seven named checks on a cleaned patient table, each PASS or FAIL."""
    columns = [c for c in df.columns]
    nulls = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])

    def never(test: Column) -> Column:
        return tally(test) == 0

    wide = df.agg(
        never(nulls).alias("c0"),
        *[never(~F.col(c).isin(*ALLOWED[c])).alias(f"c{i}") for i, c in enumerate(CATEGORICAL, 2)],
        never((F.col("Age") < 0) | (F.col("Age") > max_age)).alias("c5"),
        never(F.col("Na_to_K") <= 0).alias("c6"),
    )
    copies = duplicate_report(df).summary.select((F.col("exact_duplicate_rows") == 0).alias("c1"))
    names = (
        "No missing values", "No duplicate rows", "Sex valid", "BP valid", "Cholesterol valid",
        f"Age within [0, {max_age:g}]", "Na_to_K positive",
    )
    return inline_rows(
        merge_single_rows(wide, copies),
        [
            {"check": F.lit(name), "result": F.when(F.col(f"c{i}"), "PASS").otherwise("FAIL")}
            for i, name in enumerate(names)
        ],
    )


def ordinal_score(level: Column) -> Column:
    score = None
    for name, value in SEVERITY.items():
        score = F.when(level == name, value) if score is None else score.when(level == name, value)
    return score


def engineer_features(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Age and ratio bands (left-closed), high-ratio flag, ordinal severity and their sum."""
    _require(df)
    age, ratio = F.col("Age"), F.col("Na_to_K")
    group = None
    for edge, label in zip(settings.age_edges, settings.age_labels):
        group = F.when(age < edge, label) if group is None else group.when(age < edge, label)
    group = F.when(age.isNotNull(), group.otherwise(settings.age_labels[-1]))
    band = F.when(ratio < settings.ratio_low, "Low").when(ratio < settings.ratio_high, "Normal")
    return df.withColumns(
        {
            "age_group": group,
            "na_to_k_band": F.when(ratio.isNotNull(), band.otherwise("High")),
            "high_na_to_k": F.coalesce((ratio >= settings.ratio_high).cast("int"), F.lit(0)),
            "bp_risk_score": ordinal_score(F.col("BP")),
            "cholesterol_risk": ordinal_score(F.col("Cholesterol")),
        }
    ).withColumn("combined_risk_score", F.col("bp_risk_score") + F.col("cholesterol_risk"))


def feature_columns() -> tuple[list[str], list[str]]:
    """Numeric and categorical model inputs of the patient model."""
    return list(NUMERIC + ENGINEERED_NUMERIC), list(CATEGORICAL + ENGINEERED_CATEGORICAL)


class Screened(NamedTuple):
    accepted: DataFrame
    quarantined: DataFrame


def screen_inputs(
    df: DataFrame,
    allowed: dict[str, tuple[str, ...]] | None = None,
    minimum: dict[str, float] | None = None,
) -> Screened:
    """Canonical levels and finite bounded numbers, or quarantine with the failing fields.

    Levels match regardless of case and blanks and take the spelling of the
    allowed list; numbers must be finite and not below their minimum.
    """
    allowed = ALLOWED if allowed is None else allowed
    minimum = {"Age": 0.0, "Na_to_K": 0.0} if minimum is None else minimum
    columns, tests = {}, {}
    for name, levels in allowed.items():
        if name not in df.columns:
            continue
        level = None
        for canonical in levels:
            same = standard_text(name) == canonical.strip().upper()
            level = F.when(same, canonical) if level is None else level.when(same, canonical)
        columns[name] = level
        tests[name] = level.isNotNull()
    for name, bound in minimum.items():
        number = as_number(df, name)
        finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
        columns[name] = number
        tests[name] = finite & (number >= bound)
    failing = F.array_compact(
        F.array(*[F.when(~F.coalesce(test, F.lit(False)), name) for name, test in tests.items()])
    )
    marked = df.withColumn("invalid_fields", F.array_join(F.array_sort(failing), ", "))
    valid = F.col("invalid_fields") == ""
    return Screened(
        marked.filter(valid).withColumns(columns).drop("invalid_fields"), marked.filter(~valid)
    )


# --- descriptive checks ---------------------------------------------------------------
def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per class, largest first."""
    total = df.filter(F.col(label).isNotNull()).agg(F.count("*")).scalar()
    counted = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label"))
    return (
        counted.agg(F.count("*").alias("n"))
        .withColumn("share_pct", rounded(F.lit(100.0) * F.col("n") / total, 1))
        .orderBy(F.col("n").desc(), "label")
    )


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """Largest over smallest class and the majority-class baseline accuracy."""
    counted = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return counted.agg(
        F.count("*").alias("classes"),
        rounded(F.max("n") / F.min("n"), 4).alias("imbalance_ratio"),
        rounded(F.max("n") / F.sum("n"), 4).alias("baseline_accuracy"),
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k * n_class) per class."""
    counted = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label"))
    counted = settled(counted.agg(F.count("*").alias("n")))
    total, classes = counted.agg(F.sum("n")).scalar(), counted.agg(F.count("*")).scalar()
    return counted.withColumn("weight", total / (classes * F.col("n"))).orderBy("label")


def boundary_gap(df: DataFrame, value: str, label: str, level: str) -> DataFrame:
    """Smallest value inside one class and largest outside it."""
    inside = F.col(label) == level
    return df.agg(
        F.min(F.when(inside, F.col(value))).alias("class_min"),
        F.max(F.when(~inside, F.col(value))).alias("others_max"),
    )


def functional_dependency(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Whether a feature tuple fixes the label: tuples, conflicting tuples, verdict."""
    tuples = df.groupBy(*features).agg((F.min(label) != F.max(label)).alias("conflict"))
    return tuples.agg(
        F.count("*").alias("tuples"),
        tally(F.col("conflict")).alias("conflicting"),
        (tally(F.col("conflict")) == 0).alias("holds"),
    )
