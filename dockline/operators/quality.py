"""Data-quality audit: completeness, uniqueness, validity, outliers, profile,
consistency, a weighted score and a remediation plan.

Reports are small frames (a row per column, rule or check). What they count is declared
as named aggregates of one row: a report asked for alone computes its own, a full audit
computes those of all reports in one scan and hands the row to each. Moments, quartiles,
fences and levels are reduced by task from column batches; no cell is exploded. The
score and the plan read the other reports.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockline.config import DEFAULTS, QualitySettings
from dockline.functions.columns import (
    any_of,
    inline_rows,
    match_rows,
    merge_single_rows,
    nan_to_null,
    percent,
    rounded,
    tally,
)
from dockline.functions.parsing import NUMBER_SHAPE
from dockline.operators.ingest import with_flat_containers
from dockline.plans.levels import level_summary
from dockline.plans.moments import column_moments, exact_quantiles, merged_moments, outside_counts
from dockline.plans.quantiles import BROADCAST_CELLS
from dockline.plans.ranking import settled

QUALITY = DEFAULTS.quality
NUMERIC = (T.NumericType, T.BooleanType)
DATED = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Rule:
    """Allowed levels, or an inclusive range with either end open."""

    allowed: tuple = ()
    low: float | None = None
    high: float | None = None

    def text(self) -> str:
        if self.allowed:
            return "value in {" + ", ".join(sorted(str(v) for v in self.allowed)) + "}"
        if self.low is not None and self.high is not None:
            return f"{self.low} <= value <= {self.high}"
        if self.low is not None:
            return f"value >= {self.low}"
        if self.high is not None:
            return f"value <= {self.high}"
        return "no constraint"


class Check(NamedTuple):
    left: str
    right: str
    operator: str
    description: str


# Declared domains by column name, then by name prefix or suffix.
NAMED_RULES = {
    "Sex": Rule(allowed=("M", "F")),
    "BP": Rule(allowed=("HIGH", "NORMAL", "LOW")),
    "Cholesterol": Rule(allowed=("HIGH", "NORMAL")),
    "Drug": Rule(allowed=("DrugY", "drugA", "drugB", "drugC", "drugX")),
    "Age": Rule(low=0, high=120),
    "Na_to_K": Rule(low=0, high=100),
    "is_late": Rule(allowed=(0, 1)),
    "Shipment Mode": Rule(allowed=("Air", "Truck", "Air Charter", "Ocean")),
    "Fulfill Via": Rule(allowed=("From RDC", "Direct Drop")),
    "First Line Designation": Rule(allowed=("Yes", "No")),
    "Line Item Quantity": Rule(low=0),
    "Line Item Value": Rule(low=0),
    "Pack Price": Rule(low=0),
    "Unit Price": Rule(low=0),
    "Unit of Measure (Per Pack)": Rule(low=1),
    "delivery_delay_days": Rule(low=-400, high=400),
    "freight_cost_usd": Rule(low=0),
    "weight_kg": Rule(low=0),
    "price_inr": Rule(low=0, high=500_000),
    "price(\u20b9)": Rule(low=0, high=500_000),
    "ingredient_count": Rule(low=0, high=10),
    "pack_quantity": Rule(low=0),
}
PREFIX_RULES = {"units_": Rule(low=0)}
SUFFIX_RULES = {"_usd": Rule(low=0), "_pct": Rule(low=0, high=100)}
CHECKS = (
    Check("date_po_sent", "date_delivered", "<=", "An order dated after its delivery is out of sequence."),
    Check("date_pq_sent", "date_delivered", "<=", "A quote dated after the delivery is out of sequence."),
    Check("date_delivered", "date_recorded", "<=", "A delivery entered before its date is out of sequence."),
)
SEVERITIES = ("High", "Medium", "Low", "None")


def _kinds(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric and boolean columns; dates are not numbers."""
    return [n for n, kind in _kinds(df).items() if isinstance(kind, NUMERIC)]


def _cell(df: DataFrame, name: str) -> Column:
    """The column with NaN counted as absent."""
    column = F.col(f"`{name}`")
    return nan_to_null(column) if isinstance(_kinds(df)[name], (T.DoubleType, T.FloatType)) else column


def _facts(df: DataFrame, facts: DataFrame | None, own: dict[str, Column]) -> DataFrame:
    """One row with the aggregates `own`, computed here unless `facts` has them already."""
    return df.agg(*[value.alias(name) for name, value in own.items()]) if facts is None else facts


def _total_order(df: DataFrame) -> list[Column]:
    """All columns that can be ordered, so that ties leave only equal rows."""
    return [F.col(f"`{name}`") for name, kind in _kinds(df).items() if not isinstance(kind, T.MapType)]


def _empty(df: DataFrame, schema: str) -> DataFrame:
    """Typed empty report, so a report has the same schema whatever applies."""
    return df.sparkSession.createDataFrame([], schema)


# --- rules -----------------------------------------------------------------------
def default_rules(df: DataFrame) -> dict[str, Rule]:
    """Rules for the columns present: by name, else by prefix, else by suffix.

    Prefix and suffix rules bind numeric columns only.
    """
    numeric = set(numeric_columns(df))
    rules = {}
    for name in df.columns:
        if name in NAMED_RULES:
            rules[name] = NAMED_RULES[name]
        elif name in numeric:
            matches = [r for p, r in PREFIX_RULES.items() if name.startswith(p)]
            matches += [r for s, r in SUFFIX_RULES.items() if name.endswith(s)]
            if matches:
                rules[name] = matches[0]
    return rules


def violation(df: DataFrame, name: str, rule: Rule) -> Column:
    """True where a present value breaks the rule; null is never a violation.

    Text under a range rule counts as a violation unless it reads as a number.
    """
    value = _cell(df, name)
    if rule.allowed:
        return value.isNotNull() & ~value.isin(*rule.allowed)
    if isinstance(_kinds(df)[name], NUMERIC):
        number = value.cast("double")
    else:
        text = F.trim(value.cast("string"))
        number = F.when(text.rlike(NUMBER_SHAPE), text.try_cast("double"))
    outside = [number.isNull()]
    if rule.low is not None:
        outside.append(number < rule.low)
    if rule.high is not None:
        outside.append(number > rule.high)
    return value.isNotNull() & any_of(outside)


def applicable_checks(df: DataFrame, checks: tuple[Check, ...] = CHECKS) -> list[Check]:
    """Checks whose two columns are present and both dates or both numbers."""
    kinds = _kinds(df)
    kept = []
    for check in checks:
        pair = [kinds.get(check.left), kinds.get(check.right)]
        if all(isinstance(k, DATED) for k in pair) or all(isinstance(k, NUMERIC) for k in pair):
            kept.append(check)
    return kept


def breach(df: DataFrame, check: Check) -> Column:
    """True where both sides are present and the comparison does not hold."""
    left, right = _cell(df, check.left), _cell(df, check.right)
    holds = {
        "<=": left <= right,
        ">=": left >= right,
        "<": left < right,
        ">": left > right,
    }[check.operator]
    return left.isNotNull() & right.isNotNull() & ~holds


# --- completeness ----------------------------------------------------------------
def _presence_facts(df: DataFrame) -> dict[str, Column]:
    counts = {f"c{i}": F.count(_cell(df, name)) for i, name in enumerate(df.columns)}
    return {"rows": F.count("*"), **counts}


def missing_value_report(
    df: DataFrame, settings: QualitySettings = QUALITY, facts: DataFrame | None = None
) -> DataFrame:
    """Nulls per column with a severity, worst first."""
    kinds = _kinds(df)
    if not kinds:
        return _empty(
            df,
            "column string, dtype string, missing_count long, missing_pct double, "
            "non_null_count long, severity string",
        )
    report = inline_rows(
        _facts(df, facts, _presence_facts(df)),
        [
            {
                "column": F.lit(name),
                "dtype": F.lit(kind.simpleString()),
                "missing_count": F.col("rows") - F.col(f"c{i}"),
                "missing_pct": percent(F.col("rows") - F.col(f"c{i}"), F.col("rows")),
                "non_null_count": F.col(f"c{i}"),
            }
            for i, (name, kind) in enumerate(kinds.items())
        ],
    )
    severity = (
        F.when(F.col("missing_count") == 0, "None")
        .when(F.col("missing_pct") < settings.missing_low_pct, "Low")
        .when(F.col("missing_pct") <= settings.missing_high_pct, "Medium")
        .otherwise("High")
    )
    return report.withColumn("severity", severity).orderBy(F.col("missing_pct").desc(), "column")


# --- uniqueness ------------------------------------------------------------------
class Duplicates(NamedTuple):
    summary: DataFrame
    examples: DataFrame
    key_examples: DataFrame


def _repeated_rows(df: DataFrame) -> DataFrame:
    """Rows that occur more than once, grouped, with their number of copies.

    Only 8-byte row hashes are shuffled for the whole table. Rows whose hash
    repeats are then grouped on all columns, which settles hash collisions.
    """
    plain = [
        F.col(f"`{n}`") + F.lit(0.0) if isinstance(k, (T.DoubleType, T.FloatType)) else F.col(f"`{n}`")
        for n, k in _kinds(df).items()
    ]
    hashed = df.withColumn("_hash", F.xxhash64(*plain))
    repeated = settled(hashed.groupBy("_hash").agg(F.count("*").alias("_n")).filter("_n > 1").select("_hash"))
    count = repeated.count()
    if count <= BROADCAST_CELLS:
        repeated = F.broadcast(repeated)  # counted just above
    suspects = hashed.join(repeated, "_hash", "left_semi").drop("_hash")
    return (
        suspects.groupBy(*[F.col(f"`{c}`") for c in df.columns])
        .agg(F.count("*").alias("copies"))
        .filter("copies > 1")
    )


def duplicate_report(
    df: DataFrame,
    subset: list[str] | None = None,
    settings: QualitySettings = QUALITY,
    key_groups: DataFrame | None = None,
) -> Duplicates:
    """Redundant copies of whole rows and of a business key, with a few example rows.

    A copy is a row beyond the first of its kind. Key columns that are absent
    are ignored; without any key the key columns of the summary are null. A caller
    that has counted the distinct keys gives them as ``key_groups`` (one row, ``n``).
    """
    df = with_flat_containers(df)
    repeated = settled(_repeated_rows(df))
    parts = [
        df.agg(F.count("*").alias("total_rows")),  # of a stored table, its footers
        repeated.agg(
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long").alias("exact_duplicate_rows")
        ),
    ]
    shown = repeated.orderBy(F.col("copies").desc(), *_total_order(df)).limit(settings.sample_rows)
    key = [c for c in (subset or []) if c in df.columns]
    if key:
        quoted = [F.col(f"`{c}`") for c in key]
        keys = df.groupBy(*quoted).agg(F.count("*").alias("_n"))
        groups = keys.agg(F.count("*").alias("n")) if key_groups is None else key_groups
        parts.append(groups.select(F.col("n").alias("_key_groups")))
        first_keys = keys.filter("_n > 1").orderBy(*quoted).limit(settings.sample_rows).drop("_n")
        key_examples = match_rows(df, F.broadcast(first_keys), key, "left_semi")  # sample_rows rows
        key_examples = key_examples.orderBy(*quoted, *_total_order(df)).limit(settings.sample_rows)
    else:
        key_examples = df.limit(0)
    summary = merge_single_rows(*parts)
    spare = (F.col("total_rows") - F.col("_key_groups")) if key else F.lit(None)
    # an empty table has no key groups and no figure for them
    summary = summary.withColumn("key_duplicate_rows", F.when(F.col("total_rows") > 0, spare.cast("long")))
    total = F.col("total_rows")
    summary = summary.select(
        "total_rows",
        F.coalesce("exact_duplicate_rows", F.lit(0)).alias("exact_duplicate_rows"),
        percent(F.col("exact_duplicate_rows"), total).alias("duplicate_pct"),
        F.lit(", ".join(key)).alias("key_columns"),
        "key_duplicate_rows",
        F.when(F.col("key_duplicate_rows").isNotNull(), percent(F.col("key_duplicate_rows"), total)).alias(
            "key_duplicate_pct"
        ),
    )
    return Duplicates(summary, shown, key_examples)


# --- validity --------------------------------------------------------------------
VALIDITY_SCHEMA = (
    "column string, rule string, checked long, violations long, violation_pct double, sample_bad_values string"
)


def _present_rules(df: DataFrame, rules: dict[str, Rule] | None) -> dict[str, Rule]:
    rules = default_rules(df) if rules is None else rules
    return {name: rule for name, rule in rules.items() if name in df.columns}


def _rule_facts(df: DataFrame, rules: dict[str, Rule]) -> dict[str, Column]:
    facts = {f"n{i}": F.count(_cell(df, name)) for i, name in enumerate(rules)}
    return facts | {f"v{i}": tally(violation(df, name, rule)) for i, (name, rule) in enumerate(rules.items())}


def validity_report(
    df: DataFrame,
    rules: dict[str, Rule] | None = None,
    settings: QualitySettings = QUALITY,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Every rule with its checked values, violations and a few offending values.

    Passing rules are listed too. The sample holds the smallest distinct
    offending values as text; each task keeps a handful before the shuffle. The table
    is read for samples only if a rule is broken.
    """
    rules = _present_rules(df, rules)
    if not rules:
        return _empty(df, VALIDITY_SCHEMA)
    facts = settled(_facts(df, None, _rule_facts(df, rules))) if facts is None else facts
    broken = facts.select(*[f"v{i}" for i in range(len(rules))]).first()
    tests = {name: violation(df, name, rule) for i, (name, rule) in enumerate(rules.items()) if broken[i]}
    report = inline_rows(
        facts,
        [
            {
                "column": F.lit(name),
                "rule": F.lit(rule.text()),
                "checked": F.col(f"n{i}"),
                "violations": F.col(f"v{i}"),
                "violation_pct": percent(F.col(f"v{i}"), F.col(f"n{i}")),
            }
            for i, (name, rule) in enumerate(rules.items())
        ],
    )
    if not tests:
        return report.withColumn("sample_bad_values", F.lit("")).orderBy(
            F.col("violations").desc(), F.col("violation_pct").desc(), "column"
        )
    offending = F.array(
        *[
            F.when(
                F.coalesce(test, F.lit(False)),
                F.struct(F.lit(name).alias("column"), F.col(f"`{name}`").cast("string").alias("bad")),
            )
            for name, test in tests.items()
        ]
    )
    place = F.row_number().over(W.partitionBy("column").orderBy("bad"))
    samples = (
        df.select(F.explode(F.array_compact(offending)).alias("c"))
        .select("c.*")
        .distinct()
        .withColumn("_place", place)
        .filter(F.col("_place") <= settings.sample_rows)
        .groupBy("column")
        .agg(F.array_join(F.array_sort(F.collect_list("bad")), ", ").alias("sample_bad_values"))
    )
    return (
        report.join(samples, "column", "left")
        .withColumn("sample_bad_values", F.coalesce("sample_bad_values", F.lit("")))
        .orderBy(F.col("violations").desc(), F.col("violation_pct").desc(), "column")
    )


# --- numeric profile and outliers --------------------------------------------------
QUARTILES = (0.25, 0.5, 0.75)


def _number(df: DataFrame, name: str) -> Column:
    return _cell(df, name).cast("double")


def numeric_profile(df: DataFrame) -> DataFrame | None:
    """Moments and quartiles of every numeric column with a value (a row each), stored once.

    Skew and kurtosis carry the sample correction. Two scans, the second for the values
    around the quartiles.
    """
    columns = numeric_columns(df)
    if not columns:
        return None
    values = [_number(df, name) for name in columns]
    parts = settled(column_moments(df, values))
    moments = settled(merged_moments(parts))
    rows = {row["place"]: row["n"] for row in moments.collect()}  # one row per column
    quartiles = exact_quantiles(df, values, rows, parts, QUARTILES)
    listed = [(place, columns[place], *map(float, q)) for place, q in quartiles.items()]
    named = df.sparkSession.createDataFrame(listed, "place int, column string, q25 double, median double, q75 double")
    n = F.col("n").cast("double")
    flat = F.col("low") == F.col("high")
    skew = F.sqrt(n) * F.col("m3") / F.pow("m2", F.lit(1.5)) * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (n * F.col("m4") / (F.col("m2") * F.col("m2")) - 3) + 6)
    profile = moments.join(F.broadcast(named), "place").select(  # one row per column
        "column",
        "n",
        "mean",
        F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).alias("sd"),
        F.sqrt(F.col("m2") / n).alias("sd_pop"),
        "low",
        "high",
        "zeros",
        "negatives",
        "q25",
        "median",
        "q75",
        F.when(n > 2, F.when(flat, F.lit(0.0)).otherwise(skew)).alias("skew"),
        F.when(n > 3, F.when(flat, F.lit(0.0)).otherwise(kurt)).alias("kurtosis"),
    )
    return settled(profile)


OUTLIER_SCHEMA = (
    "column string, method string, lower_bound double, upper_bound double, outlier_count long, "
    "outlier_pct double, min double, max double"
)


def outlier_report(
    df: DataFrame,
    method: str | None = None,
    settings: QualitySettings = QUALITY,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Values outside Tukey fences (``iqr``) or z-score bounds, per continuous column.

    Columns with at most two distinct values or without spread are left out.
    """
    chosen = (method or settings.outlier_method).lower()
    if chosen not in ("iqr", "zscore"):
        raise ValueError(f"unknown outlier method {chosen!r}; use 'iqr' or 'zscore'")
    columns = numeric_columns(df)
    if not columns:
        return _empty(df, OUTLIER_SCHEMA)
    profile = numeric_profile(df) if profile is None else profile
    if chosen == "iqr":
        spread = F.col("q75") - F.col("q25")
        lower = F.col("q25") - settings.iqr_multiplier * spread
        upper = F.col("q75") + settings.iqr_multiplier * spread
    else:
        spread = F.col("sd_pop")
        lower = F.col("mean") - settings.zscore_threshold * spread
        upper = F.col("mean") + settings.zscore_threshold * spread
    bounds = profile.filter(spread > 0).select(
        "column", "n", lower.alias("lower"), upper.alias("upper"), "low", "high"
    ).collect()  # one row per column of the table
    if not bounds:
        return _empty(df, OUTLIER_SCHEMA)
    ends = [tuple(float(row[k]) for k in ("lower", "upper", "low", "high")) for row in bounds]
    counts = outside_counts(df, [_number(df, row["column"]) for row in bounds], ends)
    held = df.sparkSession.createDataFrame(
        [(place, row["column"], row["n"], *end) for place, (row, end) in enumerate(zip(bounds, ends, strict=True))],
        "place int, column string, n long, lower double, upper double, low double, high double",
    )
    return (
        counts.join(F.broadcast(held), "place")  # one row per column
        .filter("third > 0")
        .select(
            "column",
            F.lit(chosen).alias("method"),
            rounded(F.col("lower"), 4).alias("lower_bound"),
            rounded(F.col("upper"), 4).alias("upper_bound"),
            F.col("outside").alias("outlier_count"),
            percent(F.col("outside"), F.col("n")).alias("outlier_pct"),
            rounded(F.col("low"), 4).alias("min"),
            rounded(F.col("high"), 4).alias("max"),
        )
        .orderBy(F.col("outlier_pct").desc(), "column")
    )


# --- profile -----------------------------------------------------------------------
FRACTIONAL = (T.DoubleType, T.FloatType, T.DecimalType)


def _level_cell(df: DataFrame, name: str, as_text: bool) -> Column:
    """The column as its levels are counted: whole numbers as they are, the rest as text.

    Fractional numbers whose text is not wanted are counted without making any.
    """
    kind = _kinds(df)[name]
    if isinstance(kind, NUMERIC) and not (isinstance(kind, FRACTIONAL) and as_text) and not isinstance(kind, T.DecimalType):
        return _cell(df, name)
    return _cell(df, name).cast("string")


def _levels(df: DataFrame, cells: dict[str, Column]) -> DataFrame:
    names = F.array(*[F.lit(n) for n in cells])
    return level_summary(df, cells).select(F.element_at(names, F.col("place") + 1).alias("column"), "unique", "top", "freq")


def most_frequent(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct count, most frequent value and its count per column, as text.

    Equal counts are settled by the smaller value. A task holds a part of a
    column's levels.
    """
    columns = df.columns if columns is None else columns
    return _levels(df, {name: _level_cell(df, name, True) for name in columns})


KEY = "<key>"


def table_levels(df: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Levels of every column; `top` of fractional numbers is not meant to be read.

    With a key, a row named ``<key>`` counts its distinct values, nulls included.
    """
    cells = {name: _level_cell(df, name, False) for name in df.columns}
    quoted = [F.col(f"`{c}`") for c in (key or []) if c in df.columns]
    if quoted:
        cells[KEY] = F.to_json(F.struct(*quoted), {"ignoreNullFields": "false"})
    return settled(_levels(df, cells))


def _own_levels(df: DataFrame, key: list[str]) -> bool:
    """Whether the distinct keys are the levels of one column and, where some are missing, null."""
    return len(key) == 1 and isinstance(_kinds(df)[key[0]], (T.IntegralType, T.StringType, T.BooleanType, T.DateType))


def _range_facts(df: DataFrame) -> dict[str, Column]:
    dated = [(i, n) for i, (n, k) in enumerate(_kinds(df).items()) if isinstance(k, DATED)]
    first = {f"first{i}": F.min(f"`{n}`").cast("string") for i, n in dated}
    return first | {f"last{i}": F.max(f"`{n}`").cast("string") for i, n in dated}


def summary_statistics(
    df: DataFrame,
    profile: DataFrame | None = None,
    facts: DataFrame | None = None,
    levels: DataFrame | None = None,
) -> DataFrame:
    """Profile of every column: moments for numbers, levels for the rest, range for dates."""
    df = with_flat_containers(df)
    kinds = _kinds(df)
    numeric = set(numeric_columns(df))
    if profile is None:
        profile = numeric_profile(df)
    if profile is None:
        profile = _empty(
            df,
            "column string, n long, mean double, sd double, low double, high double, zeros long, "
            "negatives long, q25 double, median double, q75 double, skew double, kurtosis double",
        )
    dated = [n for n, k in kinds.items() if isinstance(k, DATED)]
    wide = _facts(df, facts, _presence_facts(df) | _range_facts(df))
    none = F.lit(None).cast("string")
    base = inline_rows(
        wide,
        [
            {
                "column": F.lit(n),
                "col_type": F.lit(
                    "numeric" if n in numeric else "datetime" if n in dated else "categorical"
                ),
                "count": F.col(f"c{i}"),
                "first_date": F.col(f"first{i}") if n in dated else none,
                "last_date": F.col(f"last{i}") if n in dated else none,
            }
            for i, n in enumerate(kinds)
        ],
    )
    levels = table_levels(df) if levels is None else levels
    joined = base.join(profile, "column", "left").join(levels, "column", "left")
    is_number = F.col("col_type") == "numeric"
    known = ("mean", "q25", "median", "q75", "skew", "kurtosis")
    return joined.select(
        "column",
        "col_type",
        "count",
        F.coalesce("unique", F.lit(0)).alias("unique"),
        *[rounded(F.col(c), 4).alias(c) for c in known],
        rounded(F.col("sd"), 4).alias("std"),
        rounded(F.col("low"), 4).alias("min"),
        rounded(F.col("high"), 4).alias("max"),
        F.when(is_number, F.coalesce("zeros", F.lit(0))).alias("zeros"),
        F.when(is_number, F.coalesce("negatives", F.lit(0))).alias("negatives"),
        F.when(~is_number, F.coalesce("top", F.lit(""))).alias("top"),
        F.when(~is_number, F.coalesce("freq", F.lit(0))).alias("freq"),
        F.when(~is_number, percent(F.coalesce("freq", F.lit(0)), F.col("count"))).alias("top_pct"),
        "first_date",
        "last_date",
    )


# --- consistency ---------------------------------------------------------------------
CONSISTENCY_SCHEMA = (
    "check_name string, description string, checked long, violations long, violation_pct double, passed boolean"
)


def _check_facts(df: DataFrame, kept: list[Check]) -> dict[str, Column]:
    both = {f"both{i}": tally(_cell(df, c.left).isNotNull() & _cell(df, c.right).isNotNull()) for i, c in enumerate(kept)}
    return both | {f"breach{i}": tally(breach(df, c)) for i, c in enumerate(kept)}


def consistency_report(
    df: DataFrame, checks: tuple[Check, ...] = CHECKS, facts: DataFrame | None = None
) -> DataFrame:
    """Cross-field invariants over rows where both sides are present."""
    kept = applicable_checks(df, checks)
    if not kept:
        return _empty(df, CONSISTENCY_SCHEMA)
    report = inline_rows(
        _facts(df, facts, _check_facts(df, kept)),
        [
            {
                "check_name": F.lit(f"{c.left} {c.operator} {c.right}"),
                "description": F.lit(c.description),
                "checked": F.col(f"both{i}"),
                "violations": F.col(f"breach{i}"),
                "violation_pct": percent(F.col(f"breach{i}"), F.col(f"both{i}")),
                "passed": F.col(f"breach{i}") == 0,
            }
            for i, c in enumerate(kept)
        ],
    )
    return report.filter("checked > 0").orderBy(F.col("violations").desc(), "check_name")


# --- score -----------------------------------------------------------------------------
def grade_of(score: Column, settings: QualitySettings = QUALITY) -> Column:
    grade = None
    for letter, bound in sorted(settings.grade_bands, key=lambda band: -band[1]):
        test = score >= bound
        grade = F.when(test, letter) if grade is None else grade.when(test, letter)
    return grade.otherwise("F")


def _record_facts(df: DataFrame, rules: dict[str, Rule]) -> dict[str, Column]:
    """Cells that are filled, records that break a rule, records that break a check."""
    broken = any_of([violation(df, n, r) for n, r in rules.items() if n in df.columns])
    torn = any_of([breach(df, c) for c in applicable_checks(df)])
    filled = reduce(lambda a, b: a + b, [F.count(_cell(df, n)) for n in df.columns], F.lit(0).cast("long"))
    return {"filled": filled, "broken": tally(broken), "torn": tally(torn)}


def data_quality_score(
    df: DataFrame,
    subset: list[str] | None = None,
    rules: dict[str, Rule] | None = None,
    settings: QualitySettings = QUALITY,
    duplicates: DataFrame | None = None,
    outliers: DataFrame | None = None,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Five dimensions, weighted score, grade and verdict in one row.

    Validity and consistency count records, not values; each column's outlier
    share is capped; a dimension with nothing to measure scores 100.
    """
    flat = with_flat_containers(df)
    rules = default_rules(df) if rules is None else rules
    width = len(df.columns)
    facts = _facts(flat, facts, {"rows": F.count("*")} | _record_facts(flat, rules))
    copies = duplicate_report(df, subset, settings).summary if duplicates is None else duplicates
    outliers = outlier_report(flat, None, settings) if outliers is None else outliers
    outliers = outlier_report(df, None, settings) if outliers is None else outliers
    capped = F.least(F.col("outlier_pct") / 100.0, F.lit(settings.accuracy_outlier_cap))
    row = merge_single_rows(
        facts.select("rows", "filled", "broken", "torn"),
        copies.select(
            (F.greatest("duplicate_pct", F.coalesce("key_duplicate_pct", F.lit(0.0))) / 100.0).alias("copied")
        ),
        outliers.agg(F.coalesce(F.avg(capped), F.lit(0.0)).alias("outlying")),
    )

    def share(part: str) -> Column:
        return F.when(F.col("rows") == 0, F.lit(0.0)).otherwise(F.col(part) / F.col("rows"))

    cells = F.col("rows") * F.lit(width)
    absent = F.when(cells == 0, F.lit(0.0)).otherwise((cells - F.col("filled")) / cells)
    defects = {
        "completeness": absent,
        "uniqueness": F.col("copied"),
        "validity": share("broken"),
        "consistency": share("torn"),
        "accuracy": F.col("outlying"),
    }
    weights = {name: getattr(settings, f"{name}_weight") for name in defects}
    row = row.select(
        "rows",
        F.lit(width).alias("columns"),
        *[
            rounded(F.lit(100.0) * (F.lit(1.0) - rate), 2).alias(name)
            for name, rate in defects.items()
        ],
    )
    weighted = reduce(lambda a, b: a + b, [F.col(n) * w for n, w in weights.items()])
    row = row.withColumn("overall_score", rounded(weighted / sum(weights.values()), 2))
    row = row.withColumn("grade", grade_of(F.col("overall_score"), settings))
    least = F.least(*[F.col(n) for n in defects])
    weakest = F.coalesce(*[F.when(F.col(n) == least, n) for n in defects])
    fitness = (
        F.when(F.col("grade") == "A", "figures can be published")
        .when(F.col("grade") == "B", "figures can be used while the lowest score is raised")
        .when(F.col("grade") == "C", "figures need a warning until the lowest score is raised")
        .when(F.col("grade") == "D", "no decision should rest on these rows; load them again")
        .otherwise("find where the rows went wrong before anything else")
    )
    verdict = F.concat(
        F.lit("Grade "), "grade", F.lit(" ("), F.format_string("%.2f", "overall_score"),
        F.lit("/100) over "), F.format_number("rows", 0), F.lit(f" rows x {width} columns; lowest score: "),
        weakest, F.lit(" ("), F.format_string("%.2f", least), F.lit("). "), fitness, F.lit("."),
    )
    return row.withColumn("verdict", verdict)


# --- remediation plan --------------------------------------------------------------------
def preprocessing_recommendations(
    df: DataFrame,
    rules: dict[str, Rule] | None = None,
    settings: QualitySettings = QUALITY,
    reports: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Named treatments with severity and reason, read off the reports.

    ``reports`` may hold any of ``profile``, ``missing``, ``duplicates`` (the
    summary), ``validity``, ``consistency``, ``outliers``, and ``facts`` with ``levels``, already computed.
    Key duplicates are not part of the plan; whole-row copies are.
    """
    df = with_flat_containers(df)
    reports = dict(reports or {})
    numeric = numeric_columns(df)
    profile = reports["profile"] if "profile" in reports else numeric_profile(df)

    def report(name: str, build) -> DataFrame:
        return reports[name] if name in reports else build()

    skews = (
        _empty(df, "column string, skew double") if profile is None else profile.select("column", "skew")
    )
    skew = F.coalesce("skew", F.lit(0.0))
    is_number = F.col("column").isin(*numeric) if numeric else F.lit(False)
    pct = F.format_string("%.2f%%", "missing_pct")
    count = F.format_number("missing_count", 0)
    name = F.col("column")
    heavy = F.abs(skew) > settings.heavy_tail_skew

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def plan(issue: str, rows: DataFrame, severity: Column, action: Column, reason: Column) -> DataFrame:
        return rows.select(
            F.lit(issue).alias("issue"),
            "column",
            severity.alias("severity"),
            action.alias("recommended_action"),
            reason.alias("rationale"),
        )

    missing = report("missing", lambda: missing_value_report(df, settings))
    gaps = missing.filter("missing_count > 0").join(skews, "column", "left")
    mostly = F.col("missing_pct") >= settings.missing_drop_pct
    many = F.col("missing_pct") > settings.missing_high_pct
    some = F.col("missing_pct") >= settings.missing_low_pct
    centre = F.when(heavy, "Median").otherwise("Mean")
    gap_plan = plan(
        "Missing values",
        gaps,
        F.when(mostly | many, "High").when(some, "Medium").otherwise("Low"),
        F.when(mostly, text("Check whether the gap in '", name, "' is structural; keep an indicator, else drop it."))
        .when(many & is_number, text("Median-impute '", name, "' and add '", name, "_was_missing'."))
        .when(many, text("Give '", name, "' an explicit 'Unknown' level."))
        .when(some & is_number, text(centre, "-impute '", name, "' (", count, " rows)."))
        .when(some, text("Mode-impute '", name, "' (", count, " rows)."))
        .otherwise(text("Median-impute '", name, "' or drop the ", count, " rows.")),
        F.when(mostly, text(pct, " of rows are null; imputing would invent more than it recovers."))
        .when(many, text(pct, " missing: too much to drop and too much to hide."))
        .when(some & is_number, text(pct, " missing with skew ", F.format_string("%.2f", skew), "."))
        .otherwise(text(pct, " missing: the choice hardly moves any aggregate.")),
    )

    copies = report("duplicates", lambda: duplicate_report(df, None, settings).summary)
    copies = copies.filter("exact_duplicate_rows > 0").withColumn("column", F.lit("<all columns>"))
    copy_plan = plan(
        "Duplicate rows",
        copies,
        F.lit("High"),
        text("Remove ", F.format_number("exact_duplicate_rows", 0), " redundant rows with dropDuplicates."),
        text(F.format_string("%.2f%%", "duplicate_pct"), " of rows are exact copies, so every total is overstated."),
    )

    bad = report("validity", lambda: validity_report(df, rules, settings)).filter("violations > 0")
    listed = F.col("rule").startswith("value in")
    bad_count = F.format_number("violations", 0)
    bad_plan = plan(
        "Invalid values",
        bad,
        F.when(F.col("violation_pct") > settings.material_violation_pct, "High").otherwise("Medium"),
        F.when(listed, text("Map (", F.col("sample_bad_values"), ") to a known level or quarantine ", bad_count, " rows."))
        .otherwise(text("Quarantine ", bad_count, " rows outside ", F.col("rule"), ".")),
        F.when(listed, text(bad_count, " values fall outside ", F.col("rule"), "."))
        .otherwise(text("Values such as ", F.col("sample_bad_values"), " are not possible here.")),
    )

    torn = report("consistency", lambda: consistency_report(df)).filter("not passed")
    torn = torn.withColumn("column", F.col("check_name"))
    torn_plan = plan(
        "Cross-field inconsistency",
        torn,
        F.lit("High"),
        text("Quarantine ", F.format_number("violations", 0), " rows and trace the defect upstream."),
        text(F.col("description"), " ", F.format_string("%.2f%%", "violation_pct"), " of checked rows break it."),
    )

    outliers = report("outliers", lambda: outlier_report(df, None, settings, profile))
    far = outliers.filter("outlier_count > 0").join(skews, "column", "left")
    wide = F.col("outlier_pct") > settings.material_outlier_pct
    far_plan = plan(
        "Statistical outliers",
        far,
        F.when(heavy, "Low").when(wide, "Medium").otherwise("Low"),
        F.when(heavy, text("Investigate '", name, "'; consider log1p for modelling."))
        .when(wide, text("Winsorise '", name, "' at [", F.col("lower_bound").cast("string"), ", ",
                         F.col("upper_bound").cast("string"), "]."))
        .otherwise(text("Review ", F.format_number("outlier_count", 0), " rows of '", name, "'.")),
        F.when(heavy, text("Skew ", F.format_string("%.2f", skew), " points to a genuine heavy tail."))
        .otherwise(text(F.format_string("%.2f%%", "outlier_pct"), " of values lie outside the fences.")),
    )

    if "levels" in reports:  # a column of nulls has no level
        facts = reports["facts"].select(F.explode(F.array(*[F.lit(n) for n in df.columns])).alias("column"), "rows")
        flat = facts.join(reports["levels"], "column", "left").filter("rows > 0 AND coalesce(unique, 0) <= 1")
    else:
        cells = [_cell(df, n) for n in df.columns]
        flat_tests = df.agg(F.count("*").alias("rows"), *[F.min(c).eqNullSafe(F.max(c)).alias(f"flat{i}") for i, c in enumerate(cells)])
        tests = [{"column": F.lit(n), "flat": F.col(f"flat{i}") & (F.col("rows") > 0)} for i, n in enumerate(df.columns)]
        flat = inline_rows(flat_tests, tests).filter("flat")
    flat_plan = plan(
        "Zero-variance column",
        flat,
        F.lit("Low"),
        text("Drop '", name, "' from feature sets."),
        F.lit("A single distinct value carries no information."),
    )

    whole = reduce(
        lambda a, b: a.unionByName(b), [gap_plan, copy_plan, bad_plan, torn_plan, far_plan, flat_plan]
    )
    order = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return whole.orderBy(order, "issue", "column")


# --- whole audits --------------------------------------------------------------------------
class Audit(NamedTuple):
    missing: DataFrame
    duplicates: Duplicates
    validity: DataFrame
    outliers: DataFrame
    summary: DataFrame
    consistency: DataFrame
    recommendations: DataFrame
    score: DataFrame


class Dataset(NamedTuple):
    frame: DataFrame
    key: list[str] | None = None


def assess_dataset(dataset: Dataset, settings: QualitySettings = QUALITY) -> Audit:
    """Every report on one table.

    Seven scans or a few more: the counts of all reports, the moments, the values around the
    quartiles (mostly twice), the fences, the levels with the key, and the row hashes; one more
    for samples if a rule is broken, one for examples if a row hash repeats. Stored are one row of figures, the
    moments by task and small reports.
    """
    df = with_flat_containers(dataset.frame)
    rules, checks = _present_rules(df, None), applicable_checks(df)
    facts = settled(_facts(df, None, {
        **_presence_facts(df), **_rule_facts(df, rules), **_check_facts(df, checks),
        **_range_facts(df), **_record_facts(df, rules),
    }))
    profile = numeric_profile(df)
    keyed = [c for c in (dataset.key or []) if c in df.columns]
    own = _own_levels(df, keyed)
    levels = table_levels(df, None if own else keyed)
    key_groups = levels.filter(F.col("column") == KEY).select(F.col("unique").alias("n")) if keyed else None
    if own:
        present = facts.select("rows", F.col(f"c{df.columns.index(keyed[0])}").alias("present"))
        found = levels.filter(F.col("column") == keyed[0]).agg(F.coalesce(F.max("unique"), F.lit(0)).alias("unique"))
        key_groups = merge_single_rows(present, found).select(
            (F.col("unique") + (F.col("rows") > F.col("present")).cast("long")).alias("n"))
    duplicates = duplicate_report(df, dataset.key, settings, key_groups)
    reports = {
        "missing": missing_value_report(df, settings, facts),
        "duplicates": settled(duplicates.summary),
        "validity": settled(validity_report(df, rules, settings, facts)),
        "consistency": consistency_report(df, facts=facts),
        "outliers": settled(outlier_report(df, None, settings, profile)),
    }
    return Audit(
        missing=reports["missing"],
        duplicates=duplicates._replace(summary=reports["duplicates"]),
        validity=reports["validity"],
        outliers=reports["outliers"],
        summary=summary_statistics(df, profile, facts, levels),
        consistency=reports["consistency"],
        recommendations=preprocessing_recommendations(
            df, rules, settings, {**reports, "profile": profile, "facts": facts, "levels": levels}
        ),
        score=data_quality_score(
            df, dataset.key, rules, settings, reports["duplicates"], reports["outliers"], facts
        ),
    )


def assess_all(datasets: dict[str, Dataset], settings: QualitySettings = QUALITY) -> DataFrame:
    """One score row per dataset, worst first."""
    parts = [
        data_quality_score(d.frame, d.key, None, settings).select(F.lit(name).alias("dataset"), "*")
        for name, d in datasets.items()
    ]
    board = reduce(lambda a, b: a.unionByName(b), parts).drop("verdict")
    return board.orderBy("overall_score", "dataset")


def quality_uplift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two scoreboards joined by dataset, with the change per dimension."""
    dimensions = ("completeness", "uniqueness", "validity", "consistency", "accuracy")
    b, a = before.alias("b"), after.alias("a")
    joined = b.join(a, F.col("b.dataset") == F.col("a.dataset"))
    return joined.select(
        F.col("b.dataset").alias("dataset"),
        F.col("b.overall_score").alias("raw_score"),
        F.col("a.overall_score").alias("clean_score"),
        rounded(F.col("a.overall_score") - F.col("b.overall_score"), 2).alias("uplift"),
        F.col("b.grade").alias("raw_grade"),
        F.col("a.grade").alias("clean_grade"),
        *[
            rounded(F.col(f"a.{d}") - F.col(f"b.{d}"), 2).alias(f"{d}_delta") for d in dimensions
        ],
    ).orderBy(F.col("uplift").desc(), "dataset")


def columns_with_gaps(report: DataFrame) -> DataFrame:
    """Columns of a missing-value report that carry nulls."""
    return report.filter("missing_count > 0")


def rules_broken(report: DataFrame) -> DataFrame:
    """Rules of a validity report that were violated."""
    return report.filter("violations > 0")


def largest_outlier_shares(report: DataFrame, n: int = 12) -> DataFrame:
    """The n columns with the largest outlier share."""
    shares = report.filter("outlier_count > 0")
    return shares.orderBy(F.col("outlier_pct").desc(), "column").limit(n)
