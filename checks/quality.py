"""Quality audit beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import SHIP, over, rnd
from dockline.functions.columns import levels_outside
from dockline.operators import ingest, quality
from dockline.plans.ranking import stored_copy, use_checkpoint_dir
from dockline.sources import files
from dockline.sources import tables as t

QUERIES = {}
ORACLES = {}


def add(name, build, sql=None):
    QUERIES[name] = build
    if sql is not None:
        ORACLES[name] = sql


DATES = ["date_pq_sent", "date_po_sent", "date_scheduled", "date_delivered", "date_recorded"]
TEXTS = [
    "project_code", "pq_number", "po_number", "asn_number", "country", "managed_by", "fulfil_via", "inco_term",
    "shipment_mode", "product_group", "sub_classification", "vendor", "item_description", "molecule", "brand",
    "dosage", "dosage_form", "manufacturing_site", "first_line_designation", "date_pq_sent_reason",
    "date_po_sent_reason", "date_scheduled_reason", "date_delivered_reason", "date_recorded_reason",
    "freight_cost_reason", "weight_reason", "region", "product_group_name", "delivery_month", "delivery_quarter",
]
NUMBERS = [
    "shipment_id", "units_per_pack", "quantity", "line_value_usd", "pack_price_usd", "unit_price_usd",
    "insurance_usd", "freight_cost_usd", "weight_kg", "is_from_rdc", "delivery_delay_days", "is_late",
    "vendor_lead_time_days", "total_lead_time_days", "recording_lag_days", "scheduled_lead_time_days",
    "freight_pct_of_value", "freight_cost_per_kg", "packs_ordered", "units_ordered", "delivery_year",
]
COLUMNS = DATES + TEXTS + NUMBERS
# rule predicates that hold for a present, conforming value
SHIP_RULES = {
    **{c: f"{c} >= 0" for c in NUMBERS if c.endswith("_usd") or c.startswith("units_")},
    "is_late": "is_late IN (0, 1)",
    "delivery_delay_days": "delivery_delay_days BETWEEN -400 AND 400",
    "weight_kg": "weight_kg >= 0",
}
SHIP_CHECKS = [
    "date_po_sent <= date_delivered",
    "date_pq_sent <= date_delivered",
    "date_delivered <= date_recorded",
]
OWN_RULES = {
    "shipment_mode": quality.Rule(allowed=("Air", "Truck", "Air Charter", "Ocean")),
    "delivery_delay_days": quality.Rule(low=-30, high=30),
    "brand": quality.Rule(low=0),
    "quantity": quality.Rule(high=50),
    "absent_column": quality.Rule(low=0),
}
OWN_SQL = {
    "shipment_mode": ("value in {Air, Air Charter, Ocean, Truck}", "shipment_mode IN ('Air','Truck','Air Charter','Ocean')"),
    "delivery_delay_days": ("-30 <= value <= 30", "delivery_delay_days BETWEEN -30 AND 30"),
    "brand": ("value >= 0", "brand = '0'"),
    "quantity": ("value <= 50", "quantity <= 50"),
}


def pct4(n: str, d: str) -> str:
    return f"CASE WHEN {d} = 0 THEN 0.0 ELSE {rnd(f'100.0 * {n} / ({d})', 4)} END"


def _ship(operator, **kwargs):
    return lambda spark, folder: operator(t.stored_shipments(spark, folder), **kwargs)


# --- completeness and uniqueness ---------------------------------------------------
MISSING = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
      {pct4(f'(count(*) - count({c}))', 'count(*)')} AS missing_pct, count({c}) AS non_null_count FROM ship"""
    for c in COLUMNS
)
SEVERITY = """CASE WHEN missing_count = 0 THEN 'None' WHEN missing_pct < 5 THEN 'Low'
  WHEN missing_pct <= 20 THEN 'Medium' ELSE 'High' END AS severity"""
add(
    "missing_value_report",
    lambda spark, folder: quality.missing_value_report(t.stored_shipments(spark, folder)).drop("dtype"),
    SHIP + f", m AS ({MISSING}) SELECT *, {SEVERITY} FROM m",
)
add(
    "columns_with_gaps",
    lambda spark, folder: quality.columns_with_gaps(
        quality.missing_value_report(t.stored_shipments(spark, folder))
    ).drop("dtype"),
    SHIP + f", m AS ({MISSING}) SELECT *, {SEVERITY} FROM m WHERE missing_count > 0",
)


def copies_sql(relation: str, columns: str, key: str = "") -> str:
    exact = f"(SELECT coalesce(CAST(sum(n - 1) AS BIGINT), 0) FROM (SELECT count(*) AS n FROM {relation} GROUP BY {columns}))"
    keyed = f"(SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM {relation} GROUP BY {key}))" if key else "NULL::BIGINT"
    total = f"(SELECT count(*) FROM {relation})"
    return f"""SELECT {total} AS total_rows, {exact} AS exact_duplicate_rows, {pct4(exact, total)} AS duplicate_pct,
      '{key}' AS key_columns, {keyed} AS key_duplicate_rows,
      {pct4(keyed, total) if key else 'NULL::DOUBLE'} AS key_duplicate_pct"""


ALL = ", ".join(COLUMNS)
DOC_COLUMNS = ["text", "lang", "source", "n_chars"]


def _documents(spark, folder):
    return t.table(spark, folder, "documents").select(*DOC_COLUMNS)


add(
    "duplicate_report_shipments",
    lambda spark, folder: quality.duplicate_report(t.stored_shipments(spark, folder), ["shipment_id"]).summary,
    over(copies_sql("ship", ALL, "shipment_id")),
)
add(
    "duplicate_report_documents",
    lambda spark, folder: quality.duplicate_report(
        t.table(spark, folder, "documents").select("text", "lang")
    ).summary,
    copies_sql("documents", "text, lang"),
)
add(
    "duplicate_report_order_lines",
    lambda spark, folder: quality.duplicate_report(
        t.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"),
        ["l_orderkey", "l_linenumber", "absent"],
    ).summary,
    copies_sql("lineitem", "l_orderkey, l_linenumber, l_returnflag", "l_orderkey, l_linenumber"),
)
add(
    "duplicate_key_examples",
    lambda spark, folder: quality.duplicate_report(
        t.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        ["l_orderkey", "l_linenumber"],
    ).key_examples.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("shown")),
    """WITH d AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1),
      s AS (SELECT l_orderkey, l_linenumber FROM lineitem SEMI JOIN d USING (l_orderkey, l_linenumber)
            ORDER BY l_orderkey, l_linenumber LIMIT 5)
      SELECT l_orderkey, l_linenumber, count(*) AS shown FROM s GROUP BY ALL""",
)
add(
    "repeated_text_examples",
    lambda spark, folder: quality.duplicate_report(
        t.table(spark, folder, "documents").select("text", "lang")
    ).examples,
    """SELECT text, lang, count(*) AS copies FROM documents GROUP BY text, lang HAVING count(*) > 1
      ORDER BY copies DESC, text LIMIT 5""",
)
add(
    "distinct_rows",
    lambda spark, folder: t.table(spark, folder, "lineitem")
    .select("l_orderkey", "l_linenumber", "l_returnflag")
    .dropDuplicates(),
    "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem",
)

# --- validity and consistency ---------------------------------------------------------
def validity_sql(rules: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{text}' AS rule, count({c}) AS checked,
          count_if({c} IS NOT NULL AND NOT ({good})) AS violations,
          {pct4(f'count_if({c} IS NOT NULL AND NOT ({good}))', f'count({c})')} AS violation_pct,
          coalesce((SELECT array_to_string(list_sort(list(DISTINCT CAST({c} AS VARCHAR)))[1:5], ', ')
            FROM ship WHERE {c} IS NOT NULL AND NOT ({good})), '') AS sample_bad_values FROM ship"""
        for c, (text, good) in rules.items()
    )


add(
    "validity_report",
    _ship(quality.validity_report, rules=OWN_RULES),
    SHIP + f", v AS ({validity_sql(OWN_SQL)}) SELECT * FROM v",
)
DEFAULT_TEXT = {
    **{c: ("value >= 0", good) for c, good in SHIP_RULES.items()},
    "is_late": ("value in {0, 1}", SHIP_RULES["is_late"]),
    "delivery_delay_days": ("-400 <= value <= 400", SHIP_RULES["delivery_delay_days"]),
}
add(
    "validity_report_default_rules",
    _ship(quality.validity_report),
    SHIP + f", v AS ({validity_sql(DEFAULT_TEXT)}) SELECT * FROM v",
)
add(
    "rules_broken",
    lambda spark, folder: quality.rules_broken(
        quality.validity_report(t.stored_shipments(spark, folder), OWN_RULES)
    ),
    SHIP + f", v AS ({validity_sql(OWN_SQL)}) SELECT * FROM v WHERE violations > 0",
)


def consistency_sql() -> str:
    parts = []
    for check, spec in zip(SHIP_CHECKS, quality.CHECKS):
        both = f"count_if({spec.left} IS NOT NULL AND {spec.right} IS NOT NULL)"
        parts.append(
            f"""SELECT '{check}' AS check_name, '{spec.description}' AS description, {both} AS checked,
              count_if(NOT ({check})) AS violations, {pct4(f'count_if(NOT ({check}))', both)} AS violation_pct,
              count_if(NOT ({check})) = 0 AS passed FROM ship"""
        )
    return " UNION ALL ".join(parts)


add("consistency_report", _ship(quality.consistency_report), SHIP + f", c AS ({consistency_sql()}) SELECT * FROM c")

# --- outliers and profile -----------------------------------------------------------------
def outlier_sql(relation: str, columns: list[str], method: str = "iqr") -> str:
    parts = []
    for c in columns:
        if method == "iqr":
            low = f"quantile_cont({c}::DOUBLE, 0.25) - 1.5 * (quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25))"
            high = f"quantile_cont({c}::DOUBLE, 0.75) + 1.5 * (quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25))"
            spread = f"quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)"
        else:
            low, high = f"avg({c}) - 3.0 * stddev_pop({c})", f"avg({c}) + 3.0 * stddev_pop({c})"
            spread = f"stddev_pop({c})"
        parts.append(
            f"""SELECT '{c}' AS "column", '{method}' AS method, {rnd('lo', 4)} AS lower_bound, {rnd('hi', 4)} AS upper_bound,
              count_if({c} < lo OR {c} > hi) AS outlier_count, {pct4(f'count_if({c} < lo OR {c} > hi)', f'count({c})')} AS outlier_pct,
              {rnd(f'min({c})', 4)} AS min, {rnd(f'max({c})', 4)} AS max
            FROM {relation}, (SELECT {low} AS lo, {high} AS hi, {spread} AS spread, count(DISTINCT {c}) AS levels FROM {relation})
            WHERE spread > 0 AND levels > 2 GROUP BY lo, hi"""
        )
    return " UNION ALL ".join(parts)


add("outlier_report_iqr", _ship(quality.outlier_report), SHIP + f", o AS ({outlier_sql('ship', NUMBERS)}) SELECT * FROM o")
add(
    "outlier_report_zscore",
    _ship(quality.outlier_report, method="zscore"),
    SHIP + f", o AS ({outlier_sql('ship', NUMBERS, 'zscore')}) SELECT * FROM o",
)
add(
    "largest_outlier_shares",
    lambda spark, folder: quality.largest_outlier_shares(
        quality.outlier_report(t.stored_shipments(spark, folder)), 3
    ),
    SHIP
    + f', o AS ({outlier_sql("ship", NUMBERS)}) SELECT * FROM o WHERE outlier_count > 0 ORDER BY outlier_pct DESC, "column" LIMIT 3',
)


def profile_sql() -> str:
    parts = []
    for c in COLUMNS:
        if c in NUMBERS:
            flat = f"min({c}) = max({c})"
            parts.append(
                f"""SELECT '{c}' AS "column", 'numeric' AS col_type, count({c}) AS count, count(DISTINCT {c}) AS "unique",
                  {rnd(f'avg({c})', 4)} AS mean, {rnd(f'quantile_cont({c}::DOUBLE, 0.25)', 4)} AS q25,
                  {rnd(f'quantile_cont({c}::DOUBLE, 0.5)', 4)} AS median, {rnd(f'quantile_cont({c}::DOUBLE, 0.75)', 4)} AS q75,
                  CASE WHEN {flat} THEN 0.0 ELSE {rnd(f'skewness({c})', 4)} END AS skew,
                  CASE WHEN {flat} THEN 0.0 ELSE {rnd(f'kurtosis({c})', 4)} END AS kurtosis,
                  {rnd(f'stddev_samp({c})', 4)} AS std, {rnd(f'min({c})', 4)} AS min, {rnd(f'max({c})', 4)} AS max,
                  count_if({c} = 0) AS zeros, count_if({c} < 0) AS negatives, NULL::VARCHAR AS top, NULL::BIGINT AS freq,
                  NULL::DOUBLE AS top_pct, NULL::VARCHAR AS first_date, NULL::VARCHAR AS last_date FROM ship"""
            )
            continue
        kind = "datetime" if c in DATES else "categorical"
        ends = f"CAST(min({c}) AS VARCHAR), CAST(max({c}) AS VARCHAR)" if c in DATES else "NULL, NULL"
        best = f"(SELECT {{}} FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM ship WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)"
        parts.append(
            f"""SELECT '{c}', '{kind}', count({c}), count(DISTINCT {c}), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
              NULL, NULL, {best.format('v')}, {best.format('n')}, {pct4(best.format('n'), f'count({c})')}, {ends} FROM ship"""
        )
    parts.sort(key=lambda part: "AS col_type" not in part)
    return " UNION ALL ".join(parts)


add("column_profile", _ship(quality.summary_statistics), SHIP + f", p AS ({profile_sql()}) SELECT * FROM p")
add(
    "most_frequent_levels",
    _ship(quality.most_frequent, columns=["brand", "shipment_mode", "dosage"]),
    SHIP
    + " "
    + " UNION ALL ".join(
        f"""(SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM ship) AS "unique", {c} AS top, count(*) AS freq
          FROM ship WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""
        for c in ("brand", "shipment_mode", "dosage")
    ),
)


# --- score, plan, boards ---------------------------------------------------------------------
def score_sql(relation: str, columns: list[str], numbers: list[str], rules: dict[str, str], checks: list[str], key: str = "") -> str:
    broken = " OR ".join(f"coalesce(NOT ({good}), false)" for good in rules.values()) or "false"
    torn = " OR ".join(f"coalesce(NOT ({c}), false)" for c in checks) or "false"
    filled = " + ".join(f"count({c})" for c in columns)
    width = len(columns)
    outliers = (
        f"(SELECT coalesce(avg(least(outlier_pct / 100.0, 0.10)), 0.0) FROM ({outlier_sql(relation, numbers)}))" if numbers else "0.0"
    )
    return f"""SELECT *, CASE WHEN overall_score >= 90 THEN 'A' WHEN overall_score >= 80 THEN 'B' WHEN overall_score >= 70 THEN 'C'
        WHEN overall_score >= 60 THEN 'D' ELSE 'F' END AS grade FROM (
      SELECT *, {rnd('(completeness * 0.3 + uniqueness * 0.2 + validity * 0.25 + consistency * 0.15 + accuracy * 0.1) / (0.3 + 0.2 + 0.25 + 0.15 + 0.1)', 2)} AS overall_score FROM (
      SELECT rows, {width} AS columns, {rnd(f'100.0 * (1.0 - (rows * {width} - filled) / CAST(rows * {width} AS DOUBLE))', 2)} AS completeness,
        {rnd('100.0 * (1.0 - greatest(duplicate_pct, coalesce(key_duplicate_pct, 0.0)) / 100.0)', 2)} AS uniqueness,
        {rnd('100.0 * (1.0 - broken / CAST(rows AS DOUBLE))', 2)} AS validity,
        {rnd('100.0 * (1.0 - torn / CAST(rows AS DOUBLE))', 2)} AS consistency,
        {rnd('100.0 * (1.0 - outlying)', 2)} AS accuracy
      FROM (SELECT count(*) AS rows, {filled} AS filled, count_if({broken}) AS broken, count_if({torn}) AS torn,
              {outliers} AS outlying FROM {relation}),
           ({copies_sql(relation, ', '.join(columns), key)})))"""


SHIP_SCORE = score_sql("ship", COLUMNS, NUMBERS, SHIP_RULES, SHIP_CHECKS, "shipment_id")
DOC_SCORE = score_sql("documents", DOC_COLUMNS, ["n_chars"], {}, [])
add(
    "data_quality_score",
    lambda spark, folder: quality.data_quality_score(t.stored_shipments(spark, folder), ["shipment_id"]).drop("verdict"),
    SHIP + f", s AS ({SHIP_SCORE}) SELECT * FROM s",
)
add(
    "quality_verdict",
    lambda spark, folder: quality.data_quality_score(t.stored_shipments(spark, folder), ["shipment_id"]).select("grade", "verdict"),
    SHIP
    + f""", s AS ({SHIP_SCORE}), w AS (SELECT *, least(completeness, uniqueness, validity, consistency, accuracy) AS lowest FROM s)
      SELECT grade, 'Grade ' || grade || ' (' || printf('%.2f', overall_score) || '/100) over ' || format('{{:,}}', rows) || ' rows x '
        || columns || ' columns; lowest score: ' || CASE lowest WHEN completeness THEN 'completeness' WHEN uniqueness THEN 'uniqueness'
          WHEN validity THEN 'validity' WHEN consistency THEN 'consistency' ELSE 'accuracy' END || ' (' || printf('%.2f', lowest) || '). '
        || CASE grade WHEN 'A' THEN 'figures can be published' WHEN 'B' THEN 'figures can be used while the lowest score is raised'
          WHEN 'C' THEN 'figures need a warning until the lowest score is raised' WHEN 'D' THEN 'no decision should rest on these rows; load them again'
          ELSE 'find where the rows went wrong before anything else' END || '.' AS verdict FROM w""",
)
add(
    "quality_scoreboard",
    lambda spark, folder: quality.assess_all(
        {
            "shipments": quality.Dataset(t.stored_shipments(spark, folder), ["shipment_id"]),
            "documents": quality.Dataset(_documents(spark, folder)),
        }
    ),
    SHIP
    + f", s AS ({SHIP_SCORE}), d AS ({DOC_SCORE}) SELECT 'shipments' AS dataset, * FROM s UNION ALL SELECT 'documents', * FROM d",
)
LABELLED = """labelled AS (SELECT documents.doc_id, lang, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
  filled AS (SELECT doc_id, lang, n_chars, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM labelled)"""
LABEL_COLUMNS = ["doc_id", "lang", "n_chars", "quality", "toxic"]
LABEL_NUMBERS = ["doc_id", "n_chars", "quality", "toxic"]


def _uplift(spark, folder):
    documents = t.table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    labelled = documents.join(t.table(spark, folder, "labels"), "doc_id", "left").select(*LABEL_COLUMNS)
    events = t.table(spark, folder, "events").select("event_id", "event_type", "value")
    before = {"labelled": quality.Dataset(labelled), "events": quality.Dataset(events)}
    after = {
        "labelled": quality.Dataset(labelled.fillna(0, ["quality", "toxic"])),
        "events": quality.Dataset(events),
    }
    return quality.quality_uplift(quality.assess_all(before), quality.assess_all(after))


EVENT_SCORE = score_sql("events", ["event_id", "event_type", "value"], ["event_id", "value"], {}, [])
add(
    "quality_uplift",
    _uplift,
    f"""WITH {LABELLED},
      b AS (SELECT 'labelled' AS dataset, * FROM ({score_sql('labelled', LABEL_COLUMNS, LABEL_NUMBERS, {}, [])})
            UNION ALL SELECT 'events', * FROM ({EVENT_SCORE})),
      a AS (SELECT 'labelled' AS dataset, * FROM ({score_sql('filled', LABEL_COLUMNS, LABEL_NUMBERS, {}, [])})
            UNION ALL SELECT 'events', * FROM ({EVENT_SCORE}))
      SELECT b.dataset, b.overall_score AS raw_score, a.overall_score AS clean_score,
        {rnd('a.overall_score - b.overall_score', 2)} AS uplift, b.grade AS raw_grade, a.grade AS clean_grade, """
    + ", ".join(
        f"{rnd(f'a.{d} - b.{d}', 2)} AS {d}_delta"
        for d in ("completeness", "uniqueness", "validity", "consistency", "accuracy")
    )
    + " FROM b JOIN a USING (dataset)",
)


def _parsing_uplift(spark, folder):
    # the score passes over it more than ten times: parsed once, by the columns each pass uses
    published = stored_copy(ingest.published_types(t.stored_published(spark, folder)))
    return quality.quality_uplift(
        quality.assess_all({"shipments": quality.Dataset(published, ["ID"])}),
        quality.assess_all({"shipments": quality.Dataset(t.stored_shipments(spark, folder), ["shipment_id"])}),
    )


add("parsing_uplift", _parsing_uplift)

_skews = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", skewness({c}) AS skew FROM ship" for c in NUMBERS)
_numeric = ", ".join(f"'{c}'" for c in NUMBERS)
_flat = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS levels FROM ship" for c in COLUMNS
)
add(
    "remediation_plan",
    lambda spark, folder: quality.preprocessing_recommendations(
        t.stored_shipments(spark, folder), OWN_RULES
    ).select("issue", "column", "severity"),
    SHIP
    + f""", m AS ({MISSING}), v AS ({validity_sql(OWN_SQL)}), c AS ({consistency_sql()}), o AS ({outlier_sql('ship', NUMBERS)}),
      k AS ({_skews}), f AS ({_flat})
      SELECT 'Missing values' AS issue, "column", CASE WHEN missing_pct > 20 THEN 'High' WHEN missing_pct >= 5 THEN 'Medium'
        ELSE 'Low' END AS severity FROM m WHERE missing_count > 0
      UNION ALL SELECT 'Invalid values', "column", CASE WHEN violation_pct > 1 THEN 'High' ELSE 'Medium' END FROM v WHERE violations > 0
      UNION ALL SELECT 'Cross-field inconsistency', check_name, 'High' FROM c WHERE NOT passed
      UNION ALL SELECT 'Statistical outliers', o."column", CASE WHEN abs(skew) > 1 THEN 'Low' WHEN outlier_pct > 5 THEN 'Medium' ELSE 'Low' END
        FROM o JOIN k ON o."column" = k."column" WHERE outlier_count > 0
      UNION ALL SELECT 'Zero-variance column', "column", 'Low' FROM f WHERE levels <= 1""",
)
add("remediation_plan_texts", _ship(quality.preprocessing_recommendations))


# report: (item, numeric measures, text measures)
AUDIT = {
    "missing": ('"column"', ["missing_count", "missing_pct", "non_null_count"], ["severity"]),
    "duplicates": ("'table'", ["total_rows", "exact_duplicate_rows", "duplicate_pct", "key_duplicate_rows", "key_duplicate_pct"], ["key_columns"]),
    "validity": ('"column"', ["checked", "violations", "violation_pct"], ["rule", "sample_bad_values"]),
    "outliers": ('"column"', ["lower_bound", "upper_bound", "outlier_count", "outlier_pct", "min", "max"], ["method"]),
    "summary": (
        '"column"',
        ["count", "unique", "mean", "q25", "median", "q75", "skew", "kurtosis", "std", "min", "max", "zeros", "negatives", "freq", "top_pct"],
        ["col_type", "top", "first_date", "last_date"],
    ),
    "consistency": ("check_name", ["checked", "violations", "violation_pct"], ["description", "passed"]),
    "recommendations": ("concat(issue, ': ', \"column\")", [], ["severity"]),
    "score": ("'table'", ["rows", "columns", "completeness", "uniqueness", "validity", "consistency", "accuracy", "overall_score"], ["grade"]),
}


def audit_reports(audit: quality.Audit) -> dict:
    return {name: audit.duplicates.summary if name == "duplicates" else getattr(audit, name) for name in AUDIT}


def _melted(reports):
    """All reports as rows (report, item, measure, value, text)."""
    out = None
    for name, (item, numbers, texts) in AUDIT.items():
        cells = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"), F.lit(None).cast("string").alias("text")) for m in numbers]
        cells += [F.struct(F.lit(m).alias("measure"), F.lit(None).cast("double").alias("value"), F.col(m).cast("string").alias("text")) for m in texts]
        rows = reports[name].select(F.lit(name).alias("report"), F.expr(item.replace('"', "`")).alias("item"), F.inline(F.array(*cells)))
        out = rows if out is None else out.unionByName(rows)
    return out


def _audit(spark, folder):
    return audit_reports(quality.assess_dataset(quality.Dataset(t.stored_shipments(spark, folder), ["shipment_id"])))


def audit_sql() -> str:
    plan = f"""SELECT 'Missing values' AS issue, "column", CASE WHEN missing_pct > 20 THEN 'High' WHEN missing_pct >= 5 THEN 'Medium'
        ELSE 'Low' END AS severity FROM missing WHERE missing_count > 0
      UNION ALL SELECT 'Invalid values', "column", CASE WHEN violation_pct > 1 THEN 'High' ELSE 'Medium' END FROM validity WHERE violations > 0
      UNION ALL SELECT 'Cross-field inconsistency', check_name, 'High' FROM consistency WHERE NOT passed
      UNION ALL SELECT 'Statistical outliers', o."column", CASE WHEN abs(skew) > 1 THEN 'Low' WHEN outlier_pct > 5 THEN 'Medium' ELSE 'Low' END
        FROM outliers o JOIN ({_skews}) k ON o."column" = k."column" WHERE outlier_count > 0
      UNION ALL SELECT 'Duplicate rows', '<all columns>', 'High' FROM duplicates WHERE exact_duplicate_rows > 0
      UNION ALL SELECT 'Zero-variance column', "column", 'Low' FROM ({_flat}) WHERE levels <= 1"""
    views = {
        "missing": f"SELECT *, {SEVERITY} FROM ({MISSING})", "duplicates": copies_sql("ship", ALL, "shipment_id"),
        "validity": validity_sql(DEFAULT_TEXT), "outliers": outlier_sql("ship", NUMBERS), "summary": profile_sql(),
        "consistency": consistency_sql(), "recommendations": plan, "score": SHIP_SCORE,
    }
    parts = []
    for name, (item, numbers, texts) in AUDIT.items():
        names = ", ".join(f"'{m}'" for m in numbers + texts)
        values = ", ".join([f'CAST("{m}" AS DOUBLE)' for m in numbers] + ["NULL"] * len(texts))
        words = ", ".join(["NULL"] * len(numbers) + [f'CAST("{m}" AS VARCHAR)' for m in texts])
        parts.append(f"""SELECT '{name}' AS report, {item} AS item, unnest([{names}]) AS measure,
          unnest([{values}]::DOUBLE[]) AS value, unnest([{words}]::VARCHAR[]) AS text FROM {name}""")
    return SHIP + "".join(f", {name} AS ({sql})" for name, sql in views.items()) + " " + " UNION ALL ".join(parts)


add("full_audit", lambda spark, folder: _melted(_audit(spark, folder)), audit_sql())


def _audit_export(spark, folder):
    """All reports of the audit, committed as one version and read back."""
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/audit-export"
    files.commit_reports(_audit(spark, folder), path)
    return _melted(files.read_reports(spark, path))


add("audit_export", _audit_export, audit_sql())
add(
    "level_difference",
    lambda spark, folder: levels_outside(t.table(spark, folder, "part"), "p_type", ("SMALL", "LARGE"), "p_type"),
    "SELECT DISTINCT p_type FROM part WHERE p_type NOT IN ('SMALL', 'LARGE')",
)
