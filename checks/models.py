"""Patient cleaning, splits, metrics, curves, ranking reports and fitted models.

Fitted trees cannot be restated in SQL; operators on scores are compared on a
deterministic score derived from the tables.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from checks.base import SHIP, also, rnd
from checks.quality import MISSING, SEVERITY
from dockline.functions.columns import levels_outside
from dockline.config import DEFAULTS
from dockline.operators import clinical, evaluation, quality, scoring, training
from dockline.plans.ranking import settled, use_checkpoint_dir
from dockline.sources import files
from dockline.sources import tables as t

QUERIES = {}
ORACLES = {}


def add(name, build, sql=None):
    QUERIES[name] = build
    if sql is not None:
        ORACLES[name] = sql


RAW = """WITH k AS (SELECT *, c_custkey - CASE WHEN c_custkey % 5 = 4 THEN 1 ELSE 0 END AS k FROM customer),
base AS (SELECT *, 15 + (k * 7) % 60 AS age, 6.0::DOUBLE + ((k * 37) % 3200) / 100.0::DOUBLE AS ratio,
  CASE WHEN k % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
  CASE k % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'NORMAL' END AS bp,
  CASE WHEN (k // 3) % 2 = 0 THEN 'HIGH' ELSE 'NORMAL' END AS chol FROM k),
raw AS (SELECT
  CASE WHEN k % 97 = 5 THEN NULL WHEN k % 97 = 6 THEN 'n/a' WHEN k % 97 = 7 THEN '-5' WHEN k % 97 = 8 THEN '250'
    ELSE CAST(age AS VARCHAR) END AS "Age",
  CASE WHEN k % 89 = 3 THEN NULL WHEN c_custkey % 7 = 1 THEN lower(sex) WHEN c_custkey % 7 = 2 THEN sex || ' ' ELSE sex END AS "Sex",
  CASE WHEN k % 83 = 4 THEN NULL WHEN c_custkey % 11 = 1 THEN lower(bp) WHEN c_custkey % 11 = 2 THEN ' ' || bp ELSE bp END AS "BP",
  CASE WHEN k % 79 = 2 THEN NULL ELSE chol END AS "Cholesterol",
  CASE WHEN k % 101 = 9 THEN NULL ELSE ratio END AS "Na_to_K",
  CASE WHEN ratio > 15 THEN 'DrugY' WHEN bp = 'HIGH' AND age <= 50 THEN 'drugA' WHEN bp = 'HIGH' THEN 'drugB'
    WHEN bp = 'LOW' AND chol = 'HIGH' THEN 'drugC' ELSE 'drugX' END AS "Drug" FROM base),
std AS (SELECT CASE WHEN regexp_matches("Age", '^[+-]?[0-9]+$') THEN CAST("Age" AS DOUBLE) END AS "Age", upper(trim("Sex")) AS "Sex",
  upper(trim("BP")) AS "BP", upper(trim("Cholesterol")) AS "Cholesterol", "Na_to_K", "Drug"
  FROM (SELECT CASE WHEN "Age" = 'n/a' THEN NULL ELSE "Age" END AS "Age", "Sex", "BP", "Cholesterol", "Na_to_K", "Drug" FROM raw)),
cleaned AS (SELECT DISTINCT * FROM std),
ranged AS (SELECT DISTINCT CASE WHEN "Age" >= 0 AND "Age" <= 120 THEN "Age" END AS "Age", "Sex", "BP", "Cholesterol", "Na_to_K", "Drug" FROM std)
"""


def _mode(column: str) -> str:
    return f'(SELECT "{column}" FROM ranged WHERE "{column}" IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)'


IMPUTED = RAW + f""", imputed AS (SELECT coalesce("Age", (SELECT quantile_cont("Age", 0.5) FROM ranged)) AS "Age",
  coalesce("Sex", {_mode('Sex')}) AS "Sex", coalesce("BP", {_mode('BP')}) AS "BP", coalesce("Cholesterol", {_mode('Cholesterol')}) AS "Cholesterol",
  coalesce("Na_to_K", (SELECT quantile_cont("Na_to_K", 0.5) FROM ranged)) AS "Na_to_K", "Drug" FROM ranged) """


def _clean(spark, folder):
    return clinical.clean_patients(t.patients(spark, folder))


add("patient_rows", lambda spark, folder: t.patients(spark, folder), RAW + "SELECT * FROM raw")
add("clean_patients", lambda spark, folder: _clean(spark, folder).frame, RAW + "SELECT * FROM cleaned")
add(
    "clean_patients_log",
    lambda spark, folder: _clean(spark, folder).log,
    RAW
    + """SELECT count(*) AS rows_in, count_if(coalesce("Sex", '') <> coalesce(upper(trim("Sex")), '')) AS Sex_edited,
      count_if(coalesce("BP", '') <> coalesce(upper(trim("BP")), '')) AS BP_edited,
      count_if(coalesce("Cholesterol", '') <> coalesce(upper(trim("Cholesterol")), '')) AS Cholesterol_edited,
      count_if("Age" = 'n/a') AS Age_not_numeric, 0::BIGINT AS Na_to_K_not_numeric,
      (SELECT count(*) FROM cleaned) AS rows_out, count(*) - (SELECT count(*) FROM cleaned) AS duplicates_dropped FROM raw""",
)
add(
    "clean_and_impute",
    lambda spark, folder: clinical.clean_and_impute(t.patients(spark, folder)).frame,
    IMPUTED + "SELECT * FROM imputed",
)
add(
    "clean_and_impute_log",
    lambda spark, folder: clinical.clean_and_impute(t.patients(spark, folder)).log,
    RAW
    + "".join(
        f"{'' if i == 1 else ' UNION ALL '}SELECT {i} AS step_order, '{step}' AS step, '{c}' AS \"column\", ({n}) AS rows_fixed"
        for i, (step, c, n) in enumerate(
            [
                *[
                    ("standardise text", c, f'SELECT count_if("{c}" <> upper(trim("{c}"))) FROM raw')
                    for c in clinical.CATEGORICAL
                ],
                ("range check", "Age", 'SELECT count_if("Age" < 0 OR "Age" > 120) FROM std'),
                ("deduplicate", "<all>", "SELECT (SELECT count(*) FROM raw) - (SELECT count(*) FROM ranged)"),
                *[
                    ("median imputation", c, f'SELECT count_if("{c}" IS NULL) FROM ranged')
                    for c in clinical.NUMERIC
                ],
                *[
                    ("mode imputation", c, f'SELECT count_if("{c}" IS NULL) FROM ranged')
                    for c in clinical.CATEGORICAL
                ],
            ],
            1,
        )
    ),
)


def _pass(test: str) -> str:
    return f"(SELECT CASE WHEN {test} THEN 'PASS' ELSE 'FAIL' END FROM imputed)"


add(
    "cleaning_assertions",
    lambda spark, folder: clinical.cleaning_assertions(
        clinical.clean_and_impute(t.patients(spark, folder)).frame
    ),
    IMPUTED
    + " UNION ALL ".join(
        f"SELECT '{name}' AS \"check\", {_pass(test)} AS result"
        for name, test in (
            ("No missing values", 'count(*) = count("Age" + "Na_to_K") AND count(*) = count("Sex" || "BP" || "Cholesterol" || "Drug")'),
            ("No duplicate rows", "count(*) = (SELECT count(*) FROM (SELECT DISTINCT * FROM imputed))"),
            ("Sex valid", "count_if(\"Sex\" NOT IN ('F','M')) = 0"),
            ("BP valid", "count_if(\"BP\" NOT IN ('HIGH','LOW','NORMAL')) = 0"),
            ("Cholesterol valid", "count_if(\"Cholesterol\" NOT IN ('HIGH','NORMAL')) = 0"),
            ("Age within [0, 120]", 'count_if("Age" < 0 OR "Age" > 120) = 0'),
            ("Na_to_K positive", 'count_if("Na_to_K" <= 0) = 0'),
        )
    ),
)
FEATURES = """SELECT *, CASE WHEN "Age" < 30 THEN '<30' WHEN "Age" < 45 THEN '30-45' WHEN "Age" < 60 THEN '45-60' WHEN "Age" >= 60 THEN '60+' END AS age_group,
    CASE WHEN "Na_to_K" < 10 THEN 'Low' WHEN "Na_to_K" < 15 THEN 'Normal' WHEN "Na_to_K" >= 15 THEN 'High' END AS na_to_k_band,
    CASE WHEN "Na_to_K" >= 15 THEN 1 ELSE 0 END AS high_na_to_k,
    CASE "BP" WHEN 'HIGH' THEN 2.0::DOUBLE WHEN 'NORMAL' THEN 1.0 WHEN 'LOW' THEN 0.0 END AS bp_risk_score,
    CASE "Cholesterol" WHEN 'HIGH' THEN 2.0::DOUBLE WHEN 'NORMAL' THEN 1.0 WHEN 'LOW' THEN 0.0 END AS cholesterol_risk,
    CASE "BP" WHEN 'HIGH' THEN 2.0::DOUBLE WHEN 'NORMAL' THEN 1.0 WHEN 'LOW' THEN 0.0 END
      + CASE "Cholesterol" WHEN 'HIGH' THEN 2.0::DOUBLE WHEN 'NORMAL' THEN 1.0 WHEN 'LOW' THEN 0.0 END AS combined_risk_score FROM cleaned"""
add(
    "patient_features",
    lambda spark, folder: clinical.engineer_features(_clean(spark, folder).frame),
    RAW + FEATURES,
)
BAD = """(CASE WHEN "Age" IS NULL OR "Age" IN ('n/a', '-5') THEN 1 ELSE 0 END)"""
add(
    "screened_patients",
    lambda spark, folder: clinical.screen_inputs(t.patients(spark, folder)).accepted,
    RAW
    + f"""SELECT CAST("Age" AS DOUBLE) AS "Age", upper(trim("Sex")) AS "Sex", upper(trim("BP")) AS "BP", upper(trim("Cholesterol")) AS "Cholesterol", "Na_to_K", "Drug"
      FROM raw WHERE {BAD} = 0 AND "Sex" IS NOT NULL AND "BP" IS NOT NULL AND "Cholesterol" IS NOT NULL AND "Na_to_K" IS NOT NULL""",
)
add(
    "quarantined_patients",
    lambda spark, folder: clinical.screen_inputs(t.patients(spark, folder))
    .quarantined.groupBy("invalid_fields")
    .agg(F.count("*").alias("n")),
    RAW
    + f""", m AS (SELECT array_to_string(list_sort(list_filter([CASE WHEN {BAD} = 1 THEN 'Age' END, CASE WHEN "Sex" IS NULL THEN 'Sex' END,
        CASE WHEN "BP" IS NULL THEN 'BP' END, CASE WHEN "Cholesterol" IS NULL THEN 'Cholesterol' END,
        CASE WHEN "Na_to_K" IS NULL THEN 'Na_to_K' END], lambda x: x IS NOT NULL)), ', ') AS invalid_fields FROM raw)
      SELECT invalid_fields, count(*) AS n FROM m WHERE invalid_fields <> '' GROUP BY 1""",
)
add(
    "class_balance",
    lambda spark, folder: clinical.class_balance(_clean(spark, folder).frame, "Drug"),
    RAW
    + f"""SELECT "Drug" AS label, count(*) AS n, {rnd('100.0 * count(*) / (SELECT count(*) FROM cleaned)', 1)} AS share_pct FROM cleaned GROUP BY 1""",
)
add(
    "class_imbalance",
    lambda spark, folder: clinical.imbalance(_clean(spark, folder).frame, "Drug"),
    RAW
    + f""", c AS (SELECT count(*) AS n FROM cleaned GROUP BY "Drug") SELECT count(*) AS classes,
      {rnd('max(n) / CAST(min(n) AS DOUBLE)', 4)} AS imbalance_ratio, {rnd('max(n) / CAST(sum(n) AS DOUBLE)', 4)} AS baseline_accuracy FROM c""",
)
add(
    "class_weights",
    lambda spark, folder: clinical.class_weights(_clean(spark, folder).frame, "Drug"),
    RAW
    + """, c AS (SELECT "Drug" AS label, count(*) AS n FROM cleaned GROUP BY 1)
      SELECT label, n, CAST((SELECT sum(n) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * n) AS weight FROM c""",
)
add(
    "boundary_gap",
    lambda spark, folder: clinical.boundary_gap(_clean(spark, folder).frame, "Na_to_K", "Drug", "DrugY"),
    RAW
    + """SELECT min("Na_to_K") FILTER ("Drug" = 'DrugY') AS class_min, max("Na_to_K") FILTER ("Drug" <> 'DrugY') AS others_max FROM cleaned""",
)
add(
    "functional_dependency",
    lambda spark, folder: clinical.functional_dependency(
        clinical.engineer_features(_clean(spark, folder).frame), ["high_na_to_k", "BP", "Cholesterol"], "Drug"
    ),
    RAW
    + f""", f AS ({FEATURES}), g AS (SELECT count(DISTINCT "Drug") > 1 AS conflict FROM f GROUP BY high_na_to_k, "BP", "Cholesterol")
      SELECT count(*) AS tuples, count_if(conflict) AS conflicting, count_if(conflict) = 0 AS holds FROM g""",
)
add(
    "observed_minus_allowed_levels",
    lambda spark, folder: levels_outside(t.patients(spark, folder), "BP", clinical.ALLOWED["BP"]),
    RAW + """SELECT DISTINCT "BP" AS level FROM raw WHERE "BP" NOT IN ('HIGH','LOW','NORMAL')""",
)
add(
    "deduplicated_patients_duplicates",
    lambda spark, folder: quality.duplicate_report(t.patients(spark, folder)).summary.select(
        "total_rows", "exact_duplicate_rows"
    ),
    RAW
    + """SELECT count(*) AS total_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS exact_duplicate_rows FROM raw""",
)

# --- late-delivery frame and split -----------------------------------------------------
_numbers = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in training.LATE_NUMERIC)
_levels = ", ".join(f"coalesce({c}, 'Unknown') AS {c}" for c in training.LATE_CATEGORICAL)
add(
    "late_delivery_frame",
    lambda spark, folder: training.late_delivery_frame(t.stored_shipments(spark, folder)),
    also(
        "f AS (SELECT 1)",
        f""" SELECT shipment_id, po_number, {_numbers}, {_levels}, CASE WHEN is_late = 1 THEN 'Late' ELSE 'On Time' END AS label
        FROM ship WHERE is_late IS NOT NULL""",
    ),
)
SPLIT = """ranked AS (SELECT shipment_id, po_number, is_late,
    row_number() OVER (PARTITION BY is_late ORDER BY md5('42|' || shipment_id || '|' || po_number), shipment_id, po_number) AS rk,
    CAST(round_even(count(*) OVER (PARTITION BY is_late) * 0.25::DOUBLE, 0) AS BIGINT) AS held FROM ship WHERE is_late IS NOT NULL)"""


def _split(spark, folder):
    rows = t.stored_shipments(spark, folder).filter("is_late is not null")
    return evaluation.with_split(
        rows.select("shipment_id", "po_number", "is_late"), "is_late", ["shipment_id", "po_number"]
    )


add(
    "stratified_split",
    _split,
    also(
        SPLIT,
        """ SELECT shipment_id, po_number, is_late, rk <= held AS is_test,
        CASE WHEN rk > held THEN CAST((rk - held - 1) % 5 AS INTEGER) END AS fold FROM ranked""",
    ),
)

# --- metrics on deterministic predictions ---------------------------------------------------
PREDICTED = RAW + f""", f AS ({FEATURES}), p AS (SELECT *, "Drug" AS actual, CASE WHEN "Na_to_K" > 16 THEN 'DrugY'
    WHEN "BP" = 'HIGH' THEN 'drugA' WHEN "BP" = 'LOW' THEN 'drugC' ELSE 'drugX' END AS predicted FROM f)"""
LABELS = ["DrugY", "drugA", "drugB", "drugC", "drugX"]


def _predicted(spark, folder):
    rule = (
        F.when(F.col("Na_to_K") > 16, "DrugY")
        .when(F.col("BP") == "HIGH", "drugA")
        .when(F.col("BP") == "LOW", "drugC")
        .otherwise("drugX")
    )
    features = clinical.engineer_features(_clean(spark, folder).frame)
    return features.withColumn("actual", F.col("Drug")).withColumn("predicted", rule)


add(
    "confusion_matrix",
    lambda spark, folder: evaluation.confusion_matrix(_predicted(spark, folder), LABELS),
    PREDICTED
    + " SELECT actual, "
    + ", ".join(f"count_if(predicted = '{v}') AS \"{v}\"" for v in LABELS)
    + " FROM p GROUP BY 1",
)
REPORT = """, l AS (SELECT actual AS label FROM p UNION SELECT predicted FROM p),
  c AS (SELECT label, (SELECT count(*) FROM p WHERE actual = label) AS support, (SELECT count(*) FROM p WHERE predicted = label) AS called,
    (SELECT count(*) FROM p WHERE actual = label AND predicted = label) AS hits FROM l),
  r AS (SELECT label, CASE WHEN called > 0 THEN hits / CAST(called AS DOUBLE) ELSE 0.0 END AS precision,
    CASE WHEN support > 0 THEN hits / CAST(support AS DOUBLE) ELSE 0.0 END AS recall,
    CASE WHEN support + called > 0 THEN 2.0::DOUBLE * hits / (support + called) ELSE 0.0 END AS f1, support, hits FROM c)"""
add(
    "per_class_report",
    lambda spark, folder: evaluation.per_class_report(_predicted(spark, folder)),
    PREDICTED + REPORT + " SELECT * FROM r",
)
add(
    "classification_metrics",
    lambda spark, folder: evaluation.classification_metrics(_predicted(spark, folder)),
    PREDICTED
    + REPORT
    + f""" SELECT {rnd('sum(hits) / CAST(sum(support) AS DOUBLE)', 6)} AS accuracy, {rnd('avg(f1)', 6)} AS f1_macro,
      {rnd('sum(f1 * support) / sum(support)', 6)} AS f1_weighted, {rnd('avg(precision)', 6)} AS precision_macro,
      {rnd('avg(recall)', 6)} AS recall_macro FROM r""",
)
add(
    "error_listing",
    lambda spark, folder: evaluation.error_listing(_predicted(spark, folder), "Na_to_K", 15.0).select(
        "Age", "Na_to_K", "actual", "predicted", "distance"
    ),
    PREDICTED
    + f""" SELECT "Age", "Na_to_K", actual, predicted, {rnd('"Na_to_K" - 15.0', 2)} AS distance FROM p WHERE actual <> predicted""",
)

# --- scores ---------------------------------------------------------------------------------
SCORED = """scored AS (SELECT *, (((shipment_id * 13 + length(vendor) + quantity * 7) % 200) + is_late * 60) / 400.0::DOUBLE AS score
  FROM ship WHERE is_late IS NOT NULL)"""
TIES = ["shipment_id", "po_number"]
add(
    "risk_deciles",
    lambda spark, folder: evaluation.with_deciles(
        t.scored_shipments(spark, folder).select(*TIES, "score"), "score", TIES
    ),
    also(
        SCORED,
        """, r AS (SELECT shipment_id, po_number, score, row_number() OVER (ORDER BY score DESC, shipment_id, po_number) AS g,
          count(*) OVER () AS n FROM scored)
        SELECT shipment_id, po_number, score, CAST(greatest(1, ceil((g - 1) * 10.0 / (n - 1))) AS INTEGER) AS decile FROM r""",
    ),
)
add(
    "gains_curve",
    lambda spark, folder: evaluation.gains_curve(t.scored_shipments(spark, folder), "score", "is_late", TIES),
    also(
        SCORED,
        f""", r AS (SELECT is_late, row_number() OVER w AS g, sum(is_late) OVER (w ROWS UNBOUNDED PRECEDING) AS caught, count(*) OVER () AS n,
            sum(is_late) OVER () AS hits FROM scored WINDOW w AS (ORDER BY score DESC, shipment_id, po_number)),
          s AS (SELECT unnest([0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50]::DOUBLE[]) AS share)
        SELECT 100.0 * share AS targeted_pct, g AS shipments_reviewed, CAST(caught AS BIGINT) AS late_captured,
          {rnd('100.0 * caught / hits', 2)} AS capture_rate_pct, {rnd('100.0 * caught / g', 2)} AS precision_pct,
          {rnd('(100.0 * caught / hits) / (100.0 * share)', 2)} AS lift
        FROM r JOIN s ON g = greatest(CAST(round_even(n * share, 0) AS BIGINT), 1)""".replace(
            "100.0 * share AS targeted_pct", f"{rnd('100.0 * share', 1)} AS targeted_pct"
        ),
    ),
)
BINARY = {"late": "score", "on_time": "counter_score"}


def _binary(spark, folder):
    return (
        t.scored_shipments(spark, folder)
        .withColumn("actual", F.when(F.col("is_late") == 1, "late").otherwise("on_time"))
        .withColumn("counter_score", F.lit(1.0) - F.col("score"))
    )


POINTS = SCORED + """, cells AS (SELECT 'late' AS label, score, is_late = 1 AS hit FROM scored UNION ALL
    SELECT 'on_time', 1.0::DOUBLE - score, is_late = 0 FROM scored),
  counts AS (SELECT label, score, count_if(hit) AS positives, count_if(NOT hit) AS negatives FROM cells GROUP BY ALL),
  points AS (SELECT *, CAST(sum(positives) OVER w AS BIGINT) AS tp, CAST(sum(negatives) OVER w AS BIGINT) AS fp,
    CAST(sum(positives) OVER (PARTITION BY label) AS BIGINT) AS all_positives, CAST(sum(negatives) OVER (PARTITION BY label) AS BIGINT) AS all_negatives
    FROM counts WINDOW w AS (PARTITION BY label ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
add(
    "roc_and_precision_recall_points",
    lambda spark, folder: evaluation.curve_points(_binary(spark, folder), BINARY),
    also(
        POINTS,
        """ SELECT *, tp / CAST(all_positives AS DOUBLE) AS tpr, fp / CAST(all_negatives AS DOUBLE) AS fpr,
        tp / CAST(tp + fp AS DOUBLE) AS precision FROM points""",
    ),
)
AUC = f"""SELECT label, {rnd('sum(negatives * (tp - positives / 2.0)) / (any_value(all_positives) * CAST(any_value(all_negatives) AS DOUBLE))', 8)} AS auc,
  {rnd('sum(positives * (tp / CAST(tp + fp AS DOUBLE))) / any_value(all_positives)', 8)} AS average_precision, any_value(all_positives) AS positives
  FROM points GROUP BY 1"""


def _auc(spark, folder):
    return evaluation.auc_per_class(evaluation.curve_points(_binary(spark, folder), BINARY))


add(
    "roc_auc_and_average_precision",
    lambda spark, folder: _auc(spark, folder).withColumns(
        {c: F.rint(F.col(c) * 1e8) / 1e8 for c in ("auc", "average_precision")}
    ),
    also(POINTS, " " + AUC),
)
add(
    "macro_auc",
    lambda spark, folder: evaluation.macro_auc(_auc(spark, folder), 2).select(
        (F.rint(F.col("roc_auc_ovr") * 1e6) / 1e6).alias("roc_auc_ovr")
    ),
    also(POINTS, f", a AS ({AUC}) SELECT {rnd('avg(auc)', 6)} AS roc_auc_ovr FROM a"),
)


def _confident(spark, folder):
    sure = F.greatest("score", F.lit(1.0) - F.col("score"))
    return t.scored_shipments(spark, folder).withColumn("confidence", sure)


CORRECT = "(score >= 0.5) = (is_late = 1)"
add(
    "confidence_routing",
    lambda spark, folder: evaluation.confidence_routing(
        _confident(spark, folder), "confidence", (F.col("score") >= 0.5) == (F.col("is_late") == 1)
    ),
    also(
        SCORED,
        f""", s AS (SELECT unnest([0.0, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]::DOUBLE[]) AS threshold),
        j AS (SELECT threshold, greatest(score, 1.0 - score) >= threshold AS kept, {CORRECT} AS correct FROM scored CROSS JOIN s)
        SELECT threshold, count_if(kept) AS accepted, {rnd('100.0 * count_if(kept) / count(*)', 1)} AS accepted_pct,
          {rnd('100.0 * count_if(kept AND correct) / count_if(kept)', 1)} AS accuracy_pct FROM j GROUP BY 1 HAVING count_if(kept) > 0""",
    ),
)
add(
    "confidence_by_outcome",
    lambda spark, folder: evaluation.confidence_by_outcome(
        _confident(spark, folder), "confidence", (F.col("score") >= 0.5) == (F.col("is_late") == 1)
    ),
    also(
        SCORED,
        f""" SELECT {CORRECT} AS correct, count(*) AS n, {rnd('avg(greatest(score, 1.0 - score))', 3)} AS mean,
        {rnd('min(greatest(score, 1.0 - score))', 3)} AS least, {rnd('max(greatest(score, 1.0 - score))', 3)} AS most FROM scored GROUP BY 1""",
    ),
)
_drivers = """list_filter([CASE WHEN fulfil_via = 'From RDC' THEN 'distribution centre fulfilment' END,
  CASE WHEN shipment_mode IN ('Ocean', 'Truck') THEN shipment_mode || ' transport' END,
  CASE WHEN scheduled_lead_time_days > 250 THEN 'long planned lead time (' || scheduled_lead_time_days || ' days)' END], lambda x: x IS NOT NULL)"""
add(
    "risk_band_and_drivers",
    lambda spark, folder: scoring.with_risk_band(t.scored_shipments(spark, folder), "score").select(
        *TIES, "prediction", "late_probability", "risk_band", "explanation"
    ),
    also(
        SCORED,
        f""" SELECT shipment_id, po_number, CASE WHEN score >= 0.5 THEN 'Late' ELSE 'On Time' END AS prediction, {rnd('score', 4)} AS late_probability,
          CASE WHEN score >= 0.35 THEN 'High' WHEN score >= 0.20 THEN 'Elevated' ELSE 'Low' END AS risk_band,
          'Late with probability ' || printf('%.1f', {rnd('100.0 * score', 1)}) || ' % (' || CASE WHEN score >= 0.35 THEN 'high' WHEN score >= 0.20 THEN 'elevated' ELSE 'low' END
          || ' risk). ' || CASE WHEN len({_drivers}) > 0 THEN 'Drivers: ' || array_to_string({_drivers}, '; ') || '.' ELSE 'No dominant driver.' END AS explanation
        FROM scored""",
    ),
)
add(
    "patient_explanation",
    lambda spark, folder: clinical.engineer_features(_clean(spark, folder).frame)
    .dropna()
    .withColumns({"prediction": F.col("Drug"), "confidence": F.lit(0.875)})
    .withColumn("explanation", scoring.clinical_explanation())
    .select("explanation"),
    RAW
    + f""", f AS ({FEATURES}) SELECT 'Age group ' || age_group || ', pressure ' || "BP" || ', cholesterol ' || "Cholesterol" || ', risk points '
      || CAST(CAST(combined_risk_score AS INTEGER) AS VARCHAR) || ' of 4; Na/K ratio ' || printf('%.2f', "Na_to_K") || ', band ' || na_to_k_band
      || CASE WHEN high_na_to_k = 1 THEN ', which decides most such cases' ELSE '' END || '. The model says ' || "Drug" || ' (87.5%).' AS explanation
      FROM f WHERE "Age" IS NOT NULL AND "Sex" IS NOT NULL AND "Na_to_K" IS NOT NULL AND "BP" IS NOT NULL AND "Cholesterol" IS NOT NULL""",
)

# --- fitted models ----------------------------------------------------------------------------
QUICK = replace(DEFAULTS, cv_folds=2)
_FITTED = {}


def _patient_model(spark, folder):
    key = (spark.sparkContext.applicationId, folder, t.folder_state(spark, folder), "patients")
    if key not in _FITTED:
        _FITTED[key] = training.train_drug_class(
            t.patients(spark, folder), families=("decision_tree", "random_forest"), tune=False, settings=QUICK
        )
    return _FITTED[key]


def _late_model(spark, folder):
    key = (spark.sparkContext.applicationId, folder, t.folder_state(spark, folder), "late")
    if key not in _FITTED:
        _FITTED[key] = training.train_late_delivery(
            t.stored_shipments(spark, folder), families=("decision_tree",), tune=False, settings=QUICK
        )
    return _FITTED[key]


add("drug_model_comparison", lambda spark, folder: _patient_model(spark, folder).comparison.drop("fit_seconds"))
add("drug_model_metrics", lambda spark, folder: _patient_model(spark, folder).metrics)
add("drug_model_importance", lambda spark, folder: _patient_model(spark, folder).importance)


def _patient_scores(spark, folder):
    trained = _patient_model(spark, folder)
    scored, _ = scoring.predict_patients(trained.model, trained.metadata, t.patients(spark, folder))
    return scored.withColumn("probabilities", F.to_json("probabilities"))


add("patient_batch_scores", _patient_scores)


def _late_search(spark, folder):
    """The tuned search over three families: the whole tree grid, five folds, all training rows.

    Forests and boosted trees take small grids.
    """
    forest = training.make_model("random_forest", 2)
    boosted = training.make_model("boosted_trees", 2)
    grids = {
        "random_forest": ParamGridBuilder().addGrid(forest.numTrees, [20]).addGrid(forest.maxDepth, [4, 8]).build(),
        "boosted_trees": ParamGridBuilder().addGrid(boosted.maxIter, [10]).addGrid(boosted.stepSize, [0.1, 0.2]).build(),
    }
    found = training.train_late_delivery(t.stored_shipments(spark, folder), grids=grids)
    return found.comparison.drop("fit_seconds")


add("late_model_search", _late_search)


def _patient_depths(spark, folder):
    """Accuracy by depth on patient features over five folds, from one fit a fold."""
    numeric, categorical = clinical.feature_columns()
    frame = clinical.engineer_features(clinical.clean_patients(t.patients(spark, folder)).frame).dropna()
    identity = [*clinical.NUMERIC, *clinical.CATEGORICAL]
    rows = frame.select(*[F.col(c).cast("double").alias(c) for c in numeric], *categorical, F.col(clinical.TARGET).alias("label"))
    split = evaluation.with_split(rows, "label", identity, 0.2, DEFAULTS.cv_folds, DEFAULTS.seed).filter("not is_test")
    stages = [StringIndexer(inputCol="label", outputCol="label_index"), *training.preprocessor(numeric, categorical)]
    ready = Pipeline(stages=stages).fit(split).transform(split).select("features", "label_index", "fold")
    return training.depth_sweep(settled(ready), list(range(0, 11)))


add("tree_depth_sweep", _patient_depths)
add("late_model_metrics", lambda spark, folder: _late_model(spark, folder).metrics)
add("late_model_importance", lambda spark, folder: _late_model(spark, folder).importance)


def _late_scores(spark, folder):
    trained = _late_model(spark, folder)
    inputs = [*TIES, *training.LATE_NUMERIC, *training.LATE_CATEGORICAL]
    scored = scoring.score_late_risk(
        trained.model, trained.metadata, t.stored_shipments(spark, folder).select(*inputs), TIES
    )
    return scored.groupBy("late_risk_decile").agg(
        F.count("*").alias("shipments"), F.avg("late_risk_probability").alias("mean_probability")
    )


add("late_risk_scores", _late_scores)


def _held_out_gains(spark, folder):
    trained = _late_model(spark, folder)
    held = trained.scored_test.withColumn("is_late", (F.col("label") == "Late").cast("int"))
    return evaluation.gains_curve(held, "proba_Late", "is_late", TIES)


add("held_out_gains_curve", _held_out_gains)


def _stored_summary(spark, folder):
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/models"
    trained = _patient_model(spark, folder)
    training.save_model(trained, "drug_classification", path)
    return training.model_summary(spark, "drug_classification", path).select("model_name", "class_labels", "test_size")


add("stored_model_summary", _stored_summary)


def _exported(spark, folder):
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/export-csv"
    files.write_csv(quality.missing_value_report(t.stored_shipments(spark, folder)), path)
    return spark.read.option("header", True).csv(path).select("column", "missing_count", "severity")


add(
    "csv_export",
    _exported,
    SHIP
    + f""", m AS ({MISSING}) SELECT "column", CAST(missing_count AS VARCHAR) AS missing_count, severity
      FROM (SELECT *, {SEVERITY} FROM m)""",
)
