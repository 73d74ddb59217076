"""Model training with Spark ML: frames, preprocessing, search, evaluation, storage."""

from __future__ import annotations

import json
import time
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import (
    Imputer,
    IndexToString,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockline.config import DEFAULTS, Settings
from dockline.operators import clinical, evaluation, tree_levels
from dockline.operators.quality import most_frequent
from dockline.plans.ranking import settled

# Inputs known when an order is placed, and what would leak the answer.
LATE_NUMERIC = (
    "quantity", "line_value_usd", "unit_price_usd", "units_per_pack", "weight_kg",
    "freight_cost_usd", "scheduled_lead_time_days",
)
LATE_CATEGORICAL = (
    "shipment_mode", "product_group", "sub_classification", "region", "fulfil_via", "inco_term",
    "managed_by", "first_line_designation",
)
LEAKING = (
    "date_delivered", "delivery_delay_days", "vendor_lead_time_days", "total_lead_time_days",
    "recording_lag_days",
)
FAMILIES = ("decision_tree", "random_forest", "boosted_trees")
MAX_DEPTH = 30
MAX_LABELS = 1_000
# a bounded search fits on partitions of about so many rows, but on no fewer than so many partitions
FIT_PARTITION_ROWS = 5_000
FIT_PARTITIONS = 8
TREE_DEPTHS = (3, 4, 5, 6, 8, MAX_DEPTH)
TREE_LEAF_ROWS = (1, 2, 3)
IMPURITIES = ("gini", "entropy")


def late_delivery_frame(df: DataFrame) -> DataFrame:
    """Rows with a known outcome, text label, and ``Unknown`` for null categories."""
    absent = sorted(set(LATE_NUMERIC + LATE_CATEGORICAL) - set(df.columns))
    if absent:
        raise ValueError(f"shipment table lacks feature(s) {absent}")
    if set(LATE_NUMERIC + LATE_CATEGORICAL) & set(LEAKING):
        raise ValueError("a feature is derived from the delivery date")
    keys = [c for c in ("shipment_id", "po_number") if c in df.columns]
    label = F.when(F.col("is_late") == 1, "Late").otherwise("On Time")
    return df.filter(F.col("is_late").isNotNull()).select(
        *keys,
        *[F.col(c).cast("double").alias(c) for c in LATE_NUMERIC],
        *[F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias(c) for c in LATE_CATEGORICAL],
        label.alias("label"),
    )


def preprocessor(numeric: list[str], categorical: list[str], scale: bool = True) -> list:
    """Stages: median imputation and scaling, indexing and one-hot encoding.

    The indexer gives an unseen level the last index, which the encoder drops,
    so it becomes all zeros.
    """
    if not numeric and not categorical:
        raise ValueError("at least one feature column is needed")
    stages, parts = [], []
    if numeric:
        filled = [f"{c}_filled" for c in numeric]
        stages.append(Imputer(strategy="median", inputCols=numeric, outputCols=filled))
        stages.append(VectorAssembler(inputCols=filled, outputCol="numbers", handleInvalid="keep"))
        parts.append("numbers")
        if scale:
            stages.append(StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True))
            parts[-1] = "scaled"
    if categorical:
        indexed = [f"{c}_index" for c in categorical]
        encoded = [f"{c}_levels" for c in categorical]
        stages.append(
            StringIndexer(inputCols=categorical, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc")
        )
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True))
        parts += encoded
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return stages


def fill_modes(train: DataFrame, categorical: list[str]) -> dict[str, str]:
    """Most frequent training level per column (one value per column is collected)."""
    rows = most_frequent(train, categorical).select("column", "top").collect()
    return {row["column"]: row["top"] for row in rows}


def make_model(family: str, classes: int, seed: int = DEFAULTS.seed):
    """An untuned estimator of one family.

    Boosting is binary in Spark, so more classes go through one-against-rest.
    """
    columns = {"labelCol": "label_index", "featuresCol": "features"}
    if family == "decision_tree":
        return DecisionTreeClassifier(seed=seed, **columns)
    if family == "random_forest":
        return RandomForestClassifier(seed=seed, **columns)
    if family == "boosted_trees":
        booster = GBTClassifier(seed=seed, **columns)
        return booster if classes == 2 else OneVsRest(classifier=booster, **columns)
    raise ValueError(f"unknown model family {family!r}; known: {list(FAMILIES)}")


def search_grid(family: str, model, classes: int) -> list[dict]:
    """Parameter grid of a family.

    Spark has no split minimum and caps depth at 30, so leaf minimum and that
    cap stand in for them.
    """
    builder = ParamGridBuilder()
    if family == "decision_tree":
        builder = builder.addGrid(model.maxDepth, list(TREE_DEPTHS))
        builder = builder.addGrid(model.minInstancesPerNode, list(TREE_LEAF_ROWS))
        builder = builder.addGrid(model.impurity, list(IMPURITIES))
    elif family == "random_forest":
        builder = builder.addGrid(model.numTrees, [200, 400])
        builder = builder.addGrid(model.maxDepth, [4, 6, 8, MAX_DEPTH])
        builder = builder.addGrid(model.minInstancesPerNode, [1, 2])
    else:
        booster = model if classes == 2 else model.getClassifier()
        builder = builder.addGrid(booster.maxIter, [200, 400])
        builder = builder.addGrid(booster.maxDepth, [3, 4, 6])
        builder = builder.addGrid(booster.stepSize, [0.05, 0.1, 0.2])
        builder = builder.addGrid(booster.subsamplingRate, [0.8, 1.0])
    return builder.build()


class MacroF1(Evaluator):
    """Unweighted mean of per-class F1 over classes seen in truth or prediction."""

    def _evaluate(self, dataset: DataFrame) -> float:
        pairs = dataset.select(
            F.col("label_index").alias("actual"), F.col("prediction").alias("predicted")
        )
        return float(evaluation.classification_metrics(pairs).first()["f1_macro"])

    def isLargerBetter(self) -> bool:
        return True


class Trained(NamedTuple):
    model: PipelineModel
    family: str
    labels: list[str]
    comparison: DataFrame
    scored_test: DataFrame
    metrics: DataFrame
    importance: DataFrame
    metadata: dict


def with_class_columns(scored: DataFrame, labels: list[str]) -> DataFrame:
    """Class text, confidence and one probability column per class."""
    text = IndexToString(inputCol="prediction", outputCol="predicted", labels=labels)
    out = text.transform(scored)
    if "probability" in out.columns:
        shares = vector_to_array("probability")
    else:
        # one-against-rest keeps a margin per class; squash and normalise it
        raw = F.transform(vector_to_array("rawPrediction"), lambda m: 1.0 / (1.0 + F.exp(-m)))
        total = F.aggregate(raw, F.lit(0.0), lambda a, b: a + b)
        shares = F.transform(raw, lambda v: v / total)
    out = out.withColumn("_shares", shares)
    return out.withColumns(
        {
            "confidence": F.array_max("_shares"),
            **{f"proba_{label}": F.col("_shares")[i] for i, label in enumerate(labels)},
        }
    ).drop("_shares")


def feature_importance(model: PipelineModel, frame: DataFrame, numeric: list[str]) -> DataFrame:
    """Importance per input with readable names, largest first.

    Scaling drops the input names, so its outputs are named from ``numeric``.
    """
    fitted = model.stages[-1]
    names: dict[int, str] = {}
    attributes = model.transform(frame.limit(0)).schema["features"].metadata["ml_attr"]["attrs"]
    for kind in attributes.values():
        for attribute in kind:
            names[attribute["idx"]] = attribute["name"].replace("_levels_", "_")
    for place, name in names.items():
        prefix, _, number = name.rpartition("_")
        if prefix in ("scaled", "numbers") and number.isdigit():
            names[place] = numeric[int(number)]
    spark = frame.sparkSession
    if not hasattr(fitted, "featureImportances"):
        vectors = [m.featureImportances.toArray() for m in fitted.models]
        values = sum(vectors) / len(vectors)
    else:
        values = fitted.featureImportances.toArray()
    rows = [(names.get(i, str(i)), float(v)) for i, v in enumerate(values)]
    out = spark.createDataFrame(rows, "feature string, importance double")
    return out.orderBy(F.col("importance").desc(), "feature")


class _Found(NamedTuple):
    model: object
    params: dict
    cv_mean: float
    cv_std: float
    points: int


def _tuned_tree(ready: DataFrame, tree: DecisionTreeClassifier, settings: Settings) -> _Found:
    """The best point of the tree grid (of equal ones the first), fitted on all rows."""
    searched = tree_levels.tree_search(ready, list(TREE_DEPTHS), list(TREE_LEAF_ROWS), list(IMPURITIES), settings).collect()
    best = max(searched, key=lambda r: (r["cv_mean"], -r["max_depth"], -r["min_rows"], r["impurity"] == IMPURITIES[0]))
    params = {"maxDepth": best["max_depth"], "minInstancesPerNode": best["min_rows"], "impurity": best["impurity"]}
    return _Found(tree.copy().setParams(**params).fit(ready), params, best["cv_mean"], best["cv_std"], len(searched))


def _cross_validated(ready: DataFrame, estimator, grid: list[dict], settings: Settings, parallelism: int) -> _Found:
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=grid,
        evaluator=MacroF1(),
        numFolds=settings.cv_folds,
        foldCol="fold",
        parallelism=parallelism,
        seed=settings.seed,
    ).fit(ready)
    place = max(range(len(grid)), key=lambda i: search.avgMetrics[i])
    params = {p.name: v for p, v in grid[place].items()}
    return _Found(search.bestModel, params, float(search.avgMetrics[place]), float(search.stdMetrics[place]), len(grid))


def train_classifier(
    frame: DataFrame,
    numeric: list[str],
    categorical: list[str],
    identity: list[str],
    families: tuple[str, ...] = FAMILIES,
    grids: dict[str, list[dict]] | None = None,
    tune: bool = True,
    settings: Settings = DEFAULTS,
    parallelism: int = 4,
    fit_rows: int | None = None,
) -> Trained:
    """Split, search by stratified cross-validation, pick by its score, evaluate on the test rows.

    ``frame`` has a text ``label``. The test rows never take part in choosing. ``fit_rows``
    bounds the rows that models are fitted on to about that many, the training rows of the
    smallest hashes of ``identity``; all test rows are scored. A tuned decision tree without a
    grid of its own takes one fit for all depths.
    """
    usable = frame.filter(F.col("label").isNotNull())
    labels = [r[0] for r in usable.select("label").distinct().orderBy("label").limit(MAX_LABELS + 1).collect()]
    if len(labels) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels; not a class column")
    # the ranked rows are checkpointed in there; flag and fold are two joins with a few rows
    split = evaluation.with_split(usable, "label", identity, settings.test_size, settings.cv_folds, settings.seed)
    modes = fill_modes(split.filter("not is_test"), categorical)
    split = split.fillna(modes)
    indexer = StringIndexerModel.from_labels(labels, inputCol="label", outputCol="label_index")
    split = indexer.transform(split)
    train, test = split.filter("not is_test"), split.filter("is_test")
    if fit_rows is not None and (rows_held := train.count()) > fit_rows:
        # the hash is even over 2^32 values
        train = train.filter(F.pmod(F.xxhash64(*identity), F.lit(1 << 32)) < int(fit_rows / rows_held * (1 << 32)))
    prepared = Pipeline(stages=preprocessor(numeric, categorical)).fit(train)
    ready = prepared.transform(train).select("features", "label_index", "fold")
    if fit_rows is not None:
        # every level of every tree runs a task a partition, so a few rows don't stay in as many as all rows came in
        ready = ready.coalesce(max(FIT_PARTITIONS, -(-fit_rows // FIT_PARTITION_ROWS)))
    ready = settled(ready)

    rows, fitted = [], {}
    for family in families:
        start = time.perf_counter()
        estimator = make_model(family, len(labels), settings.seed)
        own = (grids or {}).get(family)
        if family == "decision_tree" and tune and own is None:
            found = _tuned_tree(ready, estimator, settings)
        else:
            found = _cross_validated(ready, estimator, own or (search_grid(family, estimator, len(labels)) if tune else [{}]),
                                     settings, parallelism)
        model = PipelineModel(stages=[*prepared.stages, found.model])
        fitted[family] = (model, found.params)
        scored = with_class_columns(model.transform(test), labels)
        metrics = evaluation.classification_metrics(scored, "label", "predicted").first()
        rows.append(
            (
                family,
                found.cv_mean,
                found.cv_std,
                found.points,
                json.dumps(found.params, sort_keys=True),
                metrics["accuracy"],
                metrics["f1_macro"],
                metrics["precision_macro"],
                metrics["recall_macro"],
                round(time.perf_counter() - start, 2),
            )
        )
    spark = frame.sparkSession
    comparison = spark.createDataFrame(
        rows,
        "model string, cv_mean double, cv_std double, points int, params string, test_accuracy double, test_f1_macro double, "
        "test_precision double, test_recall double, fit_seconds double",
    ).orderBy(F.col("cv_mean").desc(), "model")
    best = max(rows, key=lambda r: r[1])[0]
    model, chosen = fitted[best]
    scored_test = with_class_columns(model.transform(test), labels)
    metadata = {
        "model_name": best,
        "params": chosen,
        "numeric_features": numeric,
        "categorical_features": categorical,
        "class_labels": labels,
        "fill_levels": modes,
        "test_size": settings.test_size,
        "cv_folds": settings.cv_folds,
        "cv_scoring": "f1_macro",
        "cv_best_score": max(r[1] for r in rows),
        "random_seed": settings.seed,
    }
    return Trained(
        model,
        best,
        labels,
        comparison,
        scored_test,
        evaluation.classification_metrics(scored_test, "label", "predicted"),
        feature_importance(model, train, numeric),
        metadata,
    )


def train_late_delivery(shipments: DataFrame, **options) -> Trained:
    """Model of late delivery from what is known when the order is placed."""
    return train_classifier(
        late_delivery_frame(shipments),
        list(LATE_NUMERIC),
        list(LATE_CATEGORICAL),
        ["shipment_id", "po_number"],
        **options,
    )


def train_drug_class(patients: DataFrame, **options) -> Trained:
    """Model of the prescribed drug from cleaned and engineered patient features."""
    frame = clinical.engineer_features(clinical.clean_patients(patients).frame)
    numeric, categorical = clinical.feature_columns()
    identity = [*clinical.NUMERIC, *clinical.CATEGORICAL]
    frame = frame.select(
        *[F.col(c).cast("double").alias(c) for c in numeric],
        *categorical,
        F.col(clinical.TARGET).alias("label"),
    )
    return train_classifier(frame, numeric, categorical, identity, **options)


def depth_sweep(trained_frame: DataFrame, depths: list[int], settings: Settings = DEFAULTS) -> DataFrame:
    """Cross-validated accuracy of a tree per depth, from one fit a fold.

    ``trained_frame`` has ``features``, ``label_index`` and ``fold``.
    """
    return tree_levels.accuracy_by_depth(tree_levels.fold_counts(trained_frame, depths, settings))


# --- storage --------------------------------------------------------------------------
def save_model(trained: Trained, name: str, path: str) -> None:
    """Fitted stages, one metadata record, and the report tables under ``path/name``."""
    trained.model.write().overwrite().save(f"{path}/{name}/model")
    spark = trained.comparison.sparkSession
    metadata = dict(trained.metadata, artifact_name=name, metrics=trained.metrics.first().asDict())
    spark.createDataFrame([(json.dumps(metadata),)], "metadata string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/{name}/metadata")
    labels = {label: f"proba_{label}" for label in trained.labels}
    points = evaluation.curve_points(trained.scored_test, labels, "label")
    reports = {
        "comparison": trained.comparison,
        "importance": trained.importance,
        "confusion": evaluation.confusion_matrix(trained.scored_test, trained.labels, "label", "predicted"),
        "per_class": evaluation.per_class_report(trained.scored_test, "label", "predicted"),
        "curves": points,
    }
    for report, frame in reports.items():
        frame.write.mode("overwrite").json(f"{path}/{name}/{report}")


class Loaded(NamedTuple):
    model: PipelineModel
    metadata: dict


def load_model(spark: SparkSession, name: str, path: str) -> Loaded:
    """The fitted stages and their metadata record."""
    record = spark.read.text(f"{path}/{name}/metadata").first()[0]
    return Loaded(PipelineModel.load(f"{path}/{name}/model"), json.loads(record))


def model_summary(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The stored metadata record as one row."""
    return spark.read.json(f"{path}/{name}/metadata")


def train_all(shipments: DataFrame, patients: DataFrame, path: str, **options) -> dict[str, Trained]:
    """Train and store both models."""
    results = {
        "drug_classification": train_drug_class(patients, **options),
        "late_delivery": train_late_delivery(shipments, **options),
    }
    for name, trained in results.items():
        save_model(trained, name, path)
    return results
