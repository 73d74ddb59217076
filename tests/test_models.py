"""Patient cleaning, splits and fitted models."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from dockline.config import DEFAULTS
from dockline.operators import clinical, evaluation, scoring, training, tree_levels
from dockline.sources import tables
from tests.conftest import SMALL

KNOWN = [
    (23, "F", "HIGH", "HIGH", 25.355, "DrugY"),
    (47, "M", "LOW", "HIGH", 13.093, "drugC"),
    (28, "F", "NORMAL", "HIGH", 7.798, "drugX"),
    (43, "M", "HIGH", "HIGH", 13.972, "drugA"),
    (74, "M", "HIGH", "HIGH", 9.567, "drugB"),
]
SCHEMA = "Age string, Sex string, BP string, Cholesterol string, Na_to_K double, Drug string"


def _dirty(spark):
    rows = [
        (None, "f", "high", "HIGH", 25.0, "DrugY"),
        ("30", "F ", "High", "HIGH ", 12.0, "drugA"),
        ("30", "F", "HIGH", "HIGH", 12.0, "drugA"),
        ("-5", "m", " LOW", "normal", 11.0, "drugX"),
        ("250", "M", None, "NORMAL", None, "drugX"),
        ("999", "M", "LOW", None, 9.0, "drugC"),
        ("0", "M", "LOW", "HIGH", 9.5, "drugC"),
        ("60", "M", "NORMAL", "HIGH", 15.0, "DrugY"),
        ("60", "M", "NORMAL", "HIGH", 15.0, "DrugY"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_missing_column_raises(spark):
    with pytest.raises(ValueError):
        clinical.clean_patients(spark.createDataFrame([(1,)], "Age int"))


def test_cleaning_counts_edits_and_copies(spark):
    row = clinical.clean_patients(_dirty(spark)).log.first()
    assert (row["rows_in"], row["rows_out"], row["duplicates_dropped"]) == (9, 7, 2)
    assert (row["Sex_edited"], row["BP_edited"], row["Cholesterol_edited"]) == (3, 3, 2)


def test_imputed_table_passes_every_assertion(spark):
    cleaned = clinical.clean_and_impute(_dirty(spark))
    results = {r["check"]: r["result"] for r in clinical.cleaning_assertions(cleaned.frame).collect()}
    assert set(results.values()) == {"PASS"}
    before = clinical.cleaning_assertions(clinical.clean_patients(_dirty(spark)).frame).collect()
    assert "FAIL" in {r["result"] for r in before}
    fixed = {(r["step"], r["column"]): r["rows_fixed"] for r in cleaned.log.collect()}
    assert fixed[("range check", "Age")] == 3 and fixed[("median imputation", "Age")] == 4


def test_bands_are_left_closed(spark):
    df = spark.createDataFrame(
        [("30", "F", "HIGH", "NORMAL", 15.0, "x"), ("60", "F", "LOW", "HIGH", 10.0, "x"), (None, "F", None, "HIGH", None, "x")],
        SCHEMA,
    )
    rows = clinical.engineer_features(clinical.clean_patients(df).frame).orderBy(F.col("Age").asc_nulls_last()).collect()
    assert [(r["age_group"], r["na_to_k_band"], r["high_na_to_k"]) for r in rows] == [
        ("30-45", "High", 1), ("60+", "Normal", 0), (None, None, 0),
    ]
    assert [r["combined_risk_score"] for r in rows] == [3.0, 2.0, None]


def test_screening_splits_without_raising(spark):
    found = clinical.screen_inputs(_dirty(spark).union(spark.createDataFrame([("40", "X", "HIGH", "HIGH", float("inf"), "d")], SCHEMA)))
    bad = [r["invalid_fields"] for r in found.quarantined.collect()]
    assert "Na_to_K, Sex" in bad and "Age" in bad
    assert {r["BP"] for r in found.accepted.collect()} <= {"HIGH", "LOW", "NORMAL"}


def test_split_is_stratified_and_repeatable(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("label"))
    one, two = (evaluation.with_split(df, "label", ["id"]).orderBy("id").collect() for _ in range(2))
    assert one == two
    held = [r["label"] for r in one if r["is_test"]]
    assert (held.count("rare"), held.count("common")) == (25, 225)
    assert {r["fold"] for r in one if not r["is_test"]} == {0, 1, 2, 3, 4}


def test_deciles_match_rank_cuts(spark):
    for n in (13, 25, 104):
        df = spark.range(n).withColumn("s", (F.col("id") % 7).cast("double"))
        got = evaluation.with_deciles(df, "s", ["id"]).orderBy(F.col("s").desc(), "id").collect()
        want = [max(1, -(-(g * 10) // (n - 1))) for g in range(n)]
        assert [r["decile"] for r in got] == want


def test_leakage_is_refused_and_features_are_checked(ship):
    assert not set(training.LATE_NUMERIC + training.LATE_CATEGORICAL) & set(training.LEAKING)
    with pytest.raises(ValueError):
        training.late_delivery_frame(ship.drop("quantity"))
    with pytest.raises(ValueError):
        training.make_model("perceptron", 2)
    with pytest.raises(ValueError):
        training.preprocessor([], [])


@pytest.fixture(scope="module")
def trained(spark):
    known = spark.createDataFrame([(str(r[0]), *r[1:]) for r in KNOWN], SCHEMA)
    patients = tables.patients(spark, SMALL).union(known)
    quick = replace(DEFAULTS, cv_folds=2)
    return training.train_drug_class(patients, families=("decision_tree",), tune=False, settings=quick)


def test_fitted_model_contract(trained):
    matrix = evaluation.confusion_matrix(trained.scored_test, trained.labels, "label", "predicted").toPandas()
    assert matrix[trained.labels].to_numpy().sum() == trained.scored_test.count()
    assert trained.importance.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    names = {r["feature"] for r in trained.importance.collect()}
    assert {"Age", "Na_to_K", "BP_HIGH", "Sex_F"} <= names
    assert trained.metrics.first()["accuracy"] > 0.5


def test_model_store_round_trip_and_scoring(spark, trained, tmp_path):
    training.save_model(trained, "drug", str(tmp_path))
    loaded = training.load_model(spark, "drug", str(tmp_path))
    assert training.model_summary(spark, "drug", str(tmp_path)).first()["model_name"] == "decision_tree"
    cohort = spark.createDataFrame(
        [("p1", "23", "f", "high", "HIGH", 25.355), ("p2", "oops", "F", "HIGH", "HIGH", 9.0), ("p1", "23", "f", "high", "HIGH", 25.355)],
        "id string, Age string, Sex string, BP string, Cholesterol string, Na_to_K double",
    )
    scored, rejected = scoring.predict_patients(loaded.model, loaded.metadata, cohort)
    rows = scored.collect()
    assert len(rows) == 2 and rows[0]["prediction"] == "DrugY" and rows[0]["id"] == "p1"
    assert sum(rows[0][f"proba_{v}"] for v in trained.labels) == pytest.approx(1.0, abs=1e-3)
    assert list(rows[0]["probabilities"].values()) == sorted(rows[0]["probabilities"].values(), reverse=True)
    assert "Na/K ratio 25.36" in rows[0]["explanation"] or "Na/K ratio 25.35" in rows[0]["explanation"]
    assert rejected.count() == 1


def test_boosted_trees_handle_many_classes(spark):
    model = training.make_model("boosted_trees", 3)
    grid = training.search_grid("boosted_trees", model, 3)
    assert len(grid) == 36
    assert len(training.search_grid("decision_tree", training.make_model("decision_tree", 3), 3)) == 36


def _prepared(spark, rows=600):
    """Numbers and one-hot categories with a noisy label of three classes, in three folds."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    df = spark.range(rows).select(
        "id", (F.xxhash64("id") % 1000 / 100.0).alias("x"), (F.xxhash64("id", F.lit(1)) % 50).cast("double").alias("y"),
        F.concat(F.lit("c"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(4)).cast("string")).alias("c"), F.pmod("id", F.lit(3)).alias("fold"))
    noise = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(7)) == 0
    label = F.when(noise, F.pmod("id", F.lit(3))).when(F.col("c") == "c1", 2).when(F.col("x") + F.col("y") / 10 > 1, 1).otherwise(0)
    stages = [StringIndexer(inputCol="c", outputCol="ci"), OneHotEncoder(inputCol="ci", outputCol="cv"),
              VectorAssembler(inputCols=["x", "y", "cv", "ci"], outputCol="features")]
    return Pipeline(stages=stages).fit(df).transform(df.withColumn("label_index", label.cast("double"))).select("features", "label_index", "fold").cache()


def test_one_fit_gives_the_scores_of_a_fit_for_each_depth(spark):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    frame, settings, depths = _prepared(spark), replace(DEFAULTS, cv_folds=3), [0, 1, 3, 12]
    tree = DecisionTreeClassifier(labelCol="label_index", featuresCol="features", seed=settings.seed, minInstancesPerNode=2, impurity="entropy")
    grid = ParamGridBuilder().addGrid(tree.maxDepth, depths).build()
    apart = CrossValidator(estimator=tree, estimatorParamMaps=grid, evaluator=training.MacroF1(), numFolds=3, foldCol="fold").fit(frame)
    found = tree_levels.tree_search(frame, depths, [2], ["entropy"], settings).collect()
    assert [r["max_depth"] for r in found] == depths
    # the evaluator rounds each fold's score to six places
    assert [r["cv_mean"] for r in found] == pytest.approx(apart.avgMetrics, abs=6e-7)
    assert [r["cv_std"] for r in found] == pytest.approx(apart.stdMetrics, abs=1e-6)
    sweep = training.depth_sweep(frame, [0, 2], settings).collect()
    for row in sweep:
        hits = []
        for fold in range(3):
            model = tree.copy().setParams(maxDepth=row["max_depth"], minInstancesPerNode=1, impurity="gini").fit(frame.filter(F.col("fold") != fold))
            scored = model.transform(frame.filter(F.col("fold") == fold))
            hits.append(scored.agg(F.avg((F.col("prediction") == F.col("label_index")).cast("double"))).first()[0])
        assert row["cv_accuracy"] == pytest.approx(sum(hits) / 3, abs=1e-9)
    nodes = tree_levels.node_arrays(tree.fit(frame), frame)
    assert tree_levels.level_counts(frame.limit(0), nodes, depths).collect() == []


def test_a_tuned_search_reports_its_points_and_bounds_its_rows(spark):
    df = spark.range(900).select(
        "id", (F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "u").otherwise("v").alias("c"),
        F.when(F.col("id") % 10 > 6, "Late").otherwise("OnTime").alias("label"))
    found = training.train_classifier(df, ["x"], ["c"], ["id"], families=("decision_tree",), settings=replace(DEFAULTS, cv_folds=2), fit_rows=300)
    row = found.comparison.first()
    assert row["points"] == 36 and row["cv_mean"] == 1.0 and '"maxDepth": 3' in row["params"]
    assert found.scored_test.count() == found.scored_test.filter("is_test").count() == 226


def test_a_bounded_search_fits_on_few_partitions(spark, monkeypatch):
    df = spark.range(400).select(
        "id", (F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "u").otherwise("v").alias("c"),
        F.when(F.col("id") % 10 > 6, "Late").otherwise("OnTime").alias("label"))
    seen, tuned = [], training._tuned_tree
    monkeypatch.setattr(training, "_tuned_tree", lambda ready, *rest: seen.append(ready.rdd.getNumPartitions()) or tuned(ready, *rest))
    monkeypatch.setattr(training, "TREE_DEPTHS", (3,))
    monkeypatch.setattr(training, "TREE_LEAF_ROWS", (1,))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        found = training.train_classifier(df, ["x"], ["c"], ["id"], families=("decision_tree",), settings=replace(DEFAULTS, cv_folds=2), fit_rows=300)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen == [training.FIT_PARTITIONS] and found.comparison.first()["cv_mean"] == 1.0


def test_scoring_runs_the_model_once(spark, monkeypatch):
    runs = spark.sparkContext.accumulator(0)

    def probability(model, metadata, shipments):
        count = F.udf(lambda v: runs.add(1) or v / 7.0, "double").asNondeterministic()
        return shipments.withColumn("late_risk_probability", count(F.pmod("id", F.lit(7))))

    monkeypatch.setattr(scoring, "late_probability", probability)
    df = spark.range(104).withColumn("s", F.col("id").cast("double"))
    got = scoring.score_late_risk(None, {}, df, ["id"]).orderBy(F.col("late_risk_probability").desc(), "id").collect()
    assert [r["late_risk_decile"] for r in got] == [max(1, -(-(g * 10) // 103)) for g in range(104)]
    assert runs.value == 104
