"""All depths of a decision tree from one fit.

A tree chooses each split from the rows that reach its node, whatever the depth
allowed below it, and a node that is cut off answers with its own majority class. So
the tree of depth d is a deeper one read down to level d only, and a sweep over depths
needs one fit a fold, and one scan of the fold's rows that counts the answers of all
levels. The bounds are the fitted tree (at most one leaf a training row) and a count
for each depth and pair of classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockline.config import DEFAULTS, Settings
from dockline.plans.ranking import settled, use_checkpoint_dir

COUNTS = "max_depth int, actual long, predicted long, n long"


def node_arrays(model: DecisionTreeClassificationModel, frame: DataFrame) -> dict[str, np.ndarray]:
    """The nodes of a fitted tree in the order of their ids, read from its stored form.

    `feature` is -1 in a leaf; `category` tells whether the split is on categories, of
    which those in the bits of `goes_left` go left, or on `threshold`.
    """
    spark = frame.sparkSession
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tree-{model.uid}"
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "id", "prediction", "leftChild", "rightChild", "split.featureIndex", "split.leftCategoriesOrThreshold", "split.numCategories"
    ).toPandas().sort_values("id")
    inner = nodes["leftChild"].to_numpy() >= 0
    category = inner & (nodes["numCategories"].to_numpy() >= 0)
    limits = [list(v) if v is not None else [] for v in nodes["leftCategoriesOrThreshold"]]
    return {
        "prediction": nodes["prediction"].to_numpy().astype(np.int64),
        "feature": np.where(inner, nodes["featureIndex"].to_numpy(), -1).astype(np.int64),
        "left": nodes["leftChild"].to_numpy().astype(np.int64),
        "right": nodes["rightChild"].to_numpy().astype(np.int64),
        "category": category,
        "goes_left": np.array([sum(1 << int(v) for v in x) if c else 0 for x, c in zip(limits, category, strict=True)], np.int64),
        "threshold": np.array([x[0] if i and not c else 0.0 for x, i, c in zip(limits, inner, category, strict=True)], np.float64),
    }


def level_counts(frame: DataFrame, nodes: dict[str, np.ndarray], depths: list[int]) -> DataFrame:
    """(max_depth, actual, predicted, n): answers of the tree read down to each depth, over the
    rows (features, label_index) of `frame`; an empty frame gives no row.
    """
    shared = frame.sparkSession.sparkContext.broadcast(nodes)  # a fitted model
    wanted = sorted(set(depths))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            actual = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            every, at = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            out: list[list[np.ndarray]] = [[], [], [], []]
            level = 0
            for depth in wanted:
                while level < depth:
                    feature = tree["feature"][at]
                    inner = feature >= 0
                    value = x[every, np.maximum(feature, 0)]
                    category = tree["category"][at]
                    bit = np.where(category, value, 0.0).astype(np.int64)
                    left = np.where(category, (tree["goes_left"][at] >> bit) & 1 == 1, value <= tree["threshold"][at])
                    at = np.where(inner, np.where(left, tree["left"][at], tree["right"][at]), at)
                    level += 1
                pairs, n = np.unique(np.stack([actual, tree["prediction"][at]], 1), axis=0, return_counts=True)
                for part, column in zip(out, (np.full(len(n), depth), pairs[:, 0], pairs[:, 1], n), strict=True):
                    part.append(column)
            columns = [np.concatenate(part) for part in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                names=["max_depth", "actual", "predicted", "n"])

    rows = frame.select(vector_to_array("features").alias("x"), F.col("label_index").cast("double"))
    return rows.mapInArrow(work, COUNTS).groupBy("max_depth", "actual", "predicted").agg(F.sum("n").alias("n"))


def fold_counts(frame: DataFrame, depths: list[int], settings: Settings = DEFAULTS, **params) -> DataFrame:
    """`level_counts` of every held-out fold, with `fold`; one fit of the greatest depth a fold.

    `frame` has `features`, `label_index` and `fold`; `params` go to the tree.
    """
    tree = DecisionTreeClassifier(
        labelCol="label_index", featuresCol="features", seed=settings.seed, maxDepth=max(depths), **params)
    counted = []
    for fold in range(settings.cv_folds):
        model = tree.fit(frame.filter(F.col("fold") != fold))
        held = level_counts(frame.filter(F.col("fold") == fold), node_arrays(model, frame), depths)
        counted.append(held.withColumn("fold", F.lit(fold)))
    return reduce(DataFrame.unionAll, counted)


def accuracy_by_depth(counts: DataFrame) -> DataFrame:
    """(max_depth, cv_accuracy, cv_std) over the folds of `fold_counts`, by depth."""
    hits = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    folds = counts.groupBy("max_depth", "fold").agg((hits / F.sum("n")).alias("accuracy"))
    return folds.groupBy("max_depth").agg(
        F.avg("accuracy").alias("cv_accuracy"), F.stddev_pop("accuracy").alias("cv_std")).orderBy("max_depth")


def macro_f1(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, f1): mean F1 over the classes seen in truth or answer, from counts of pairs."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    truth = counts.select(*keys, F.col("actual").alias("class"), (2 * hit).alias("both"), "n")
    answer = counts.select(*keys, F.col("predicted").alias("class"), F.lit(0).cast("long").alias("both"), "n")
    # a class's F1 is twice its hits over its rows in truth plus its rows in the answers
    classes = truth.unionAll(answer).groupBy(*keys, "class").agg((F.sum("both") / F.sum("n")).alias("f1"))
    return classes.groupBy(*keys).agg(F.avg("f1").alias("f1"))


def tree_search(frame: DataFrame, depths: list[int], leaf_rows: list[int], impurities: list[str],
                settings: Settings = DEFAULTS) -> DataFrame:
    """(max_depth, min_rows, impurity, cv_mean, cv_std): cross-validated macro F1 of every point
    of the grid, from one fit for each leaf minimum, impurity and fold.
    """
    parts = []
    for rows in leaf_rows:
        for impurity in impurities:
            counts = fold_counts(frame, depths, settings, minInstancesPerNode=rows, impurity=impurity)
            parts.append(counts.withColumns({"min_rows": F.lit(rows), "impurity": F.lit(impurity)}))
    point = ["max_depth", "min_rows", "impurity"]
    counts = settled(reduce(DataFrame.unionAll, parts))
    return macro_f1(counts, [*point, "fold"]).groupBy(*point).agg(
        F.avg("f1").alias("cv_mean"), F.stddev_pop("f1").alias("cv_std")).orderBy(*point)
