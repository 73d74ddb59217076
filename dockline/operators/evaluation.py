"""Splits, classification metrics, curves, deciles and gains over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockline.config import DEFAULTS, Settings
from dockline.functions.columns import inline_rows, percent, rounded, tally
from dockline.operators.comparison import crosstab
from dockline.plans.cuts import Term, keys_at_score_ranks, precedes
from dockline.plans.ranking import packed, running, small_or_stored


# --- splits ---------------------------------------------------------------------------
def with_split(
    df: DataFrame,
    label: str,
    identity: list[str],
    test_size: float = DEFAULTS.test_size,
    folds: int = DEFAULTS.cv_folds,
    seed: int = DEFAULTS.seed,
) -> DataFrame:
    """Stratified, reproducible ``is_test`` flag and training ``fold``.

    Rows are ordered inside their class by a hash of seed and identity; the
    first share is the test set and the rest go round the folds. ``identity``
    must be unique per row.
    """
    shuffled = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity]))
    order = [F.col(c).asc() for c in identity]
    ranked = running(df, order, keys=[label], row_number="_rank", by=shuffled, store=packed)
    sizes = df.groupBy(label).agg(F.count("*").alias("_size"))
    held = F.rint(F.col("_size") * test_size).cast("long")
    return (
        ranked.join(small_or_stored(sizes), label)
        .withColumn("is_test", F.col("_rank") <= held)
        .withColumn("fold", F.when(~F.col("is_test"), ((F.col("_rank") - held - 1) % folds).cast("int")))
        .drop("_rank", "_size")
    )


# --- metrics from predictions -----------------------------------------------------------
def confusion_matrix(df: DataFrame, labels: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Counts with a row per actual class and a column per listed predicted class."""
    return crosstab(df, actual, predicted, labels)


def per_class_report(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per class seen in truth or prediction."""
    cells = df.groupBy(actual, predicted).agg(F.count("*").alias("n"))
    sides = F.explode(
        F.array(
            F.struct(F.col(actual).alias("label"), F.lit(True).alias("truth")),
            F.struct(F.col(predicted).alias("label"), F.lit(False).alias("truth")),
        )
    )
    rows = cells.select("n", (F.col(actual) == F.col(predicted)).alias("hit"), sides.alias("s"))
    by_label = rows.groupBy("s.label").agg(
        F.sum(F.when(F.col("s.truth"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("s.truth"), F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("s.truth") & F.col("hit"), F.col("n")).otherwise(0)).alias("hits"),
    )

    def share(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    hits = F.col("hits")
    return by_label.select(
        "label",
        share(hits, F.col("predicted")).alias("precision"),
        share(hits, F.col("support")).alias("recall"),
        share(2.0 * hits, F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "hits",
    ).orderBy("label")


def classification_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Accuracy, macro and weighted F1, macro precision and recall in one row."""
    report = per_class_report(df, actual, predicted)
    return report.agg(
        rounded(F.sum("hits") / F.sum("support"), 6).alias("accuracy"),
        rounded(F.avg("f1"), 6).alias("f1_macro"),
        rounded(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("f1_weighted"),
        rounded(F.avg("precision"), 6).alias("precision_macro"),
        rounded(F.avg("recall"), 6).alias("recall_macro"),
    )


# --- curves --------------------------------------------------------------------------------
def _one_against_rest(df: DataFrame, actual: str, scores: dict[str, str]) -> DataFrame:
    cells = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.col(c).cast("double").alias("score"), (F.col(actual) == label).alias("hit"))
            for label, c in scores.items()
        ]
    )
    return df.select(F.explode(cells).alias("c")).select("c.*").filter("score is not null and hit is not null")


def curve_points(df: DataFrame, scores: dict[str, str], actual: str = "actual") -> DataFrame:
    """ROC and precision-recall points per class, one per distinct score.

    ``scores`` maps a class to its score column. Counts are grouped per score
    before they are accumulated over a range-partitioned order.
    """
    rows = _one_against_rest(df, actual, scores)
    counts = rows.groupBy("label", "score").agg(
        tally(F.col("hit")).alias("positives"), tally(~F.col("hit")).alias("negatives")
    )
    placed = running(
        counts, [F.col("score").desc()], keys=["label"], sums={"tp": "positives", "fp": "negatives"}
    )
    totals = counts.groupBy("label").agg(
        F.sum("positives").alias("all_positives"), F.sum("negatives").alias("all_negatives")
    )
    return (
        placed.join(small_or_stored(totals), "label")
        .filter("all_positives > 0")
        .withColumns(
            {
                "tpr": F.col("tp") / F.col("all_positives"),
                "fpr": F.try_divide(F.col("fp"), F.col("all_negatives")),
                "precision": F.col("tp") / (F.col("tp") + F.col("fp")),
            }
        )
    )


def auc_per_class(points: DataFrame) -> DataFrame:
    """ROC area (trapezoid) and average precision (step sum) per class with positives."""
    below = F.col("tp") - F.col("positives") / 2.0
    area = F.sum(F.col("negatives") * below)
    ap = F.sum(F.col("positives") * F.col("precision"))
    return (
        points.groupBy("label", "all_positives", "all_negatives")
        .agg(area.alias("_area"), ap.alias("_ap"))
        .select(
            "label",
            F.try_divide(F.col("_area"), F.col("all_positives") * F.col("all_negatives")).alias("auc"),
            (F.col("_ap") / F.col("all_positives")).alias("average_precision"),
            F.col("all_positives").alias("positives"),
        )
        .orderBy("label")
    )


def macro_auc(per_class: DataFrame, classes: int) -> DataFrame:
    """Mean one-against-rest area; null when a class has no positives or no negatives."""
    known = F.count("auc") == classes
    return per_class.agg(F.when(known, F.avg("auc")).alias("roc_auc_ovr"))


# --- ranking reports --------------------------------------------------------------------------
def _score_order(score: str, ties: list[str]) -> list[Term]:
    return [Term(score, ascending=False), *[Term(c) for c in ties]]


def with_deciles(df: DataFrame, score: str, ties: list[str], name: str = "decile", parts: int = 10) -> DataFrame:
    """Equal-width bands of the unique descending rank; 1 holds the highest scores.

    The last row of each band is found by rank selection and every row is compared with
    those keys, so no row is moved. Rows equal in score and `ties` share a band.
    """
    order, total = _score_order(score, ties), df.count()
    # (rank - 1) * parts / (rows - 1) <= band up to this rank
    last = {band * (total - 1) // parts + 1 for band in range(1, parts)} if total else set()
    keys = keys_at_score_ranks(df, score, ties, sorted(last), total)
    dtypes = [df.schema[term.column].dataType for term in order]
    band = F.lit(1)
    for number in range(1, parts):
        key = keys.get(number * (total - 1) // parts + 1) if total > 1 else None
        if key is not None:
            band = band + (~precedes(order, key, dtypes, or_equal=True)).cast("int")
    return df.withColumn(name, band.cast("int"))


def gains_curve(
    df: DataFrame, score: str, hit: str, ties: list[str], settings: Settings = DEFAULTS
) -> DataFrame:
    """Positives captured in the top shares of a ranking, with precision and lift.

    The last row of each share is found by rank selection; one aggregate counts the
    positives up to it.
    """
    shares = settings.gains_shares
    order = _score_order(score, ties)
    rows = df.select(F.col(score), F.col(hit).cast("long").alias("_hit"), *ties)
    dtypes = [rows.schema[term.column].dataType for term in order]
    total = rows.count()
    cuts = [max(round(total * share), 1) for share in shares]
    keys = keys_at_score_ranks(rows, score, ties, sorted(set(cuts)), total)
    counts = [
        F.sum(F.when(precedes(order, keys[cut], dtypes, or_equal=True), F.col("_hit"))) if cut in keys else F.lit(None).cast("long")
        for cut in cuts
    ]
    wide = rows.agg(
        F.coalesce(F.sum("_hit"), F.lit(0)).alias("hits"),
        *[F.coalesce(count, F.lit(0) if cut in keys else count).alias(f"c{i}") for i, (cut, count) in enumerate(zip(cuts, counts, strict=True))],
    )
    records = []
    for i, share in enumerate(shares):
        caught, reviewed = F.col(f"c{i}"), F.lit(cuts[i] if cuts[i] in keys else None).cast("long")
        rate = F.when(F.col("hits") > 0, 100.0 * caught / F.col("hits")).otherwise(0.0)
        records.append(
            {
                "targeted_pct": F.lit(round(100.0 * share, 1)),
                "shipments_reviewed": reviewed,
                "late_captured": caught,
                "capture_rate_pct": rounded(rate, 2),
                "precision_pct": rounded(F.try_divide(100.0 * caught, reviewed), 2),
                "lift": rounded(rate / F.lit(100.0 * share), 2),
            }
        )
    return inline_rows(wide, records)


# --- confidence ------------------------------------------------------------------------------
def confidence_routing(
    df: DataFrame, confidence: str, correct: Column, settings: Settings = DEFAULTS
) -> DataFrame:
    """Share accepted without review and accuracy on it, per confidence threshold."""
    thresholds = settings.routing_thresholds
    above = [F.col(confidence) >= t for t in thresholds]
    wide = df.agg(
        F.count("*").alias("rows"),
        *[tally(test).alias(f"n{i}") for i, test in enumerate(above)],
        *[tally(test & correct).alias(f"k{i}") for i, test in enumerate(above)],
    )
    table = inline_rows(
        wide,
        [
            {
                "threshold": F.lit(t),
                "accepted": F.col(f"n{i}"),
                "accepted_pct": percent(F.col(f"n{i}"), F.col("rows"), 1),
                "accuracy_pct": percent(F.col(f"k{i}"), F.col(f"n{i}"), 1),
            }
            for i, t in enumerate(thresholds)
        ],
    )
    return table.filter("accepted > 0")


def confidence_by_outcome(df: DataFrame, confidence: str, correct: Column) -> DataFrame:
    """Count, mean, least and largest confidence of right and wrong predictions."""
    return (
        df.groupBy(correct.alias("correct"))
        .agg(
            F.count("*").alias("n"),
            rounded(F.avg(confidence), 3).alias("mean"),
            rounded(F.min(confidence), 3).alias("least"),
            rounded(F.max(confidence), 3).alias("most"),
        )
        .orderBy("correct")
    )


def error_listing(
    df: DataFrame, value: str, threshold: float, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """Every wrong prediction with its distance to a decision boundary."""
    wrong = df.filter(F.col(actual) != F.col(predicted))
    return wrong.withColumn("distance", rounded(F.col(value) - threshold, 2))
