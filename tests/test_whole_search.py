"""The tuned search of late delivery fits on every training row."""

import pytest
from pyspark.sql import functions as F

from checks import models
from dockline.operators import training


class _Seen(Exception):
    pass


def test_the_search_fits_on_all_training_rows(spark, monkeypatch):
    rows = 30_000
    numbers = {c: F.pmod(F.xxhash64("shipment_id", F.lit(c)), F.lit(50)).cast("double") for c in training.LATE_NUMERIC}
    levels = {c: F.concat(F.lit("v"), F.pmod("shipment_id", F.lit(3)).cast("string")) for c in training.LATE_CATEGORICAL}
    ship = spark.range(rows).withColumnRenamed("id", "shipment_id").withColumns(
        {"po_number": F.col("shipment_id").cast("string"), "is_late": F.pmod("shipment_id", F.lit(4)).cast("int") % 2, **numbers, **levels})

    def fit(ready, *_):
        raise _Seen(ready.count())

    monkeypatch.setattr(models.t, "stored_shipments", lambda *_: ship)
    monkeypatch.setattr(training, "_tuned_tree", fit)
    with pytest.raises(_Seen) as seen:
        models.QUERIES["late_model_search"](spark, "")
    assert seen.value.args == (rows * 3 // 4,)
