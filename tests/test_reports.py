"""Invariants of scorecards, funnels, products and the audit, and edge inputs."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from dockline.config import DEFAULTS
from dockline.operators import filters, funnels, products, quality, service
from dockline.sources import files


def test_funnels_nest_and_reconcile(ship):
    stages = funnels.value_funnel(ship).orderBy("stage_order").toPandas()
    assert list(stages.value_usd) == sorted(stages.value_usd, reverse=True)
    summary = funnels.value_funnel_summary(ship).first()
    assert stages.value_usd[0] - stages.value_usd[2] == pytest.approx(summary["late_value_usd"], abs=1)
    late = funnels.lateness_funnel(ship).toPandas()
    assert late.share_pct.is_monotonic_increasing and late.share_pct.iloc[-1] == 100.0


def test_delay_buckets_partition_known_delays(ship):
    table = service.delay_distribution(ship).toPandas()
    assert table.shipments.sum() == ship.filter("delivery_delay_days is not null").count()
    assert len(table) == 7


def test_scorecard_ranks_worst_first(ship):
    card = service.vendor_scorecard(ship, min_shipments=5).toPandas()
    assert list(card["rank"]) == list(range(1, len(card) + 1))
    assert card.on_time_pct.is_monotonic_increasing


def test_shares_accumulate(ship):
    table, summary = products.value_concentration(ship)
    frame = table.toPandas()
    assert frame.value_share_pct.sum() == pytest.approx(100, abs=0.5)
    assert frame.cumulative_share_pct.is_monotonic_increasing
    assert frame["product"].is_unique
    assert summary.first()["products_total"] == len(frame)


def test_price_reports_on_a_missing_product_are_empty(ship):
    trend = products.price_trend(ship, "no such", "1mg")
    assert trend.count() == 0
    assert products.price_decline(trend).first()["decline_pct"] is None


def test_pricing_verdict_reads(ship):
    small = replace(DEFAULTS, min_shipments_for_spread=2, min_sites_for_spread=1)
    row = products.pricing_summary(ship, "hot ring", "600mg", small).first()
    assert "quote that" in row["verdict"] and row["inflation_factor"] > 0


EDGES = ("empty", "all_null_delay", "one_group", "null_group", "zero_value")


def _edge(ship, kind):
    if kind == "empty":
        return ship.limit(0)
    if kind == "all_null_delay":
        return ship.withColumns(
            {"delivery_delay_days": F.lit(None).cast("int"), "is_late": F.lit(None).cast("int")}
        )
    if kind == "one_group":
        return ship.withColumns({"vendor": F.lit("only"), "region": F.lit("only")})
    if kind == "null_group":
        return ship.withColumn("vendor", F.lit(None).cast("string"))
    return ship.withColumns({"line_value_usd": F.lit(0.0), "freight_pct_of_value": F.lit(float("nan"))})


@pytest.mark.parametrize("kind", EDGES)
def test_operators_survive_edge_frames(ship, kind):
    df = _edge(ship, kind)
    rows = df.count()
    card = service.vendor_scorecard(df, min_shipments=0).toPandas()
    assert card.shipments.sum() == rows
    assert service.lead_time_breakdown(df).count() == 5
    assert service.delay_distribution(df).count() == 7
    assert service.shipment_kpis(df).count() == 1
    assert funnels.value_funnel(df).count() == 4
    assert funnels.funnel_kpis(df).count() == 1
    assert products.catalogue_kpis(df).first()["line_items"] == rows
    score = quality.data_quality_score(df.select("shipment_id", "vendor", "delivery_delay_days", "freight_pct_of_value")).first()
    assert score["rows"] == rows and 0 <= score["overall_score"] <= 100


# --- audit --------------------------------------------------------------------------
def test_default_rules_by_name_prefix_and_suffix(spark):
    df = spark.createDataFrame(
        [(1, "x", 1.0, "a", 2)], "is_late int, units_text string, fee_usd double, share_pct string, units_n int"
    )
    rules = quality.default_rules(df)
    assert set(rules) == {"is_late", "fee_usd", "units_n"}
    assert rules["is_late"].text() == "value in {0, 1}"
    assert quality.Rule(low=0, high=100).text() == "0 <= value <= 100"


def test_text_under_a_range_rule_is_a_violation(spark):
    df = spark.createDataFrame([("5",), ("abc",), (None,), ("-1",), ("1e3",)], "v string")
    report = quality.validity_report(df, {"v": quality.Rule(low=0)}).first()
    assert (report["checked"], report["violations"]) == (4, 2)
    assert report["sample_bad_values"] == "-1, abc"


def test_reports_with_nothing_to_check_keep_their_schema(spark):
    df = spark.createDataFrame([("a",), ("b",)], "name string")
    assert quality.validity_report(df).columns[0] == "column"
    assert quality.validity_report(df).count() == 0
    assert quality.outlier_report(df).count() == 0
    assert quality.consistency_report(df).count() == 0
    score = quality.data_quality_score(df).first()
    assert score["overall_score"] == 100.0 and score["grade"] == "A"


def test_unknown_outlier_method_raises(ship):
    with pytest.raises(ValueError):
        quality.outlier_report(ship, method="mad")


def test_duplicates_count_copies_and_show_both_sides(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, "b"), (2, "c")], "id int, t string")
    found = quality.duplicate_report(df, ["id"])
    row = found.summary.first()
    assert (row["exact_duplicate_rows"], row["key_duplicate_rows"]) == (2, 3)
    assert row["duplicate_pct"] == 40.0
    assert found.examples.first()["copies"] == 3
    assert found.key_examples.count() == 5


def test_duplicates_see_null_and_signed_zero_alike(spark):
    df = spark.createDataFrame([(0.0, None), (-0.0, None), (1.0, "x")], "v double, t string")
    assert quality.duplicate_report(df).summary.first()["exact_duplicate_rows"] == 1


def test_binary_columns_are_no_outliers(spark):
    df = spark.range(200).select(
        (F.col("id") == 0).cast("int").alias("flag"),
        F.when(F.col("id") == 0, 9999).otherwise(F.col("id") % 50).alias("value"),
    )
    report = quality.outlier_report(df).toPandas()
    assert list(report.column) == ["value"] and report.outlier_count[0] == 1


def test_containers_can_be_audited(spark):
    df = spark.createDataFrame(
        [(1, ["a", "b"], 1.0), (1, ["a", "b"], 1.0), (3, ["c"], 3.0)], "id long, tags array<string>, value double"
    )
    audit = quality.assess_dataset(quality.Dataset(df))
    assert audit.duplicates.summary.first()["exact_duplicate_rows"] == 1
    assert audit.summary.filter("column = 'tags'").first()["top"] == "a, b"
    assert audit.missing.count() == 3 and audit.score.count() == 1


def test_parsing_does_not_flatter_the_score(spark, ship):
    worse = ship.withColumn("date_po_sent", F.lit(None).cast("date"))
    columns = ["shipment_id", "date_po_sent", "date_delivered"]
    board = quality.assess_all(
        {"a": quality.Dataset(ship.select(columns)), "b": quality.Dataset(worse.select(columns))}
    ).toPandas()
    assert list(board.dataset) == ["b", "a"]


def test_empty_selection_keeps_all_rows(ship):
    assert filters.filter_levels(ship, {"vendor": [], "absent": ["x"]}).count() == ship.count()


def test_sums_keep_all_digits(spark):
    from dockline.functions.columns import money_sum

    df = spark.createDataFrame([(1, 0.004), (1, 0.004), (1, 0.004), (2, 1e17), (2, 5.0), (3, None), (4, 0.1), (4, 0.2)], "k int, v double")
    got = {r.k: r.s for r in df.groupBy("k").agg(money_sum("v").alias("s")).collect()}
    assert got == {1: 0.012, 2: 1e17, 3: 0.0, 4: 0.3}


def test_medicine_columns_have_named_rules(spark):
    from dockline.operators.quality import default_rules

    df = spark.createDataFrame([(1.0, 1.0, 1, 1)], "price_inr double, `price(₹)` double, ingredient_count int, pack_quantity int")
    rules = default_rules(df)
    assert {n: (r.low, r.high) for n, r in rules.items()} == {
        "price_inr": (0, 500_000), "price(₹)": (0, 500_000), "ingredient_count": (0, 10), "pack_quantity": (0, None)}


def test_reports_are_committed_together(spark, tmp_path):
    path = str(tmp_path / "export")
    one = spark.createDataFrame([("a", 1, None)], "k string, n long, t string")
    two = spark.createDataFrame([(2.5,)], "v double")
    with pytest.raises(LookupError):
        files.read_reports(spark, path)
    assert files.commit_reports({"one": one, "two": two, "none": one.limit(0)}, path) == 1

    torn = one.select(F.raise_error(F.lit("lost")).alias("k"))
    with pytest.raises(Exception, match="lost"):
        files.commit_reports({"one": one.limit(0), "two": torn}, path)
    found = files.read_reports(spark, path)  # the torn version is not seen
    assert {name: report.collect() for name, report in found.items()} == {"one": one.collect(), "two": two.collect(), "none": []}
    assert found["none"].schema == one.schema

    assert files.commit_reports({"two": two.union(two)}, path, "csv") == 2
    assert files.read_reports(spark, path)["two"].count() == 2 and files.read_reports(spark, path, 1)["one"].count() == 1
    with pytest.raises(LookupError, match="version 7"):
        files.read_reports(spark, path, 7)
