"""Parsing, interpretation and sources."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from dockline.functions.parsing import (
    DAY_FIRST,
    MONTH_FIRST,
    date_reason,
    number_reason,
    parsed_date,
    parsed_number,
)
from dockline.functions.columns import rounded
from dockline.operators import ingest
from dockline.sources import files, tables
from tests.conftest import SMALL

DATES = [
    (MONTH_FIRST, "5/3/13", date(2013, 5, 3), "parsed"),
    (MONTH_FIRST, "05/03/13", date(2013, 5, 3), "parsed"),
    (MONTH_FIRST, "13/3/13", None, "unparseable"),
    (MONTH_FIRST, " Pre-PQ Process ", None, "structural"),
    (MONTH_FIRST, "Date Not Captured", None, "missing"),
    (MONTH_FIRST, "N/A - From RDC", None, "structural"),
    (MONTH_FIRST, None, None, "missing"),
    (MONTH_FIRST, "1/1/70", date(1970, 1, 1), "parsed"),
    (MONTH_FIRST, "2/29/96", date(1996, 2, 29), "parsed"),
    (DAY_FIRST, "2-Jun-06", date(2006, 6, 2), "parsed"),
    (DAY_FIRST, "2-jun-06", date(2006, 6, 2), "parsed"),
    (DAY_FIRST, "2-Jun-2006", None, "unparseable"),
]
NUMBERS = [
    ("1,234.50", 1234.5, "parsed"),
    ("$1,234.50", 1234.5, "parsed"),
    ("1e3", 1000.0, "parsed"),
    ("Invoiced Separately", None, "structural"),
    ("See DN-304 (ID#:10589)", None, "cross_reference"),
    ("see x", None, "cross_reference"),
    ("5d", None, "missing"),
    ("nan", None, "missing"),
    ("Infinity", None, "missing"),
    ("abc", None, "missing"),
    ("", None, "missing"),
    (None, None, "missing"),
]


@pytest.mark.parametrize("pattern", [MONTH_FIRST, DAY_FIRST])
def test_dates_parse_with_a_reason(spark, pattern):
    cases = [c for c in DATES if c[0] == pattern]
    df = spark.createDataFrame([(i, c[1]) for i, c in enumerate(cases)], "i int, t string")
    day = parsed_date(F.col("t"), pattern)
    rows = df.select("i", day.alias("d"), date_reason(F.col("t"), day).alias("r")).orderBy("i").collect()
    assert [(r["d"], r["r"]) for r in rows] == [(c[2], c[3]) for c in cases]


def test_numbers_parse_with_a_reason(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(NUMBERS)], "i int, t string")
    value = parsed_number(F.col("t"))
    rows = df.select("i", value.alias("v"), number_reason(F.col("t"), value).alias("r")).orderBy("i").collect()
    assert [(r["v"], r["r"]) for r in rows] == [(c[1], c[2]) for c in NUMBERS]


def test_rounding_is_half_even_on_the_scaled_value(spark):
    values = [0.125, 1.005, 1.015, 2.345, 5.015]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(rounded(F.col("v"), 2)).collect()] == [0.12, 1.0, 1.01, 2.35, 5.01]


def test_interpreting_the_text_gives_the_directly_built_table(spark, ship):
    text = tables.stored_published(spark, SMALL)
    read = ingest.interpret(text, tables.region_dimension(spark, SMALL))
    columns = sorted(ship.columns)
    assert columns == sorted(read.columns) and len(columns) == 56
    assert read.select(columns).exceptAll(ship.select(columns)).count() == 0
    assert read.count() == ship.count()


def test_reasons_partition_the_rows(ship):
    report = ingest.parsing_report(ship).toPandas()
    totals = report[["parsed", "structural", "missing", "cross_reference", "unparseable"]].sum(axis=1)
    assert set(totals) == {ship.count()}
    assert list(report.parsed_pct) == sorted(report.parsed_pct)


def test_built_in_region_and_product_names(spark):
    df = spark.createDataFrame([("Kenya", "ARV"), ("Nowhere", "XYZ"), ("Congo, DRC", None)], "c string, p string")
    rows = df.select(ingest.region_of(F.col("c")), ingest.group_name_of(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [
        ("East Africa", "Antiretroviral (ARV)"),
        ("Other", "XYZ"),
        ("West & Central Africa", None),
    ]


def test_era_puts_an_unknown_year_in_the_later_era(spark):
    df = spark.createDataFrame([(2010,), (2011,), (None,)], "delivery_year int")
    assert [r["era"] for r in ingest.with_era(df, 2010).collect()] == ["early", "late", "late"]


def test_containers_become_text(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["c"]), (4, None)], "id int, tags array<string>")
    flat = ingest.with_flat_containers(df).orderBy("id").collect()
    assert [r["tags"] for r in flat] == ["a, b", "a, b", "c", None]


def test_csv_reader_skips_a_byte_order_mark_and_infers_nothing(spark, tmp_path):
    path = tmp_path / "drug.csv"
    path.write_bytes(
        "﻿Age,Sex,BP,Cholesterol,Na_to_K,Drug\n23,F,HIGH,HIGH,25.355,DrugY\n47,M,LOW,HIGH,13.093,drugC\n".encode()
    )
    df = files.load_patients(spark, str(path))
    assert df.columns == list(files.PATIENT_COLUMNS)
    assert [tuple(r) for r in df.orderBy("Age").collect()][0] == (23, "F", "HIGH", "HIGH", 25.355, "DrugY")
    with pytest.raises(KeyError):
        files.load_table(spark, "unknown", str(path))
    gate = files.row_count_gate(files.load_all(spark, {"drug200": str(path)}), files.EXPECTED_ROWS)
    assert {r["dataset"]: r["status"] for r in gate.collect()} == {
        "drug200": "ROW COUNT MISMATCH",
        "scms": "MISSING",
    }


def test_ingestion_is_row_local_and_reads_a_stream(spark, tmp_path):
    stream = spark.readStream.schema(files.SHIPMENT_TEXT_SCHEMA).csv(str(tmp_path))
    assert ingest.interpret(stream).isStreaming


def test_interpreted_table_round_trips_through_year_directories(spark, ship, tmp_path):
    files.write_interpreted(ship, str(tmp_path / "silver"))
    back = spark.read.parquet(str(tmp_path / "silver"))
    assert back.count() == ship.count() and set(back.columns) == set(ship.columns)


def _written(spark, tmp_path, names, mark=""):
    rows = {name: f"v{i}" for i, name in enumerate(ingest.PUBLISHED_COLUMNS)}
    rows |= {"ID": "7", "Vendor": 'A "quoted"\nname', "Delivered to Client Date": "2-Jun-06", "Scheduled Delivery Date": "1-Jun-06"}
    quote = lambda text: '"' + text.replace('"', '""') + '"'
    path = tmp_path / f"{len(names)}{bool(mark)}{names[0][:2]}.csv"
    lines = [",".join(quote(n) for n in names), ",".join(quote(rows.get(n, "x")) for n in names)]
    path.write_text(mark + "\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_csv_is_bound_by_header_name(spark, tmp_path):
    plain = files.load_shipments(spark, _written(spark, tmp_path, ingest.PUBLISHED_COLUMNS)).first().asDict()
    other = [*sorted(ingest.PUBLISHED_COLUMNS, reverse=True), "extra"]
    shuffled = files.load_shipments(spark, _written(spark, tmp_path, other, mark="﻿")).first().asDict()
    assert plain == shuffled
    assert plain["vendor"] == 'A "quoted"\nname' and plain["is_late"] == 1 and plain["shipment_id"] == 7


def test_csv_without_a_header_raises_with_its_name(spark, tmp_path):
    path = _written(spark, tmp_path, [n for n in ingest.PUBLISHED_COLUMNS if n != "Vendor"])
    with pytest.raises(ValueError, match="Vendor"):
        files.load_shipments(spark, path)
