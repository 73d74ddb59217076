"""Readers and writers for the published files and for result tables."""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockline.operators.ingest import PUBLISHED_COLUMNS, interpret
from dockline.sources.split_csv import read_records

PATIENT_COLUMNS = ("Age", "Sex", "BP", "Cholesterol", "Na_to_K", "Drug")
PATIENT_SCHEMA = T.StructType(
    [
        T.StructField("Age", T.IntegerType()),
        T.StructField("Sex", T.StringType()),
        T.StructField("BP", T.StringType()),
        T.StructField("Cholesterol", T.StringType()),
        T.StructField("Na_to_K", T.DoubleType()),
        T.StructField("Drug", T.StringType()),
    ]
)
SHIPMENT_TEXT_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in PUBLISHED_COLUMNS]
)
# Rows each published dataset must have.
EXPECTED_ROWS = {"drug200": 200, "scms": 10324}
SCHEMAS = {"drug200": PATIENT_SCHEMA, "scms": SHIPMENT_TEXT_SCHEMA}


def _bytes(setting: str) -> int:
    """A size setting such as `128m` or `134217728b` in bytes."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", setting.strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


# cutting records takes some 25 times the CPU of a plain read, so short files are read plainly
SPLIT_FROM = 8


def _is_large(spark: SparkSession, path: str) -> bool:
    """Whether a file at `path` is longer than `SPLIT_FROM` times a task's share of input."""
    longest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
    return longest > SPLIT_FROM * _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))


def _read_csv(spark: SparkSession, path: str, schema: T.StructType, split: bool | None = None) -> DataFrame:
    """CSV bound by header name, with the types of `schema`.

    Columns may stand in any order and others may be there; a byte-order mark before
    the first header is dropped; an absent header raises ``ValueError`` naming it.
    Everything is read as text and cast, a value that does not fit becoming null.
    Quoted line breaks are kept. A file of more than `SPLIT_FROM` times a task's share of
    input is read by many tasks (`split_csv`), a shorter one by one; `split` forces either.
    """
    options = {"quote": '"', "escape": '"', "multiLine": "true", "encoding": "UTF-8"}
    text = spark.read.options(header=True, inferSchema=False, **options).csv(path)
    held = {name.lstrip("\ufeff").strip(): name for name in text.columns}
    absent = [field.name for field in schema if field.name not in held]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(map(repr, absent))}")
    if _is_large(spark, path) if split is None else split:
        text = read_records(spark, path, text.columns, options)
    return text.select(
        *[F.col(f"`{held[f.name]}`").try_cast(f.dataType).alias(f.name) for f in schema]
    )


def load_table(spark: SparkSession, name: str, path: str, split: bool | None = None) -> DataFrame:
    """A dataset exactly as published; an unknown name raises ``KeyError``.

    `split` says whether one file is read by many tasks; left out, its size decides.
    """
    if name not in SCHEMAS:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(SCHEMAS)}")
    return _read_csv(spark, path, SCHEMAS[name], split)


def load_shipments_published(spark: SparkSession, path: str) -> DataFrame:
    return load_table(spark, "scms", path)


def load_shipments(
    spark: SparkSession, path: str, regions: DataFrame | None = None
) -> DataFrame:
    return interpret(load_shipments_published(spark, path), regions)


def load_patients(spark: SparkSession, path: str) -> DataFrame:
    return load_table(spark, "drug200", path)


def load_all(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Every named dataset, lazily."""
    return {name: load_table(spark, name, path) for name, path in paths.items()}


def row_count_gate(datasets: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """Rows against expected rows per dataset, with a status.

    A dataset that is expected but not given counts as ``MISSING``.
    """
    spark = next(iter(datasets.values())).sparkSession
    parts = []
    for name, rows in expected.items():
        if name in datasets:
            part = datasets[name].agg(F.count("*").alias("rows"))
        else:
            part = spark.range(1).select(F.lit(None).cast("long").alias("rows"))
        parts.append(
            part.select(F.lit(name).alias("dataset"), "rows", F.lit(rows).cast("long").alias("expected"))
        )
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report.withColumn(
        "status",
        F.when(F.col("rows").isNull(), "MISSING")
        .when(F.col("rows") == F.col("expected"), "ok")
        .otherwise("ROW COUNT MISMATCH"),
    )


def write_csv(report: DataFrame, path: str) -> None:
    """Export a result table as CSV part files with headers."""
    report.write.mode("overwrite").option("header", True).csv(path)


def write_reports(reports: dict[str, DataFrame], path: str, kind: str = "parquet") -> list[str]:
    """One directory per named report under ``path``; returns the directories."""
    written = []
    for name, report in reports.items():
        target = f"{path}/{name}"
        writer = report.write.mode("overwrite")
        if kind == "csv":
            writer.option("header", True).csv(target)
        else:
            writer.format(kind).save(target)
        written.append(target)
    return written


def _manifests(spark: SparkSession, path: str) -> DataFrame | None:
    """(version, name, kind, columns) of every committed set of reports, null before the first."""
    try:
        return spark.read.schema("version long, name string, kind string, columns string").json(f"{path}/manifest/*")
    except AnalysisException:
        return None


def commit_reports(reports: dict[str, DataFrame], path: str, kind: str = "parquet") -> int:
    """Store a set of named reports as one new version; returns its number.

    The reports are written first, each to a folder of its own; a manifest that lists
    them is written last, by one task, so it appears whole or not at all. A reader
    sees all reports of a version or those of the version before. What a torn
    write has left is overwritten by the next.
    """
    spark = next(iter(reports.values())).sparkSession
    known = _manifests(spark, path)
    version = 1 + ((known.agg(F.max("version")).first()[0] or 0) if known is not None else 0)
    for name, report in reports.items():
        report.write.mode("overwrite").option("header", True).format(kind).save(f"{path}/reports/{version}/{name}")
    listed = [(version, name, kind, report.schema.json()) for name, report in reports.items()]
    manifest = spark.createDataFrame(listed, "version long, name string, kind string, columns string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{version}")
    return version


def read_reports(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The reports of a committed version, the latest unless one is named; raises ``LookupError`` if there is none."""
    known = _manifests(spark, path)
    rows = known.collect() if known is not None else []  # a few rows a version
    wanted = max((r["version"] for r in rows), default=None) if version is None else version
    found = {r["name"]: r for r in rows if r["version"] == wanted}
    if not found:
        raise LookupError(f"{path} holds no committed reports{'' if version is None else f' of version {version}'}")
    return {
        name: spark.read.schema(T.StructType.fromJson(json.loads(r["columns"]))).option("header", True)
        .format(r["kind"]).load(f"{path}/reports/{wanted}/{name}")
        for name, r in found.items()
    }


def write_interpreted(shipments: DataFrame, path: str, max_rows: int = 5_000_000) -> None:
    """Store the interpreted table once, laid out by delivery year.

    Operators that filter or group by year then prune directories, and those
    that read the table more than once do not parse text again. The rebalance
    hint sizes the writers from the data and splits a large year over several; no
    file exceeds `max_rows` rows.
    """
    (
        shipments.hint("rebalance", F.col("delivery_year"))
        .write.mode("overwrite")
        .option("maxRecordsPerFile", max_rows)
        .partitionBy("delivery_year")
        .parquet(path)
    )
