"""Shipment, patient-like and scored views over the generated order tables.

The order tables carry no milestones and no dirty text, so both are derived by
integer arithmetic on the keys. ``published_shipments`` renders the 33 text
columns a shipment file has; ``shipments`` builds the interpreted columns
directly. A test holds ``interpret(published_shipments)`` equal to ``shipments``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockline.operators.ingest import (
    COLUMN_NAMES,
    PUBLISHED_COLUMNS,
    derived_columns,
    group_name_of,
)
from dockline.plans.ranking import passing_shuffles, small_or_stored, use_checkpoint_dir
from dockline.sources.files import load_shipments_published

ERA_CUTOFF = 1998
# rows in a file of the text view: a compressed file is read by one task
PUBLISHED_ROWS = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def region_dimension(spark: SparkSession, folder: str) -> DataFrame:
    """Country to region; one country is left out so that ``Other`` occurs."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return joined.filter(F.col("n_name") != "NATION_24").select(
        F.col("n_name").alias("country"), F.col("r_name").alias("region")
    )


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with order, customer country, part and supplier attributes.

    Orders are joined with their customers before the lines, so the lines are moved once for
    both, and as numbers only. They are shuffled for that whatever the sizes: what is moved then
    grows with the input, and lines in a file that cannot be split still spread over the tasks.
    The other joins carry no hints: sizes decide, and adaptive execution splits skewed partitions.
    """
    line = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
    )
    order = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    bought = (
        order.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "o_orderpriority", "c_nationkey", "c_mktsegment", "n_name")
    )
    joined = (
        line.join(bought.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .drop("o_orderkey", "p_partkey", "s_suppkey")
    )
    mark = (
        F.col("l_orderkey") * 7 + F.col("l_partkey") * 3 + F.col("l_suppkey") * 5 + F.col("l_linenumber")
    ) % 100
    return joined.withColumns({"h": mark, "shipped": F.to_date("l_shipdate")})


def _milestones() -> dict[str, Column]:
    h, shipped = F.col("h"), F.col("shipped")
    from_rdc = F.col("l_suppkey") % 2 == 0
    late_cut = F.when(from_rdc & (F.year(shipped) > ERA_CUTOFF), 70).otherwise(88)
    delay = (
        F.when(h < 61, 0).when(h < late_cut, -1 - (h % 40)).otherwise(1 + (h % 12) * 3)
    ).cast("int")
    planned = F.date_sub(shipped, delay)
    quoted = F.date_sub(planned, (F.lit(30) + F.col("l_partkey") % 200).cast("int"))
    recorded = F.when(h == 13, F.date_sub(shipped, 1)).otherwise(
        F.date_add(shipped, (F.col("l_linenumber") % 4).cast("int"))
    )
    return {
        "planned": planned,
        "quoted": quoted,
        "ordered": F.date_add(quoted, 14),
        "recorded": recorded,
        "from_rdc": from_rdc,
    }


# One predicate per kind of absence, shared by both views.
def _delivery_lost() -> Column:
    return (F.col("h") == 37) & (F.col("l_linenumber") % 3 == 0)


def _schedule_garbled() -> Column:
    return (F.col("h") == 59) & (F.col("l_linenumber") == 5)


def _record_lost() -> Column:
    return (F.col("h") == 11) & (F.col("l_linenumber") == 2)


def _common() -> dict[str, Column]:
    """Attributes that are text or plain numbers in both views."""
    h = F.col("h")
    group = (
        F.when(F.col("p_type") == "SMALL", "ARV")
        .when(F.col("p_type") == "LARGE", "HRDT")
        .when(F.col("p_type") == "MEDIUM", "ACT")
        .when(F.col("p_type") == "STANDARD", "MRDT")
        .when(F.col("p_type") == "ECONOMY", "ANTM")
        .otherwise(F.col("p_type"))
    )
    brand_number = F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int")
    brand = (
        F.when(brand_number <= 12, "Generic").when(brand_number == 25, F.lit(None)).otherwise(F.col("p_brand"))
    )
    dosage = (
        F.when(F.col("p_type") == "SMALL", "100mg")
        .when(F.col("p_type").isin("MEDIUM", "LARGE"), "200mg")
        .when(F.col("p_type") == "STANDARD", "600mg")
        .when(F.col("p_type") == "ECONOMY", "10mg/ml")
    )
    mode = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Air")
        .when(F.col("o_orderpriority") == "2-HIGH", "Air Charter")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Truck")
        .when(F.col("o_orderpriority") == "5-LOW", "Ocean")
    )
    terms = (
        F.when(F.col("from_rdc"), "N/A - From RDC")
        .when(F.col("l_suppkey") % 3 == 0, "EXW")
        .when(F.col("l_suppkey") % 3 == 1, "DDP")
        .otherwise("FCA")
    )
    pack_price = F.col("l_extendedprice") / F.col("l_quantity")
    return {
        "shipment_id": F.col("l_orderkey") * 8 + F.col("l_linenumber"),
        "project_code": F.concat(F.lit("P"), F.col("c_nationkey").cast("string")),
        "pq_number": F.concat(F.lit("PQ-"), F.col("l_orderkey").cast("string")),
        "po_number": F.concat_ws("-", F.lit("SO"), F.col("l_partkey"), F.col("l_suppkey")),
        "asn_number": F.concat(F.lit("DN-"), F.col("l_orderkey").cast("string")),
        "country": F.col("n_name"),
        "managed_by": F.col("c_mktsegment"),
        "fulfil_via": F.when(F.col("from_rdc"), "From RDC").otherwise("Direct Drop"),
        "inco_term": terms,
        "shipment_mode": mode,
        "product_group": group,
        "sub_classification": F.col("p_type"),
        "vendor": F.col("s_name"),
        "item_description": F.concat_ws(" ", "p_name", "p_type"),
        "molecule": F.col("p_name"),
        "brand": brand,
        "dosage": dosage,
        "dosage_form": F.col("p_type"),
        "units_per_pack": F.col("p_size").cast("long"),
        "quantity": F.col("l_quantity").cast("long"),
        "line_value_usd": F.when((h == 7) & (F.col("l_linenumber") == 1), 0.0).otherwise(
            F.col("l_extendedprice")
        ),
        "pack_price_usd": F.when(h == 5, pack_price + 1.0).otherwise(pack_price),
        "unit_price_usd": F.when(h == 3, 0.0).otherwise(pack_price),
        "manufacturing_site": F.col("p_brand"),
        "first_line_designation": F.when((h >= 16) & (h < 40), "No").otherwise("Yes"),
        "insurance_usd": F.floor(F.col("l_extendedprice") * F.col("l_discount")).cast("double") / 100.0,
    }


def _freight_cents() -> Column:
    return F.floor(F.col("l_extendedprice") * F.col("l_tax") * 100.0)


def _weight() -> Column:
    return F.when(F.col("h") == 77, 0).otherwise((F.col("l_quantity") * F.col("p_size")).cast("long"))


def published_shipments(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    """The shipment table as text, the way a published file would hold it.

    ``lines`` are the order lines, if the caller has them stored.
    """
    lines = order_lines(spark, folder) if lines is None else lines
    lines = lines.withColumns(_milestones())
    h = F.col("h")

    def slashed(day: str) -> Column:
        return F.date_format(day, "M/d/yy")

    def dashed(day: str) -> Column:
        return F.date_format(day, "d-MMM-yy")

    cents = _freight_cents()
    dollars, remainder = F.floor(cents / 100).cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    amount = F.when(
        (h % 5 == 0) & (cents >= 100000),
        F.concat(
            F.lit("$"),
            F.floor(cents / 100000).cast("string"),
            F.lit(","),
            F.lpad((F.floor(cents / 100) % 1000).cast("string"), 3, "0"),
            F.lit("."),
            remainder,
        ),
    ).otherwise(F.concat(dollars, F.lit("."), remainder))
    pointer = F.concat(
        F.lit("See DN-"), F.col("l_orderkey").cast("string"),
        F.lit(" (ID#:"), F.col("l_partkey").cast("string"), F.lit(")"),
    )
    texts = {
        "PQ First Sent to Client Date": F.when(h < 24, " Pre-PQ Process ")
        .when(h < 26, "Date Not Captured")
        .otherwise(slashed("quoted")),
        "PO Sent to Vendor Date": F.when(F.col("from_rdc"), "N/A - From RDC")
        .when(h.isin(50, 51), "Date Not Captured")
        .otherwise(slashed("ordered")),
        "Scheduled Delivery Date": F.when(_schedule_garbled(), "31-Foo-99").otherwise(dashed("planned")),
        "Delivered to Client Date": F.when(_delivery_lost(), "Date Not Captured").otherwise(
            dashed("shipped")
        ),
        "Delivery Recorded Date": F.when(~_record_lost(), dashed("recorded")),
        "Freight Cost (USD)": F.when(h < 14, "Freight Included in Commodity Cost")
        .when(h < 16, "Invoiced Separately")
        .when(h < 40, pointer)
        .when(h > 40, amount),
        "Weight (Kilograms)": F.when((h >= 20) & (h < 35), "Weight Captured Separately")
        .when((h >= 35) & (h < 45), pointer)
        .otherwise(_weight().cast("string")),
    }
    common = _common()
    common["vendor"] = F.when(h % 10 == 0, F.concat(F.lit(" "), common["vendor"], F.lit("  "))).otherwise(
        common["vendor"]
    )

    for header, name in COLUMN_NAMES.items():
        if name in common:
            texts[header] = common[name].cast("string")
    return lines.select(*[texts[c].alias(c) for c in PUBLISHED_COLUMNS])


def shipments(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    """The interpreted shipment table, built without the text step.

    ``lines`` are the order lines, if the caller has them stored.
    """
    lines = order_lines(spark, folder) if lines is None else lines
    lines = lines.withColumns(_milestones())
    # counted small: the estimate of its own join would have every derived column moved by country
    regions = small_or_stored(region_dimension(spark, folder))
    h, rdc = F.col("h"), F.col("from_rdc")
    freight_parsed, weight_parsed = h > 40, (h < 20) | (h >= 45)
    pq = F.when(h < 24, "structural").when(h < 26, "missing").otherwise("parsed")
    po = F.when(rdc, "structural").when(h.isin(50, 51), "missing").otherwise("parsed")
    dated = {
        "date_pq_sent": F.when(h >= 26, F.col("quoted")),
        "date_po_sent": F.when(~rdc & ~h.isin(50, 51), F.col("ordered")),
        "date_scheduled": F.when(~_schedule_garbled(), F.col("planned")),
        "date_delivered": F.when(~_delivery_lost(), F.col("shipped")),
        "date_recorded": F.when(~_record_lost(), F.col("recorded")),
        "date_pq_sent_reason": pq,
        "date_po_sent_reason": po,
        "date_scheduled_reason": F.when(_schedule_garbled(), "unparseable").otherwise("parsed"),
        "date_delivered_reason": F.when(_delivery_lost(), "missing").otherwise("parsed"),
        "date_recorded_reason": F.when(_record_lost(), "missing").otherwise("parsed"),
        "freight_cost_usd": F.when(freight_parsed, _freight_cents().cast("double") / 100.0),
        "freight_cost_reason": F.when(h < 16, "structural")
        .when(h < 40, "cross_reference")
        .when(h == 40, "missing")
        .otherwise("parsed"),
        "weight_kg": F.when(weight_parsed, _weight().cast("double")),
        "weight_reason": F.when(weight_parsed, "parsed")
        .when(h < 35, "structural")
        .otherwise("cross_reference"),
    }
    common = _common()
    common["shipment_mode"] = F.coalesce(common["shipment_mode"], F.lit("Unknown"))
    columns = {**common, **dated}
    base = lines.select(*[c.alias(n) for n, c in columns.items()])
    base = base.join(regions, "country", "left")
    base = base.withColumns(
        {
            "region": F.coalesce("region", F.lit("Other")),
            "product_group_name": group_name_of(F.col("product_group")),
            "is_from_rdc": (F.col("fulfil_via") == "From RDC").cast("int"),
        }
    )
    return base.withColumns(derived_columns())


_STORED: dict[tuple, str] = {}


def folder_state(spark: SparkSession, folder: str) -> tuple:
    """Number, total length and latest change of the table files: what a stored copy is valid for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    found = files.load(folder).agg(F.count("path"), F.sum("length"), F.max("modificationTime"))
    return tuple(found.first())


@contextmanager
def _short_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs run meanwhile generate one short method a column.

    The code of a whole stage that derives fifty columns is one method, too long for the JIT
    compiler, and takes four times the CPU.
    """
    name = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _stored(spark: SparkSession, folder: str, name: str, write: Callable[[str], None]) -> str:
    """Path of a table that `write` writes once per application and state of `folder`.

    The files go to the shared checkpoint folder.
    """
    key = (spark.sparkContext.applicationId, folder, name, folder_state(spark, folder))
    if key not in _STORED:
        use_checkpoint_dir(spark)
        path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{len(_STORED)}"
        with passing_shuffles(spark):
            write(path)
        _STORED[key] = path
    return _STORED[key]


def stored_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The joined order lines written once per application: what both shipment views derive from.

    Only what the joins bring together is stored. It is a third of the derived table's
    length, and no shuffle has to even out the rows between the joins and the derivation,
    which reads the files in splits and generates its code apart from that of the joins.
    """

    def write(path: str) -> None:
        order_lines(spark, folder).write.mode("overwrite").option("compression", "zstd").parquet(path)

    return spark.read.parquet(_stored(spark, folder, "lines", write))


def stored_shipments(spark: SparkSession, folder: str) -> DataFrame:
    """The interpreted view written once per application and read back as Parquet.

    Most operators pass over the table more than once; reading the stored,
    column-pruned table replaces a six-way join on each pass.
    """

    def write(path: str) -> None:
        derived = shipments(spark, folder, stored_lines(spark, folder))
        with _short_methods(spark):
            derived.write.mode("overwrite").option("compression", "zstd").parquet(path)

    return spark.read.parquet(_stored(spark, folder, "shipments", write))


def stored_published(spark: SparkSession, folder: str) -> DataFrame:
    """The text view written once per application as compressed CSV and read like a published file."""

    def write(path: str) -> None:
        published = published_shipments(spark, folder, stored_lines(spark, folder))
        # not in the order of the rename table: readers bind by name
        writer = published.select(*sorted(PUBLISHED_COLUMNS, reverse=True)).write.mode("overwrite")
        spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        with _short_methods(spark):
            writer.options(header=True, compression="gzip", maxRecordsPerFile=PUBLISHED_ROWS, **spaces).csv(path)

    return load_shipments_published(spark, _stored(spark, folder, "published", write))


def patients(spark: SparkSession, folder: str) -> DataFrame:
    """Patient rows with dirty text, derived from customer keys.

    Every fifth customer repeats the one before it, sometimes with other casing
    or blanks, so some copies show only after standardising.
    """
    key = F.col("c_custkey")
    k = key - F.when(key % 5 == 4, 1).otherwise(0)
    age, ratio = 15 + (k * 7) % 60, F.lit(6.0) + ((k * 37) % 3200) / F.lit(100.0)
    sex = F.when(k % 2 == 0, "F").otherwise("M")
    pressure = F.when(k % 3 == 0, "HIGH").when(k % 3 == 1, "LOW").otherwise("NORMAL")
    fat = F.when(F.floor(k / 3) % 2 == 0, "HIGH").otherwise("NORMAL")
    drug = (
        F.when(ratio > 15, "DrugY")
        .when((pressure == "HIGH") & (age <= 50), "drugA")
        .when(pressure == "HIGH", "drugB")
        .when((pressure == "LOW") & (fat == "HIGH"), "drugC")
        .otherwise("drugX")
    )
    return table(spark, folder, "customer").select(
        F.when(k % 97 == 5, None)
        .when(k % 97 == 6, "n/a")
        .when(k % 97 == 7, "-5")
        .when(k % 97 == 8, "250")
        .otherwise(age.cast("string"))
        .alias("Age"),
        F.when(k % 89 == 3, None)
        .when(key % 7 == 1, F.lower(sex))
        .when(key % 7 == 2, F.concat(sex, F.lit(" ")))
        .otherwise(sex)
        .alias("Sex"),
        F.when(k % 83 == 4, None)
        .when(key % 11 == 1, F.lower(pressure))
        .when(key % 11 == 2, F.concat(F.lit(" "), pressure))
        .otherwise(pressure)
        .alias("BP"),
        F.when(k % 79 == 2, None).otherwise(fat).alias("Cholesterol"),
        F.when(k % 101 == 9, None).otherwise(ratio).alias("Na_to_K"),
        drug.alias("Drug"),
    )


def scored_shipments(spark: SparkSession, folder: str) -> DataFrame:
    """Shipments with a known outcome and a deterministic, heavily tied risk score."""
    base = F.pmod(F.col("shipment_id") * 13 + F.length("vendor") + F.col("quantity") * 7, F.lit(200))
    score = (base + F.col("is_late") * 60) / F.lit(400.0)
    return stored_shipments(spark, folder).filter("is_late is not null").withColumn("score", score)
