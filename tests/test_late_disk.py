"""What storing the shipments and splitting them for training moves and leaves on disk."""

from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import functions as F

from dockline.operators import evaluation
from dockline.plans.ranking import packed, use_checkpoint_dir
from dockline.sources import tables


def _stored_bytes(spark) -> int:
    use_checkpoint_dir(spark)
    folder = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


def test_packed_rows_keep_their_partitions_order_and_values(spark):
    df = spark.range(0, 130_000, 1, 3).select(
        "id", (-F.col("id")).cast("int").alias("i"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("é"), "id")).alias("t"),
        F.when(F.col("id") % 5 > 0, F.lit("NaN").cast("double")).otherwise(-0.0).alias("x"), (F.col("id") % 2 == 0).alias("b"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 99).cast("int")).alias("d"))
    at = [F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")]
    kept = packed(df)
    assert kept.schema == df.schema
    assert kept.select("*", *at).exceptAll(df.select("*", *at)).isEmpty() and kept.count() == 130_000
    assert packed(df.limit(0)).collect() == []
    other = spark.sql("select timestamp_ntz'2020-01-01 00:00:00' t, array(1, null) a")
    assert packed(other).collect() == other.collect()


def test_a_split_stores_rows_in_few_bytes_and_no_hash(spark):
    df = spark.range(40_000).select(
        "id", F.concat(F.lit("a level that many rows share "), F.col("id") % 3).alias("c"), (F.col("id") % 7).cast("double").alias("x"),
        F.when(F.col("id") % 4 == 0, "Late").otherwise("On Time").alias("label"))
    before = _stored_bytes(spark)
    split = evaluation.with_split(df, "label", ["id"])
    assert split.columns == ["label", "id", "c", "x", "is_test", "fold"]
    assert split.filter("is_test").count() == 10_000
    assert _stored_bytes(spark) - before < 40_000 * 15


def test_shipments_are_not_moved_for_their_region(spark, tmp_path):
    for name, sql in {
        "nation": "select 1 n_nationkey, 'NATION_1' n_name, 1 n_regionkey union all select 24, 'NATION_24', 1",
        "region": "select 1 r_regionkey, 'ASIA' r_name",
    }.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    lines = spark.sql(
        """select id l_orderkey, id l_partkey, id l_suppkey, 1 l_linenumber, 2.0D l_quantity, 10.0D l_extendedprice, 0.1D l_discount,
        0.1D l_tax, date'1997-01-01' l_shipdate, date'1997-01-01' shipped, '1-URGENT' o_orderpriority, 1L c_nationkey, 'x' c_mktsegment,
        if(id = 1, 'NATION_1', 'NATION_24') n_name, 'p' p_name, 'Brand#11' p_brand, 'SMALL' p_type, 3 p_size, 's' s_name, id % 100 h from range(1, 4)""")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        ship = tables.shipments(spark, str(tmp_path), lines)
        got = {r["shipment_id"]: r["region"] for r in ship.select("shipment_id", "region").collect()}
        plan = ship._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {9: "ASIA", 17: "Other", 25: "Other"}
    assert "hashpartitioning(country" not in plan
