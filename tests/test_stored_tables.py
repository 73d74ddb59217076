"""The stored order lines, and the two shipment views that derive from them."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from dockline.operators import ingest
from dockline.sources import tables

DAY = dt.datetime(1997, 3, 4)


@pytest.fixture()
def folder(spark, tmp_path):
    """Tables with a repeated order, a repeated supplier, null keys and keys without a partner."""
    lines = [
        (order, part, supplier, number, 5.0, 100.0 + (order or 0), 0.05, 0.02, DAY)
        for number, (order, part, supplier) in enumerate(
            [(1, 1, 1), (1, 2, 1), (2, 1, 2), (2, 2, 2), (3, 1, 1), (4, 1, 1), (None, 1, 1), (1, None, 1), (9, 1, 1), (1, 9, 1), (1, 1, 9)], 1)
    ]
    made = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                            "l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"),
        "orders": ([(1, 1, "1-URGENT"), (2, 2, "5-LOW"), (2, 2, "2-HIGH"), (3, None, "5-LOW"), (4, 7, "5-LOW"), (None, 1, "5-LOW")],
                   "o_orderkey long, o_custkey long, o_orderpriority string"),
        "customer": ([(1, 0, "FURNITURE"), (2, 24, "MACHINERY"), (None, 0, "FURNITURE")],
                     "c_custkey long, c_nationkey int, c_mktsegment string"),
        "nation": ([(0, "NATION_0", 0), (24, "NATION_24", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "AFRICA")], "r_regionkey int, r_name string"),
        "part": ([(1, "hot bolt", "Brand#7", "SMALL", 3), (2, "blue ring", "Brand#25", "LARGE", 4), (None, "x", "Brand#1", "LARGE", 1)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "supplier": ([(1, "S1"), (1, "S1 again"), (2, "S2")], "s_suppkey long, s_name string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_lines_are_those_of_the_plain_join_and_move_once_for_order_and_customer(spark, folder):
    names = ("lineitem", "orders", "customer", "nation", "part", "supplier")
    for name in names:
        tables.table(spark, folder, name).createOrReplaceTempView(f"plain_{name}")
    plain = spark.sql("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, o_orderpriority, c_nationkey, c_mktsegment, n_name, p_name, s_name
        FROM plain_lineitem JOIN plain_orders ON l_orderkey = o_orderkey JOIN plain_customer ON o_custkey = c_custkey
        JOIN plain_nation ON c_nationkey = n_nationkey JOIN plain_part ON l_partkey = p_partkey JOIN plain_supplier ON l_suppkey = s_suppkey""")
    lines = tables.order_lines(spark, folder)
    assert sorted(map(tuple, lines.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    assert plain.count() == 8
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tables.order_lines(spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # rows that are joined with customers hold no line yet
    assert not any("o_custkey" in row and "l_orderkey" in row for row in plan.splitlines() if "Exchange" in row or "Project" in row)


def test_both_views_come_from_stored_lines_in_compressed_files(spark, folder):
    ship = tables.stored_shipments(spark, folder)
    text = tables.stored_published(spark, folder)
    read = ingest.interpret(text, tables.region_dimension(spark, folder)).select(*ship.columns)
    assert ship.count() == 8 and read.exceptAll(ship).count() == 0 and ship.exceptAll(read).count() == 0
    kept = {key[2]: path.removeprefix("file:") for key, path in tables._STORED.items() if key[1] == folder}
    assert set(kept) == {"lines", "shipments", "published"}
    written = [name for name in os.listdir(kept["published"]) if name.startswith("part-")]
    assert written and all(name.endswith(".csv.gz") for name in written)
    assert all(".zstd." in name for name in os.listdir(kept["shipments"]) if name.startswith("part-"))
    assert spark.conf.get("spark.sql.codegen.wholeStage") == "true"
