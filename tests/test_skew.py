"""Plans and results where one key holds a third of all rows."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tillspark.functions.pages import PAGE_ITEMS
from tillspark.operators import cart, inventory, ledger, orders, updates


@pytest.fixture
def small_limits(spark):
    """Limits at which a few megabytes count as a large, skewed join."""
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key) for key in limits}
    for key, value in limits.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def hot(spark, n: int):
    """Event lines; product 7 has a third of them."""
    return spark.range(n, numPartitions=16).select(
        F.col("id").alias("event_seq"),
        F.lit(1).cast("long").alias("item_pos"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).cast("long").alias("product_id"),
        (F.col("id") % 5).cast("int").alias("quantity"),
    )


def stock(spark, products: int):
    return spark.range(products).select(
        "id", F.col("id").alias("product_id"), F.lit(60).alias("quantity"), F.lit(0).alias("reserved")
    )


def test_hot_join_key_is_split(spark, small_limits):
    lines = hot(spark, 300_000).withColumn("noise", F.xxhash64("event_seq"))
    joined = inventory.event_items_inventory(lines, stock(spark, 5000))
    summed = joined.groupBy("product_id").agg(F.count("*").alias("n"), F.max("noise"), F.max("stock"))
    assert "skew=true" in final_plan(summed)
    assert summed.filter("product_id = 7").first()["n"] > 100_000


def test_hot_order_is_split(spark, small_limits):
    lines = hot(spark, 300_000).select(
        F.when(F.col("event_seq") % 3 == 0, 0).otherwise(F.col("event_seq")).alias("order_id"),
        (F.floor(F.col("event_seq") / 3) + 1).alias("item_pos"),
        "product_id",
        "quantity",
        F.lit("1.00").cast("decimal(18,2)").alias("unit_price"),
        F.xxhash64("event_seq").alias("noise"),
    )
    stored = spark.range(300_000).select("id", F.col("id").alias("customer_id"))
    lined = orders.orders_with_items(stored, lines)
    summed = lined.groupBy("id").agg(F.count("item_pos").alias("n"), F.max("noise"), F.max("product_id"))
    assert "skew=true" in final_plan(summed)
    assert summed.filter("id = 0").first()["n"] == 100_000
    events = orders.order_placed_events(stored.withColumn("total_amount", F.lit(0)), lines)
    assert max(r["n"] for r in events.select(F.length("value").alias("n")).collect()) < 100 * PAGE_ITEMS


def test_last_row_per_key_combines_before_the_shuffle(spark):
    picked = updates.pick_by_seq(hot(spark, 1000), "product_id", "event_seq")
    plan = final_plan(picked)
    assert "partial_max_by" in plan and "SortAggregate" not in plan and "Window" not in plan


def test_hot_cart_line_is_cut_into_chunks(spark):
    events = spark.range(40_000, numPartitions=8).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("long").alias("cart_id"),
        F.lit("add").alias("action"),
        F.lit(5).cast("long").alias("product_id"),
        F.lit(2).alias("quantity"),
        F.lit(9).alias("available_stock"),
    )
    folded = cart.cart_fold(events, chunk_bits=10)
    assert rows(folded.filter("cart_id = 1 AND added_seq = 0"), "quantity") == [(2 * 13_334 + 2,)]


def test_hot_product_spreads_over_blocks(spark):
    lines, blocks = hot(spark, 30_000), 12
    demand = ledger._demand(stock(spark, 5000), lines)
    laid = ledger._lay_out(demand, lines, blocks)
    sizes = [r["count"] for r in laid.groupBy("block").count().collect()]
    assert max(sizes) < 2 * 30_000 / blocks
    assert laid.filter("product_id = 7").select("block").distinct().count() >= blocks // 4
