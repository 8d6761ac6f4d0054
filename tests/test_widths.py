"""Work that follows the size of its input, whatever width the session starts with."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from tillspark.plans import feeds, long_orders
from tillspark.session import SETTINGS, scratch_path
from tillspark.sources.standins import Tables
from tillspark.streaming import jobs
from tillspark.streaming.outcomes import Outcomes


def topic(spark, rows: int, files: int):
    text = F.concat(F.lit('{"n":'), F.col("id").cast("string"), F.lit("}"))
    return spark.range(1, rows + 1, numPartitions=files).select(
        F.col("id").alias("seq"), F.col("id").cast("string").alias("key"), text.alias("value")
    )


def test_parts_of_a_topic_have_many_files_and_stay_one_batch_each(spark):
    seen, checkpoint = [], scratch_path(spark, "offsets")

    def handle(rows, batch):
        found = rows.agg(F.count("*"), F.min("seq"), F.max("seq"), F.count_distinct("file")).first()
        seen.append((batch, *found[:3], found[3] > 1))

    def job(part):
        jobs.run_available(part.withColumn("file", F.input_file_name()), handle, checkpoint)

    feeds._in_three(SimpleNamespace(spark=spark), topic(spark, 900, 12), job)
    assert seen == [(0, 300, 1, 300, True), (1, 300, 301, 600, True), (2, 300, 601, 900, True)]


def test_shuffles_start_wider_than_the_session_says(spark):
    assert int(SETTINGS["spark.sql.adaptive.coalescePartitions.initialPartitionNum"]) >= 1000
    rows = spark.range(2_000_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        grouped = rows.repartition("id").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert grouped > 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_long_orders_are_made_once(spark, monkeypatch):
    """Their readers find stored rows, not the windows and joins behind them."""
    seen = []
    monkeypatch.setattr(long_orders, "stock_ledger", lambda stock, lines: seen.append(lines) or SimpleNamespace(lines=lines))
    tables = Tables(spark, "/root/testdata/sf0.001")
    assert "Window" not in _plan(tables.long_items)
    long_orders.long_stock_ledger(tables)
    assert "Generate" not in _plan(seen[0])


def test_stock_job_gives_the_ledger_stored_lines(spark, monkeypatch):
    """The ledger reads its lines several times; none of that unpacks the events again."""
    seen, plain = [], jobs.ledger.stock_ledger

    def ledger(stock, lines, *args):
        seen.append(_plan(lines))
        return plain(stock, lines, *args)

    monkeypatch.setattr(jobs.ledger, "stock_ledger", ledger)
    value = '{"orderId":1,"customerId":1,"sessionId":"s","status":"X","items":[{"productId":1,"quantity":2}]}'
    folder = scratch_path(spark, "topic")
    spark.createDataFrame([(1, "1", value)], "seq long, key string, value string").write.parquet(folder)
    stored = spark.createDataFrame([(1, 1, 9, 0)], "id long, product_id long, quantity int, reserved int")
    out = Outcomes(spark, scratch_path(spark, "out"))
    jobs.stock_job(feeds.read_topic(spark, folder), stored, out, scratch_path(spark, "offsets"))
    assert len(seen) == 1 and "Generate" not in seen[0]
    assert [tuple(r) for r in jobs.current_stock(stored, out).collect()] == [(1, 1, 7, 0)]
