"""Reading and writing the five stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from tillspark import schemas


def scan(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Read with a declared schema; nothing is inferred."""
    return spark.read.schema(schema).format(fmt).load(path)


def scan_products(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, schemas.PRODUCTS)


def scan_inventory(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, schemas.INVENTORY)


def scan_orders(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, schemas.ORDERS)


def scan_order_items(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, schemas.ORDER_ITEMS)


def scan_payments(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, schemas.PAYMENTS)


def scan_jdbc(
    spark: SparkSession, url: str, table: str, id_column: str, low: int, high: int, parts: int
) -> DataFrame:
    """Read a database table in `parts` ranges of its id, filters pushed down.

    Needs the database's driver on the class path.
    """
    return (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", id_column)
        .option("lowerBound", low)
        .option("upperBound", high)
        .option("numPartitions", parts)
        .load()
    )
