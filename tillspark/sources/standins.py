"""The shop's tables as views over the test tables.

One text per view, valid in Spark SQL and in DuckDB, so that both sides of
a check start from the same rows. `{name}` is a raw table. All views read
their table whole; their size grows with it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tillspark.functions.pages import PAGE_ITEMS, encode_page, item_pages, with_item_pages
from tillspark.functions.positions import row_positions
from tillspark.operators import payments as payment_ops
from tillspark.session import materialize, scratch_path

_CATEGORY = (
    "CASE WHEN p_type IN ('ECONOMY','SMALL') THEN 'DECK' "
    "WHEN p_type IN ('MEDIUM','PROMO') THEN 'TRUCKS' ELSE {rest} END"
)

VIEWS = {
    "products": f"""
        SELECT p_partkey AS id, p_name AS name, p_brand AS brand,
          {_CATEGORY.format(rest="'WHEELS'")} AS category,
          CAST(p_retailprice AS DECIMAL(18,2)) AS price, p_type AS description,
          concat('/img/', CAST(p_partkey AS STRING), '.jpg') AS image_url,
          CAST(p_size AS DOUBLE) AS width, p_size < 46 AS active
        FROM {{part}}""",
    "inventory": """
        SELECT p_partkey AS id, p_partkey AS product_id, p_size * 4 AS quantity,
          CAST(p_size % 4 AS INT) AS reserved
        FROM {part} WHERE p_type <> 'PROMO'""",
    "orders_t": """
        SELECT o_orderkey AS id, o_custkey AS customer_id,
          CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'PAID' ELSE 'CANCELLED' END AS status,
          CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount, o_orderdate AS created_at
        FROM {orders}""",
    "lines_t": """
        SELECT l_orderkey AS order_id, l_linenumber, l_suppkey, l_partkey AS product_id,
          CAST(l_quantity AS INT) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS unit_price
        FROM {lineitem}""",
    "payments": """
        SELECT o_orderkey AS id, o_orderkey AS order_id, o_custkey AS customer_id,
          CAST(o_totalprice AS DECIMAL(18,2)) AS amount, 'PENDING' AS status,
          concat('sess_', CAST(o_orderkey AS STRING)) AS stripe_session_id,
          o_orderdate AS created_at, CAST(NULL AS TIMESTAMP{ntz}) AS updated_at
        FROM {orders} WHERE o_orderpriority <> '4-NOT SPECIFIED'""",
    "webhook_events": """
        SELECT event_id AS event_seq, ts,
          CASE event_type WHEN 'purchase' THEN 'checkout.session.completed'
            WHEN 'error' THEN 'checkout.session.expired'
            ELSE concat('other.', event_type) END AS type,
          CASE WHEN event_id % 5 = 0 THEN NULL
            ELSE concat('sess_', CAST(event_id >> 1 AS STRING)) END AS session_id,
          CASE WHEN event_id % 97 = 0 THEN 'not-valid-json'
            ELSE concat('{{"id":"sess_', CAST(event_id >> 1 AS STRING), '"}}') END AS raw
        FROM {events}""",
    "cart_events": """
        SELECT event_id AS seq, user_id AS cart_id,
          CASE WHEN event_type = 'purchase' AND value > 150 THEN 'clear'
            WHEN event_type IN ('view', 'purchase') THEN 'set'
            WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS action,
          CAST(floor(value) AS BIGINT) % 20 AS product_id, CAST(event_id % 6 AS INT) AS quantity,
          CAST(event_id % 40 AS INT) AS available_stock
        FROM {events}""",
    "status_changes": """
        SELECT event_id AS seq, event_id >> 2 AS order_id,
          CASE event_type WHEN 'purchase' THEN 'PAID' WHEN 'click' THEN 'SHIPPED'
            WHEN 'view' THEN 'DELIVERED' WHEN 'error' THEN 'CANCELLED' ELSE 'PENDING' END AS status
        FROM {events}""",
    "product_requests": f"""
        SELECT p_partkey AS request_id, CASE WHEN p_partkey % 13 = 0 THEN '  ' ELSE p_name END AS name,
          CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_brand END AS brand,
          {_CATEGORY.format(rest="NULL")} AS category,
          CAST(CASE WHEN p_partkey % 17 = 0 THEN -1.0 ELSE p_retailprice END AS DECIMAL(18,2)) AS price,
          p_type AS description, CAST(NULL AS STRING) AS image_url, CAST(p_size AS DOUBLE) AS width
        FROM {{part}}""",
    "stock_requests": """
        SELECT l_orderkey AS seq, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey END AS product_id,
          CASE WHEN l_returnflag = 'N' AND l_linenumber = 6 THEN NULL
            ELSE CAST(l_quantity AS INT) - 3 END AS quantity
        FROM {lineitem}""",
    "payment_requests": """
        SELECT CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey END AS order_id,
          CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS customer_id,
          CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0 - o_totalprice WHEN '1-URGENT' THEN NULL
            ELSE o_totalprice END AS DECIMAL(18,2)) AS amount
        FROM {orders}""",
}

# The order of lines within an order, unique in the test tables.
LINE_ORDER = ["l_linenumber", "product_id", "l_suppkey", "quantity", "unit_price"]

# DuckDB forms of the views that Spark derives with functions of this package.
DERIVED_SQL = {
    "order_items": """
        SELECT order_id, CAST(row_number() OVER (PARTITION BY order_id
            ORDER BY l_linenumber, product_id, l_suppkey, quantity, unit_price) AS BIGINT) AS item_pos,
          product_id, quantity, unit_price
        FROM lines_t""",
    "long_orders": """
        SELECT CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS id, min(customer_id) AS customer_id, min(created_at) AS created_at
        FROM orders_t GROUP BY 1""",
    "long_items": """
        SELECT CASE WHEN order_id % 3 = 0 THEN 0 ELSE order_id END AS order_id,
          CAST(row_number() OVER (PARTITION BY CASE WHEN order_id % 3 = 0 THEN 0 ELSE order_id END
            ORDER BY order_id, item_pos) AS BIGINT) AS item_pos,
          product_id, quantity, unit_price
        FROM order_items WHERE order_id IN (SELECT id FROM orders_t)""",
    "payment_items": """
        SELECT order_id, concat('[', string_agg(concat('{"productId":', CAST(product_id AS VARCHAR),
            ',"quantity":', CAST(quantity AS VARCHAR), '}'), ',' ORDER BY item_pos), ']') AS items_json
        FROM order_items GROUP BY order_id""",
    "payment_pages": f"""
        SELECT order_id, page, (any_value(n) + {PAGE_ITEMS} - 1) // {PAGE_ITEMS} AS pages, page * {PAGE_ITEMS} AS item_offset,
          concat('[', string_agg(concat('{{"productId":', CAST(product_id AS VARCHAR),
            ',"quantity":', CAST(quantity AS VARCHAR), '}}'), ',' ORDER BY item_pos), ']') AS items_json
        FROM (SELECT *, (item_pos - 1) // {PAGE_ITEMS} AS page, count(*) OVER (PARTITION BY order_id) AS n FROM order_items)
        GROUP BY order_id, page""",
    "paid": """
        SELECT p.*, n.item_count FROM payments p
        LEFT JOIN (SELECT order_id, count(*) AS item_count FROM lines_t GROUP BY order_id) n ON n.order_id = p.order_id""",
}


def stored(rows: DataFrame, schema: T.StructType) -> str:
    """The rows written as a stored table with the declared columns; its path."""
    path = scratch_path(rows.sparkSession, "stored")
    columns = [
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ]
    rows.select(*columns).write.parquet(path)
    return path


class Tables:
    """The stand-in views of one test folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        used = [t for t in ("part", "orders", "lineitem", "events") if f"{{{t}}}" in VIEWS[name]]
        text = VIEWS[name].replace("{ntz}", "_NTZ")
        return self.spark.sql(text, **{t: self.raw(t) for t in used})

    @cached_property
    def order_items(self) -> DataFrame:
        """Order lines with their position in the order."""
        placed = row_positions(self.lines_t, "order_id", LINE_ORDER, "item_pos")
        return placed.select("order_id", "item_pos", "product_id", "quantity", "unit_price")

    @cached_property
    def request_heads(self) -> DataFrame:
        """Order requests without their lines; every eleventh lacks its customer."""
        return self.orders_t.select(
            F.col("id").alias("request_id"),
            F.when(F.col("id") % 11 != 0, F.col("customer_id")).alias("customer_id"),
        )

    @cached_property
    def request_lines(self) -> DataFrame:
        """Lines of the order requests."""
        return self.order_items.withColumnRenamed("order_id", "request_id")

    @cached_property
    def long_orders(self) -> DataFrame:
        """Every third order taken together as one, with a third of all lines."""
        joined = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("id")
        return self.orders_t.groupBy(joined).agg(
            F.min("customer_id").alias("customer_id"), F.min("created_at").alias("created_at")
        )

    @cached_property
    def long_items(self) -> DataFrame:
        """The lines of `long_orders`, written once, since every reader takes them several times."""
        known = self.order_items.join(self.orders_t.select(F.col("id").alias("order_id")), "order_id", "left_semi")
        rows = known.withColumnsRenamed({"order_id": "_order", "item_pos": "_pos"}).withColumn(
            "order_id", F.when(F.col("_order") % 3 == 0, 0).otherwise(F.col("_order"))
        )
        placed = row_positions(rows, "order_id", ["_order", "_pos"], "item_pos")
        return materialize(placed.select("order_id", "item_pos", "product_id", "quantity", "unit_price"), "long-items")

    @cached_property
    def paid(self) -> DataFrame:
        """Payments with the number of their items."""
        counted = self.lines_t.groupBy("order_id").agg(F.count("*").alias("item_count"))
        return self.payments.join(counted, "order_id", "left")

    @cached_property
    def payment_texts(self) -> DataFrame:
        """The items of the payments as JSON text."""
        return payment_ops.item_texts(self.order_items)

    @cached_property
    def ledger_lines(self) -> DataFrame:
        """Every order as one stock event, its lines in position order."""
        return self.order_items.select(
            F.col("order_id").alias("event_seq"), "item_pos", "product_id", "quantity"
        )

    @cached_property
    def payment_topic(self) -> DataFrame:
        """Payment events as topic rows, statuses by amount."""
        return payment_topic(self.orders_t, self.order_items)


def payment_topic(orders: DataFrame, items: DataFrame) -> DataFrame:
    """A payment event of every order as topic rows, its status by the order's amount."""
    amount = F.col("total_amount")
    status = (
        F.when(amount > 300_000, F.lit("COMPLETED"))
        .when(amount < 100_000, F.lit("FAILED"))
        .otherwise(F.lit("UNKNOWN"))
    )
    entry = F.struct(F.col("product_id").alias("productId"), "quantity")
    pages = item_pages(items, "order_id", entry).withColumnRenamed("order_id", "id")
    bare = orders.join(items.select(F.col("order_id").alias("id")).distinct(), "id", "left_anti")
    return with_item_pages(orders, pages, "id", bare).select(
        F.col("id").alias("seq"),
        F.col("id").cast("string").alias("key"),
        encode_page(
            F.col("id"),
            F.col("id").alias("orderId"),
            F.col("customer_id").alias("customerId"),
            F.concat(F.lit("sess_"), F.col("id").cast("string")).alias("sessionId"),
            status.alias("status"),
            F.col("items"),
        ).alias("value"),
    )
