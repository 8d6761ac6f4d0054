"""Streaming jobs: each consumer group is one query with its own checkpoint.

A job decodes a micro-batch once and writes everything it makes of it at
once, by outcome: results, rows that do not bind, rejects. Tables change by
upserting what the batches wrote, so there is nothing to roll back: a batch
that is run again writes the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tillspark import schemas
from tillspark.functions.codec import Decoded, bind_events, decode_events
from tillspark.functions.pages import Arrived, event_lines, first_pages, split_arrived, with_places
from tillspark.operators import cart, ledger, lookups, notifications, orders, payments, updates
from tillspark.session import materialize
from tillspark.streaming.outcomes import MALFORMED, REJECTED, Outcomes, raw_rows

Handler = Callable[[DataFrame, int], None]

NOTICE = "kind string, order_id long, customer_id long, text string"
AUDIT = "order_id long, customer_id long"
STATUS = "order_id long, status string, at struct<time:timestamp,topic:string,partition:int,seq:long>"
REJECT = "seq long, order_id long, error_code int, message string"
STOCK = "product_id long, quantity int"
FAILED_LINE = "event_seq long, item_pos long, product_id long, quantity int, error_code int, message string"
SETTLED = "stripe_session_id string, event_seq long, status string, updated_at timestamp_ntz"
PUBLISHED = "seq long, page long, topic string, key string, value string"
UNPAID = "event_seq long, type string, session_id string, error_code int, message string"


def run_available(stream: DataFrame, handle: Handler, checkpoint: str) -> None:
    """Process what is there, batch by batch, and stop.

    A batch is used several times, so it is kept while it is handled.
    """

    def once(rows: DataFrame, batch: int) -> None:
        rows.persist()
        try:
            handle(rows, batch)
        finally:
            rows.unpersist()

    query = (
        stream.writeStream.foreachBatch(once)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _bound(rows: DataFrame) -> Decoded:
    """Valid and malformed rows of a batch that `bind_events` bound before it was kept."""
    return Decoded(rows.filter(~F.col("malformed")), raw_rows(rows.filter("malformed")))


def notification_job(
    placed: DataFrame, cancelled: DataFrame, out: str, checkpoint: str, on_error: str = "fail"
) -> None:
    """Both order topics into one feed, appended exactly once.

    A bad payload stops the job by default, which is how the shop's
    listeners behave; otherwise see `notices_job`.
    """
    feed = notifications.notification_feed(
        decode_events(placed, schemas.ORDER_PLACED, on_error=on_error).valid,
        decode_events(cancelled, schemas.ORDER_CANCELLED, on_error=on_error).valid,
    )
    query: StreamingQuery = (
        feed.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def notices_job(
    events: DataFrame, schema, notices: Callable[[DataFrame], DataFrame], name: str, out: Outcomes, checkpoint: str
) -> None:
    """Notices of one topic under `name`, and its malformed rows."""

    def handle(rows: DataFrame, batch: int) -> None:
        decoded = _bound(rows)
        out.write(batch, **{name: notices(decoded.valid), MALFORMED: decoded.quarantine})

    run_available(bind_events(events, schema), handle, checkpoint)


def payment_notice_job(events: DataFrame, out: Outcomes, checkpoint: str) -> None:
    """Payment notices; the shop defines them but starts no such listener."""
    notices_job(events, schemas.PAYMENT_EVENT, notifications.payment_notices, "notice", out, checkpoint)


def cancel_audit_job(cancelled: DataFrame, out: Outcomes, checkpoint: str) -> None:
    notices_job(cancelled, schemas.ORDER_CANCELLED, notifications.cancel_audit, "audit", out, checkpoint)


def _lines_of(placed: DataFrame) -> DataFrame:
    return event_lines(placed, F.col("_item.productId").alias("product_id"), F.col("_item.quantity").alias("quantity"))


def payment_lines(topic: DataFrame) -> DataFrame:
    """Payment topic rows to stock event lines; any status counts."""
    return _lines_of(with_places(decode_events(topic, schemas.PAYMENT_EVENT).valid))


def _statuses_of(valid: DataFrame) -> DataFrame:
    events = first_pages(with_places(valid))
    place = ["at"] if "at" in valid.columns else []
    return events.select("seq", *place, F.col("event.orderId").alias("order_id"), "event.status")


def payment_statuses(topic: DataFrame) -> DataFrame:
    """Payment topic rows to (seq, order_id, status), one per event."""
    return _statuses_of(decode_events(topic, schemas.PAYMENT_EVENT).valid)


def order_status_job(
    topic: DataFrame, stored: DataFrame, out: Outcomes, checkpoint: str, failed_topic: DataFrame | None = None
) -> None:
    """Payment events give order statuses; `current_orders` has them applied.

    The shop listens to payment-completed alone. `failed_topic` adds the
    payment-failed topic, whose events cancel orders. Events of orders that
    `stored` lacks are rejected.
    """
    if failed_topic is not None:
        topic = topic.unionByName(failed_topic)
    known = stored.select(F.col("id").alias("order_id"), F.lit(True).alias("_known"))

    def handle(rows: DataFrame, batch: int) -> None:
        decoded = _bound(rows)
        routed = _statuses_of(decoded.valid).withColumn("status", orders.route_payment_status("status"))
        marked = routed.filter(F.col("status").isNotNull()).join(known, "order_id", "left")
        out.write(batch, **{
            "status": marked.filter("_known").select("order_id", "status", "at"),
            REJECTED: lookups.not_found(
                marked.filter(F.col("_known").isNull()).select("seq", "order_id"), "order_id", lookups.NOT_FOUND_TEXT["order"]
            ),
            MALFORMED: decoded.quarantine,
        })

    run_available(bind_events(topic, schemas.PAYMENT_EVENT), handle, checkpoint)


def current_orders(stored: DataFrame, out: Outcomes) -> DataFrame:
    """The orders with the last status that the job gave them, in the order of all topics."""
    return orders.set_order_status(stored, out.read("status", STATUS), "at").table


def hold_back(placed: DataFrame) -> Arrived:
    """Whole events that may go on, and pages that wait.

    Events behind one that still waits for a page wait with it, so the
    order of events holds.
    """
    arrived = split_arrived(placed)
    first = arrived.waiting.agg(F.min("event_seq").alias("_first"))  # one row
    marked = arrived.whole.crossJoin(F.broadcast(first))
    behind = F.coalesce(F.col("event_seq") > F.col("_first"), F.lit(False))
    return Arrived(
        marked.filter(~behind).drop("_first"),
        marked.filter(behind).drop("_first").unionByName(arrived.waiting),
    )


def stock_job(
    topic: DataFrame, stored: DataFrame, out: Outcomes, checkpoint: str, mode: str = "exact", blocks: int | None = None
) -> None:
    """Payment events drive the stock ledger; `current_stock` has the result.

    Pages of an event may come in different batches; they wait, as an
    outcome of the batch, until the event is whole. Outcomes: the last
    stock of every product that a batch moved, failed lines, waiting pages,
    malformed rows.
    """

    def handle(rows: DataFrame, batch: int) -> None:
        decoded = _bound(rows)
        waited = out.of_batch("waiting", schemas.TOPIC, batch - 1)
        again = bind_events(waited, schemas.PAYMENT_EVENT)
        events = with_places(decoded.valid.drop("at").unionByName(again))
        ready = hold_back(events)
        # Written once: the ledger reads its lines several times.
        lines = materialize(_lines_of(ready.whole), "stock-lines")
        touched = current_stock(stored, out, batch).join(
            lines.select("product_id").distinct(), "product_id", "left_semi"
        ).select(*stored.columns)
        result = ledger.stock_ledger(touched, lines, mode, blocks)
        out.write(batch, **{
            "stock": result.inventory.select("product_id", "quantity"),
            REJECTED: ledger.ledger_rejects(result.lines),
            "waiting": raw_rows(ready.waiting),
            MALFORMED: decoded.quarantine,
        })

    run_available(bind_events(topic, schemas.PAYMENT_EVENT), handle, checkpoint)


def current_stock(stored: DataFrame, out: Outcomes, before: int | None = None) -> DataFrame:
    """The stock as the last batch that moved a product left it."""
    last = updates.pick_by_seq(out.read("stock", STOCK, before), "product_id", "batch").drop("batch")
    return updates.overwrite_fields(stored, last, "product_id", ["quantity"])


def settle_job(
    webhooks: DataFrame, stored: DataFrame, texts: DataFrame, out: Outcomes, checkpoint: str
) -> None:
    """Webhook events settle payments and publish to two topics.

    Outcomes: what settles a payment, the published events with their
    topic, rejects. Events meet the payments once.
    """

    def handle(rows: DataFrame, batch: int) -> None:
        matched = payments.webhook_payments(rows, stored)
        published = payments.payment_events(matched.events, texts)
        topic = F.when(F.col("status") == "COMPLETED", schemas.PAYMENT_COMPLETED_TOPIC).otherwise(schemas.PAYMENT_FAILED_TOPIC)
        out.write(batch, **{
            "settled": matched.events.select(
                F.col("session_id").alias("stripe_session_id"), "event_seq", "status", F.col("ts").alias("updated_at")
            ),
            "published": published.select(F.col("event_seq").alias("seq"), "page", topic.alias("topic"), "key", "value"),
            REJECTED: matched.rejects.select("event_seq", "type", "session_id", "error_code", "message"),
        })

    run_available(webhooks, handle, checkpoint)


def current_payments(stored: DataFrame, out: Outcomes) -> DataFrame:
    """The payments with status and time of the last event that settled them."""
    paid = (F.col("status") == "COMPLETED").alias("paid")
    coded = out.read("settled", SETTLED).select("stripe_session_id", "event_seq", paid, "updated_at")
    last = updates.pick_by_seq(coded, "stripe_session_id", "event_seq").select(
        "stripe_session_id", F.when(F.col("paid"), "COMPLETED").otherwise("FAILED").alias("status"), "updated_at"
    )
    return updates.overwrite_fields(stored, last, "stripe_session_id", ["status", "updated_at"])


def published_topic(out: Outcomes, topic: str) -> DataFrame:
    """The rows that the settle job published to a topic."""
    return out.read("published", PUBLISHED).filter(F.col("topic") == topic).select("seq", "page", "key", "value")


class CartLines(StatefulProcessor):
    """The lines of one cart in Spark's keyed state; a batch loads only the carts it has events of."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getMapState("lines", "product_id long", "quantity long, available_stock int, added_seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        lines = {p[0]: list(line) for p, line in self.lines.iterator()} if self.lines.exists() else {}
        before = dict.fromkeys(lines)
        for seq, action, product, quantity, stock in zip(
            *(events[c].astype(object).where(events[c].notna(), None) for c in ("seq", "action", "product_id", "quantity", "available_stock"))
        ):
            line = lines.get(product)
            if action == "clear":
                lines.clear()
            elif action == "remove" or action == "set" and quantity is not None and quantity <= 0:
                lines.pop(product, None)
            elif action == "set":  # raised above the stock only by adding
                if line and quantity is not None and not quantity > max(line[:2]):
                    line[0] = int(quantity)
            elif action == "add" and line:
                line[0] += cart.DEFAULT_QUANTITY if quantity is None else int(quantity)
            elif action == "add":
                lines[product] = [
                    cart.DEFAULT_QUANTITY if quantity is None else int(quantity),
                    cart.DEFAULT_STOCK if stock is None else int(stock), int(seq),
                ]
        for product in before:
            if product not in lines:
                self.lines.removeKey((product,))
        for product, line in lines.items():
            self.lines.updateValue((int(product),), tuple(line))
        yield pd.DataFrame({"cart_id": [key[0]], "lines": [len(lines)]})

    def close(self) -> None:
        pass


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _keyed_state(spark: SparkSession):
    """The state store that stateful processors need, while a query starts and runs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def cart_job(events: DataFrame, out: Outcomes, checkpoint: str) -> None:
    """Cart events replayed in sequence on the carts' lines, which live in the query's state.

    The size of a micro-batch (`max_files`) bounds what one cart sorts at once.
    """
    counts = events.groupBy("cart_id").transformWithStateInPandas(
        CartLines(), "cart_id long, lines long", "update", "none"
    )
    with _keyed_state(events.sparkSession):
        query = (
            counts.writeStream.foreachBatch(lambda rows, batch: out.write(batch, changed=rows))
            .option("checkpointLocation", checkpoint)
            .outputMode("update")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def current_carts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """All cart lines, read from the state of the cart job."""
    state = (
        spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "lines")
        .option("flattenCollectionTypes", "true").load()
    )
    return state.select(
        F.col("key.cart_id").alias("cart_id"), F.col("user_map_key.product_id").alias("product_id"), "user_map_value.*"
    )
