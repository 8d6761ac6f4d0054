from __future__ import annotations

import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_cart import EVENT, random_events, replay
from test_ledger import STOCK, strict

from tillspark import schemas
from tillspark.functions.codec import decode_events
from tillspark.functions.pages import PAGE_ITEMS
from tillspark.operators import orders, payments
from tillspark.sources.topics import read_topic, subscribe, write_topic
from tillspark.streaming import jobs
from tillspark.streaming.outcomes import REJECTED, Outcomes

PLACED = json.dumps({
    "orderId": 2, "customerId": 200, "totalAmount": 61.5,
    "items": [{"productId": p, "quantity": q, "unitPrice": u} for p, q, u in ((31, 3, 12.5), (44, 2, 12.0))],
})


def in_files(table, folder, events, files):
    """Publish in order, in that many files, one after the other."""
    size = -(-len(events) // files)
    for i in range(0, len(events), size):
        write_topic(table("seq long, key string, value string", *events[i:i + size]).coalesce(1), folder)


def paid(seq, order, status="COMPLETED", items=()):
    body = {
        "orderId": order, "customerId": 1, "sessionId": "s", "status": status,
        "items": [{"productId": p, "quantity": q} for p, q in items],
    }
    return (seq, str(order), json.dumps(body))


@pytest.fixture
def folders(tmp_path):
    return lambda name: str(tmp_path / name)


@pytest.mark.parametrize("files", [1, 5])
def test_order_status_job(spark, table, folders, files):
    stored = spark.sql("SELECT id, 1L customer_id, 'PENDING' status FROM range(20)")
    rnd = random.Random(files)
    events = [
        paid(s, rnd.randint(0, 24), rnd.choice(["COMPLETED", "FAILED", "UNKNOWN"])) for s in range(60)
    ]
    events[7] = (7, "x", "not-valid-json")
    in_files(table, folders("topic"), events, files)
    out = Outcomes(spark, folders("out"))
    jobs.order_status_job(read_topic(spark, folders("topic"), max_files=1), stored, out, folders("offsets"))
    batch = orders.apply_payment_status(
        stored, jobs.payment_statuses(table("seq long, key string, value string", *events))
    )
    assert rows(jobs.current_orders(stored, out)) == rows(batch.table)
    assert rows(out.read(REJECTED, jobs.REJECT), "seq", "order_id") == rows(batch.rejects, "seq", "order_id")
    assert rows(out.malformed()) == [(7, "x", "not-valid-json")]


@pytest.mark.parametrize("files", [1, 3])
def test_stock_job_equals_strict_processing(spark, table, folders, files):
    rnd = random.Random(files)
    stock = [(p, p, rnd.randint(0, 30), 0) for p in range(5)]
    orders_ = [[(rnd.randint(0, 5), rnd.randint(1, 9)) for _ in range(rnd.randint(0, 4))] for _ in range(40)]
    events = [paid(s, s, "ANY", items) for s, items in enumerate(orders_)]
    in_files(table, folders("topic"), events, files)
    stored, out = table(STOCK, *stock), Outcomes(spark, folders("out"))
    jobs.stock_job(read_topic(spark, folders("topic"), max_files=1), stored, out, folders("offsets"), blocks=3)
    lines = [(s, i + 1, p, q) for s, items in enumerate(orders_) for i, (p, q) in enumerate(items)]
    assert rows(jobs.current_stock(stored, out), "product_id", "quantity") == strict(stock, lines)[1]


def test_stock_job_reports_failed_lines(spark, table, folders):
    events = [
        paid(1, 1, items=[(1, 30), (2, 1)]), paid(2, 2, items=[(9, 1)]), paid(3, 3, items=[(1, None)]), (4, "k", "{"),
    ]
    in_files(table, folders("topic"), events, 1)
    stored, out = table(STOCK, (1, 1, 20, 0), (2, 2, 5, 0)), Outcomes(spark, folders("out"))
    jobs.stock_job(read_topic(spark, folders("topic")), stored, out, folders("offsets"), blocks=2)
    assert rows(out.read(REJECTED, jobs.FAILED_LINE), "event_seq", "error_code", "message") == [
        (1, 409, "Insufficient stock for product: 1"),
        (2, 404, "Inventory not found for product: 9"),
        (3, 500, "An unexpected error occurred"),
    ]
    assert rows(out.malformed()) == [(4, "k", "{")]
    assert rows(jobs.current_stock(stored, out), "product_id", "quantity") == [(1, 20), (2, 5)]


def test_restart_continues_and_a_retried_batch_applies_once(spark, table, folders):
    stored, out = table(STOCK, (1, 1, 20, 0)), Outcomes(spark, folders("out"))

    def run():
        jobs.stock_job(read_topic(spark, folders("topic")), stored, out, folders("offsets"), blocks=2)
        return rows(jobs.current_stock(stored, out), "quantity")

    in_files(table, folders("topic"), [paid(1, 1, items=[(1, 3)])], 1)
    assert run() == [(17,)]
    assert run() == [(17,)]
    in_files(table, folders("topic"), [paid(2, 2, items=[(1, 4)])], 1)
    assert run() == [(13,)]
    # The same event again is new input and takes stock again.
    in_files(table, folders("topic"), [paid(3, 2, items=[(1, 4)])], 1)
    assert run() == [(9,)]
    # A batch that is run again starts from the batches before it and replaces what it wrote.
    before = rows(jobs.current_stock(stored, out, 2), "quantity")
    out.write(2, stock=table("product_id long, quantity int", (1, before[0][0] - 4)))
    assert rows(jobs.current_stock(stored, out), "quantity") == [(9,)]


def test_event_in_pages_over_two_batches_is_one_event(spark, table, folders):
    """Its last page comes a batch later; events behind it wait, and a failed line skips the rest of all its pages."""
    n = PAGE_ITEMS * 2 + 5
    items = [(1, 1)] * (PAGE_ITEMS + 3) + [(2, 999)] + [(1, 1)] * (n - PAGE_ITEMS - 4)
    lines = table(
        "order_id long, item_pos long, product_id long, quantity int, unit_price decimal(18,2)",
        *[(5, i + 1, p, q, None) for i, (p, q) in enumerate(items)], (6, 1, 1, 7, None),
    )
    stored = spark.sql("SELECT id, 1L customer_id, CAST(400000 AS DECIMAL(18,2)) total_amount FROM range(5, 7)")
    from tillspark.sources.standins import payment_topic

    topic = payment_topic(stored, lines).cache()
    assert topic.count() == 4
    late = F.get_json_object("value", "$.page") == "2"
    write_topic(topic.filter(~F.coalesce(late, F.lit(False))).coalesce(1), folders("topic"))
    write_topic(topic.filter(late).coalesce(1), folders("topic"))
    stock, out = table(STOCK, (1, 1, 1_000_000, 0), (2, 2, 5, 0)), Outcomes(spark, folders("out"))
    stream = read_topic(spark, folders("topic"), max_files=1)
    jobs.stock_job(stream, stock, out, folders("offsets"), blocks=2)
    assert rows(out.of_batch("waiting", "seq long", 0)) == [(5,), (5,), (6,)]
    assert rows(out.of_batch("waiting", "seq long", 1)) == []
    moved = {r["batch"]: r["quantity"] for r in out.read("stock", jobs.STOCK).filter("product_id = 1").collect()}
    assert moved == {1: 1_000_000 - (PAGE_ITEMS + 3) - 7}
    failed = rows(out.read(REJECTED, jobs.FAILED_LINE), "event_seq", "item_pos", "product_id")
    assert failed == [(5, PAGE_ITEMS + 4, 2)]
    notices = Outcomes(spark, folders("notices"))
    jobs.payment_notice_job(read_topic(spark, folders("topic"), max_files=1), notices, folders("notice-offsets"))
    assert rows(notices.read("notice", jobs.NOTICE), "order_id") == [(5,), (6,)]


@pytest.mark.parametrize("files", [1, 4])
def test_cart_job_equals_replay(spark, table, folders, files):
    events = random_events(random.Random(files), 90)
    size = -(-len(events) // files)
    for i in range(0, len(events), size):
        table(EVENT, *events[i:i + size]).coalesce(1).write.mode("append").parquet(folders("events"))
    out = Outcomes(spark, folders("out"))
    stream = (
        spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folders("events"))
    )
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    jobs.cart_job(stream, out, folders("offsets"))
    got = rows(jobs.current_carts(spark, folders("offsets")), "cart_id", "product_id", "quantity", "available_stock", "added_seq")
    assert got == replay(events)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    touched = {r["batch"]: r["carts"] for r in out.read("changed", "cart_id long, lines long").groupBy("batch").agg(F.collect_set("cart_id").alias("carts")).collect()}
    ordered = sorted(events)
    assert len(touched) == files and set(touched[0]) == {e[1] for e in ordered[:size]}


def test_settle_job(spark, table, folders):
    import datetime

    stored = spark.sql(
        """SELECT 1L id, 10L order_id, 100L customer_id, 'PENDING' status, 'sess_1' stripe_session_id,
        CAST(NULL AS BIGINT) item_count, CAST(NULL AS TIMESTAMP_NTZ) updated_at"""
    )
    texts = table("order_id long, page long, pages long, item_offset long, items_json string")
    schema = "event_seq long, ts timestamp_ntz, type string, session_id string, raw string"
    at = datetime.datetime(2024, 1, 1)
    table(
        schema, (1, at, "checkout.session.completed", None, '{"id":"sess_1"}'),
        (2, at, "checkout.session.expired", "sess_1", ""), (3, at, "checkout.session.completed", "sess_9", ""),
    ).coalesce(1).write.parquet(folders("webhooks"))
    out = Outcomes(spark, folders("out"))
    jobs.settle_job(spark.readStream.schema(schema).parquet(folders("webhooks")), stored, texts, out, folders("offsets"))
    assert rows(jobs.current_payments(stored, out), "id", "status") == [(1, "FAILED")]
    for topic, seq in ((schemas.PAYMENT_COMPLETED_TOPIC, 1), (schemas.PAYMENT_FAILED_TOPIC, 2)):
        assert rows(jobs.published_topic(out, topic), "seq", "key") == [(seq, "10")]
    assert rows(out.read(REJECTED, jobs.UNPAID), "event_seq", "error_code") == [(3, 404)]


def test_one_confirmation_per_order(spark, table, folders):
    in_files(table, folders("placed"), [(1, "2", PLACED), (2, "3", '{"orderId":3,"customerId":7,"items":[]}')], 1)
    in_files(table, folders("cancelled"), [(1, "1", '{"orderId":1,"customerId":100}')], 1)
    jobs.notification_job(
        read_topic(spark, folders("placed")), read_topic(spark, folders("cancelled")),
        folders("feed"), folders("offsets"),
    )
    assert rows(spark.read.parquet(folders("feed")), "kind", "order_id", "customer_id") == [
        ("ORDER_CANCELLATION", 1, 100), ("ORDER_CONFIRMATION", 2, 200), ("ORDER_CONFIRMATION", 3, 7),
    ]


@pytest.mark.parametrize("bad", ["not-valid-json", "", None])
def test_notification_job_stops_at_a_bad_payload(spark, table, folders, bad):
    in_files(table, folders("placed"), [(1, "2", bad)], 1)
    in_files(table, folders("cancelled"), [(1, "1", '{"orderId":1,"customerId":100}')], 1)
    with pytest.raises(Exception):
        jobs.notification_job(
            read_topic(spark, folders("placed")), read_topic(spark, folders("cancelled")),
            folders("feed"), folders("offsets"),
        )


def test_cancellations_are_audited_and_move_no_stock(spark, table, folders):
    in_files(table, folders("cancelled"), [(1, "1", '{"orderId":1,"customerId":100}'), (2, "x", "{")], 2)
    out = Outcomes(spark, folders("out"))
    jobs.cancel_audit_job(read_topic(spark, folders("cancelled"), max_files=1), out, folders("offsets"))
    assert rows(out.read("audit", jobs.AUDIT)) == [(1, 100, 0)]
    assert rows(out.malformed()) == [(2, "x", "{")]


def test_payment_notices(spark, table, folders):
    in_files(table, folders("paid"), [paid(1, 5), paid(2, 6, "FAILED"), paid(3, 7, "UNKNOWN"), (4, "", "")], 1)
    out = Outcomes(spark, folders("out"))
    jobs.payment_notice_job(read_topic(spark, folders("paid")), out, folders("offsets"))
    assert rows(out.read("notice", jobs.NOTICE), "kind", "order_id") == [
        ("PAYMENT_CONFIRMATION", 5), ("PAYMENT_FAILED", 6),
    ]
    assert rows(out.malformed(), "seq") == [(4,)]


def test_decoding_splits_bad_payloads(table):
    topic = table(
        "seq long, key string, value string", (1, "", "{}"), (2, "", "not-valid-json"), (3, "", ""),
        (4, "", None), (5, "", '{"orderId":1,"items":[]}'), (6, "", '{"orderId":1,"items":null}'),
    )
    decoded = decode_events(topic, schemas.PAYMENT_EVENT)
    assert rows(decoded.valid, "seq") == [(1,), (5,), (6,)]
    assert rows(decoded.quarantine, "seq") == [(2,), (3,), (4,)]
    assert jobs.payment_lines(topic).count() == 0


def test_start_position(spark, table, folders):
    in_files(table, folders("topic"), [paid(1, 5)], 1)
    assert read_topic(spark, folders("topic"), streaming=False).count() == 1
    with pytest.raises(ValueError):
        read_topic(spark, folders("topic"), start="latest")
    stored = spark.sql("SELECT id, 1L customer_id, 'PENDING' status FROM range(9)")
    late, early = Outcomes(spark, folders("late")), Outcomes(spark, folders("early"))

    def run():
        for group, out in (("order-service", late), ("inventory-service", early)):
            checkpoint = folders(f"offsets-{group}")
            jobs.order_status_job(subscribe(spark, folders("topic"), group, checkpoint), stored, out, checkpoint)

    for seq, order in ((2, 6), (3, 7)):
        run()
        in_files(table, folders("topic"), [paid(seq, order)], 1)
    run()
    done = [rows(jobs.current_orders(stored, out).filter("status = 'PAID'"), "id") for out in (late, early)]
    assert done == [[(6,), (7,)], [(5,), (6,), (7,)]]


def test_decoder_runs_once_per_row(spark, table):
    topic = table("seq long, key string, value string", paid(1, 5), (2, "", "{"))
    decoded = decode_events(topic, schemas.PAYMENT_EVENT)
    for part in decoded:
        assert part.select("*")._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_two_topics_keep_their_order(spark, table, folders):
    """Sequences of two topics overlap; the time of publishing tells which event is the last."""
    stored = spark.sql("SELECT id, 1L customer_id, 'PENDING' status FROM range(3)")
    schema = "seq long, key string, value string, published timestamp"
    import datetime

    def at(minute):
        return datetime.datetime(2024, 1, 1, 0, minute)

    table(schema, (*paid(90, 1), at(1)), (*paid(91, 2), at(5))).coalesce(1).write.parquet(folders("completed"))
    table(schema, (*paid(1, 1, "FAILED"), at(2)), (*paid(2, 2, "FAILED"), at(4))).coalesce(1).write.parquet(folders("failed"))
    out = Outcomes(spark, folders("out"))
    jobs.order_status_job(
        read_topic(spark, folders("completed")), stored, out, folders("offsets"), read_topic(spark, folders("failed"))
    )
    assert rows(jobs.current_orders(stored, out), "id", "status") == [(0, "PENDING"), (1, "CANCELLED"), (2, "PAID")]


def test_failed_topic_cancels_orders_when_fed_in(spark, table, folders):
    stored = spark.sql("SELECT id, 1L customer_id, 'PENDING' status FROM range(3)")
    in_files(table, folders("completed"), [paid(1, 1)], 1)
    in_files(table, folders("failed"), [paid(2, 2, "FAILED")], 1)
    out = Outcomes(spark, folders("out"))
    jobs.order_status_job(
        read_topic(spark, folders("completed")), stored, out, folders("offsets"),
        read_topic(spark, folders("failed")),
    )
    assert rows(jobs.current_orders(stored, out), "id", "status") == [(0, "PENDING"), (1, "PAID"), (2, "CANCELLED")]
