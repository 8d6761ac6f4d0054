"""Table, event and request schemas, and the allowed value sets."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_long, _int, _text = T.LongType(), T.IntegerType(), T.StringType()
_flag, _double, _time = T.BooleanType(), T.DoubleType(), T.TimestampNTZType()

PRODUCTS = _table(
    id=_long, name=_text, brand=_text, category=_text, price=MONEY,
    description=_text, image_url=_text, width=_double, active=_flag,
)
INVENTORY = _table(id=_long, product_id=_long, quantity=_int, reserved=_int)
ORDERS = _table(
    id=_long, customer_id=_long, status=_text, total_amount=MONEY, created_at=_time,
)
ORDER_ITEMS = _table(
    id=_long, order_id=_long, product_id=_long, quantity=_int, unit_price=MONEY,
)
PAYMENTS = _table(
    id=_long, order_id=_long, customer_id=_long, amount=MONEY, status=_text,
    stripe_session_id=_text, stripe_payment_intent_id=_text, item_count=_long,
    created_at=_time, updated_at=_time,
)

# Columns that may not be null in storage, per table.
REQUIRED = {
    "products": ["name", "brand", "category", "price", "active"],
    "inventory": ["product_id", "quantity", "reserved"],
    "orders": ["customer_id", "status", "total_amount", "created_at"],
    "order_items": ["order_id", "product_id", "quantity", "unit_price"],
    "payments": ["order_id", "customer_id", "amount", "status", "created_at"],
}

# Allowed names of the three enumerations.
CATEGORIES = ("DECK", "TRUCKS", "WHEELS")
ORDER_STATUSES = ("PENDING", "PAID", "SHIPPED", "DELIVERED", "CANCELLED")
PAYMENT_STATUSES = ("PENDING", "COMPLETED", "FAILED", "REFUNDED")

# Event payloads, bound by these names in JSON. An event too long for one
# message comes in pages, see functions/pages.py.
PLACE = {"eventSeq": _long, "page": _long, "pages": _long, "itemOffset": _long}
ITEM_QUANTITY = _table(productId=_long, quantity=_int)
ITEM_PRICED = _table(productId=_long, quantity=_int, unitPrice=MONEY)
ORDER_PLACED = _table(
    orderId=_long, customerId=_long, totalAmount=MONEY, items=T.ArrayType(ITEM_PRICED),
    **PLACE,
)
ORDER_CANCELLED = _table(orderId=_long, customerId=_long)
PAYMENT_EVENT = _table(
    orderId=_long, customerId=_long, sessionId=_text, status=_text,
    items=T.ArrayType(ITEM_QUANTITY), **PLACE,
)

# Topic rows: `seq` is the total order of the topic (the offset in a deployment).
TOPIC = _table(seq=_long, key=_text, value=_text)
# As a folder holds them; the time may be missing.
PUBLISHED_TOPIC = T.StructType([*TOPIC.fields, T.StructField("published", T.TimestampType())])

# Topic names.
ORDER_PLACED_TOPIC = "order-placed"
ORDER_CANCELLED_TOPIC = "order-cancelled"
PAYMENT_COMPLETED_TOPIC = "payment-completed"
PAYMENT_FAILED_TOPIC = "payment-failed"
