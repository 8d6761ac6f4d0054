from __future__ import annotations

from decimal import Decimal

from conftest import rows

from tillspark.operators.binding import PRODUCT_REQUEST, STATUS_REQUEST, bind_requests


def test_product_bodies(table):
    bodies = table(
        "request_id long, body string",
        (1, '{"name":"Deck","brand":"B","category":"DECK","price":12.5,"width":8.25,"extra":1}'),
        (2, '{"name":"Deck","category":"deck","price":"cheap"}'),
        (3, "{broken"), (4, None), (5, "[1]"), (6, "{}"), (7, '{"category":null,"price":null}'), (8, ""), (9, '"text"'),
    )
    bound = bind_requests(bodies, PRODUCT_REQUEST)
    assert rows(bound.valid, "request_id", "name", "category", "price", "width") == [
        (1, "Deck", "DECK", Decimal("12.50"), 8.25), (6, None, None, None, None), (7, None, None, None, None),
    ]
    errors = {r["request_id"]: (r["errors"], r["error_code"]) for r in bound.rejects.collect()}
    unread = ({"body": "Malformed request body"}, 400)
    assert errors == {
        2: ({"category": "Not valid: deck", "price": "Not valid: cheap"}, 400), 3: unread, 4: unread, 5: unread, 8: unread, 9: unread,
    }


def test_statuses(table):
    bodies = table(
        "seq long, body string", (1, '{"orderId":5,"status":"PAID"}'), (2, '{"orderId":6,"status":"LOST"}'), (3, '{"orderId":"x","status":"PAID"}'),
    )
    bound = bind_requests(bodies, STATUS_REQUEST)
    assert rows(bound.valid) == [(1, 5, "PAID")]
    assert sorted(r["errors"].popitem() for r in bound.rejects.collect()) == [("orderId", "Not valid: x"), ("status", "Not valid: LOST")]
