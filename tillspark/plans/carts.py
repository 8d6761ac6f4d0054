"""Cart queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillspark.functions.pages import PAGE_ITEMS
from tillspark.functions.positions import largest_id
from tillspark.operators import cart, orders
from tillspark.plans.orders import AS_OF
from tillspark.plans.registry import query
from tillspark.sources.standins import Tables

_MERGED = """lines AS (SELECT cart_id, product_id, sum(quantity) AS quantity,
    min_by(available_stock, seq) AS available_stock, min(seq) AS added_seq
  FROM cart_events WHERE action = 'add' GROUP BY cart_id, product_id)"""


def _adds(t: Tables) -> DataFrame:
    return t.cart_events.filter("action = 'add'")


def _priced(t: Tables) -> DataFrame:
    """Priced lines of the replayed carts."""
    return cart.priced_lines(cart.cart_fold(t.cart_events), t.products)


@query(
    "cart_line_merge",
    f"WITH {_MERGED} SELECT cart_id, product_id, CAST(quantity AS BIGINT) AS quantity, available_stock, added_seq FROM lines",
)
def cart_line_merge(t: Tables) -> DataFrame:
    return cart.cart_line_merge(_adds(t))


# A strict replay, event by event: the carts' lines are the list that the
# reduction carries.
FOLD_SQL = """WITH steps AS (
    SELECT cart_id, list({'seq': seq, 'action': action, 'p': product_id, 'q': CAST(quantity AS BIGINT),
      'a': available_stock} ORDER BY seq) AS events
    FROM cart_events GROUP BY cart_id),
  folded AS (SELECT cart_id, list_reduce(
      list_transform(events, lambda e: {'e': e,
        'lines': CAST([] AS STRUCT(p BIGINT, q BIGINT, a INTEGER, s BIGINT)[])}),
      lambda acc, x: {'e': x.e, 'lines': CASE
        WHEN x.e.action = 'clear' THEN CAST([] AS STRUCT(p BIGINT, q BIGINT, a INTEGER, s BIGINT)[])
        WHEN x.e.action = 'remove' OR (x.e.action = 'set' AND x.e.q <= 0)
          THEN list_filter(acc.lines, lambda l: l.p <> x.e.p)
        WHEN x.e.action = 'set' THEN list_transform(acc.lines, lambda l: {'p': l.p,
          'q': CASE WHEN l.p = x.e.p AND NOT (x.e.q > l.a AND x.e.q > l.q) THEN x.e.q ELSE l.q END,
          'a': l.a, 's': l.s})
        WHEN len(list_filter(acc.lines, lambda l: l.p = x.e.p)) > 0
          THEN list_transform(acc.lines, lambda l: {'p': l.p,
            'q': CASE WHEN l.p = x.e.p THEN l.q + x.e.q ELSE l.q END, 'a': l.a, 's': l.s})
        ELSE list_append(acc.lines, {'p': x.e.p, 'q': x.e.q, 'a': x.e.a, 's': x.e.seq}) END},
      {'e': events[1], 'lines': CAST([] AS STRUCT(p BIGINT, q BIGINT, a INTEGER, s BIGINT)[])}) AS state
    FROM steps)
  SELECT cart_id, l.p AS product_id, l.q AS quantity, l.a AS available_stock, l.s AS added_seq
  FROM (SELECT cart_id, unnest(state.lines) AS l FROM folded)"""


_FOLDED = f"""lines AS ({FOLD_SQL}),
  priced AS (SELECT l.product_id, l.cart_id, l.quantity, l.available_stock, l.added_seq, p.name, p.price
    FROM lines l JOIN products p ON p.id = l.product_id)"""


@query("cart_fold", FOLD_SQL)
def cart_fold(t: Tables) -> DataFrame:
    return cart.cart_fold(t.cart_events)


@query(
    "cart_lines_view",
    f"""WITH {_FOLDED} SELECT *, CAST(price * quantity AS DECIMAL(18,2)) AS subtotal,
      quantity > available_stock AS over_stock,
      CASE WHEN quantity > available_stock THEN concat('Only ', CAST(available_stock AS VARCHAR), ' available') END
        AS stock_warning FROM priced""",
)
def cart_lines_view(t: Tables) -> DataFrame:
    return cart.cart_lines_view(_priced(t))


@query(
    "cart_totals",
    f"""WITH {_FOLDED} SELECT cart_id, CAST(sum(price * quantity) AS DECIMAL(18,2)) AS total
    FROM priced GROUP BY cart_id""",
)
def cart_totals(t: Tables) -> DataFrame:
    return cart.cart_totals(_priced(t))


@query(
    "cart_item_counts",
    f"WITH {_FOLDED} SELECT cart_id, CAST(sum(quantity) AS BIGINT) AS item_count FROM lines GROUP BY cart_id",
)
def cart_item_counts(t: Tables) -> DataFrame:
    return cart.cart_item_counts(cart.cart_fold(t.cart_events))


_GATE = """gate AS (SELECT cart_id, NOT bool_or(quantity > available_stock) AS passes,
    min_by(product_id, added_seq) FILTER (WHERE quantity > available_stock) AS first_product_id,
    min_by(concat('Not enough stock for "', name, '". Only ', CAST(available_stock AS VARCHAR), ' available.'),
      added_seq) FILTER (WHERE quantity > available_stock) AS message
  FROM priced GROUP BY cart_id)"""


@query("stock_gate", f"WITH {_FOLDED}, {_GATE} SELECT * FROM gate")
def stock_gate(t: Tables) -> DataFrame:
    return cart.stock_gate(_priced(t))


_PLACED = "placed AS (SELECT *, row_number() OVER (PARTITION BY cart_id ORDER BY added_seq) AS item_pos FROM priced)"
_LINES = "item_pos, product_id, CAST(quantity AS INT) AS quantity, price AS unit_price"


_ENTRY = """concat('{{"product_id":', CAST(product_id AS VARCHAR), ',"quantity":', CAST(quantity AS VARCHAR){0}, '}}')"""
_PRICE = """, ',"unit_price":', CAST(price AS VARCHAR)"""


def _listed(entry: str) -> str:
    """The carts' item lists in pages."""
    return f"""paged AS (SELECT *, (item_pos - 1) // {PAGE_ITEMS} AS page, count(*) OVER (PARTITION BY cart_id) AS n FROM placed),
  listed AS (SELECT cart_id, page, (any_value(n) + {PAGE_ITEMS} - 1) // {PAGE_ITEMS} AS pages, page * {PAGE_ITEMS} AS item_offset,
    concat('[', string_agg({entry}, ',' ORDER BY item_pos), ']') AS items FROM paged GROUP BY cart_id, page)"""


@query(
    "order_request_items",
    f"""WITH {_FOLDED}, {_PLACED}, {_listed(_ENTRY.format(_PRICE))}
    SELECT cart_id, page, pages, item_offset, items FROM listed""",
)
def order_request_items(t: Tables) -> DataFrame:
    lists = cart.order_request_lists(cart.order_request_items(_priced(t)))
    return lists.withColumn("items", F.to_json("items"))


@query(
    "checkout_requests",
    f"""WITH {_FOLDED}, {_GATE}, {_PLACED} SELECT cart_id, cart_id AS customer_id, {_LINES}
    FROM placed WHERE cart_id IN (SELECT cart_id FROM gate WHERE passes)""",
)
def checkout_requests(t: Tables) -> DataFrame:
    """Requests of the replayed carts whose lines are all in stock."""
    made = cart.checkout_requests(_priced(t))
    return made.requests.join(made.lines, "cart_id")


def _payment_requests(t: Tables) -> cart.PaymentRequests:
    """Carts to orders to payment requests."""
    lines = cart.order_request_items(_priced(t))
    heads = lines.select("cart_id", F.col("cart_id").alias("customer_id")).distinct()
    made = orders.new_order_rows(heads, lines, F.lit(AS_OF), largest_id(t.orders_t, "id"), "cart_id")
    return cart.payment_request(made.orders, made.items)


_CART_ORDERS = """requests AS (SELECT cart_id, (SELECT max(id) FROM orders_t) + row_number() OVER (ORDER BY cart_id) AS order_id,
    CAST(sum(price * quantity) AS DECIMAL(18,2)) AS amount FROM placed GROUP BY cart_id)"""


@query(
    "payment_request",
    f"""WITH {_FOLDED}, {_PLACED}, {_CART_ORDERS}, {_listed(_ENTRY.format(""))}
    SELECT order_id, r.cart_id AS customer_id, amount, coalesce(page, 0) AS page, coalesce(pages, 1) AS pages,
      coalesce(item_offset, 0) AS item_offset, coalesce(items, '[]') AS items
    FROM requests r LEFT JOIN listed l ON l.cart_id = r.cart_id""",
)
def payment_request(t: Tables) -> DataFrame:
    return _payment_requests(t).nested().withColumn("items", F.to_json("items"))


@query(
    "payment_request_items",
    f"""WITH {_FOLDED}, {_PLACED}, {_CART_ORDERS} SELECT order_id, item_pos, product_id, CAST(quantity AS INT) AS quantity
    FROM requests JOIN placed USING (cart_id)""",
)
def payment_request_items(t: Tables) -> DataFrame:
    return _payment_requests(t).items
