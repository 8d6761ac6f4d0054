"""Stock ledger queries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillspark.operators.ledger import stock_ledger
from tillspark.plans.registry import query
from tillspark.sources.standins import Tables


def ledger_sql(coupled: bool, select: str, items: str = "order_items") -> str:
    """A strict replay, line by line, as one list reduction.

    The state is the quantity of every product, the event that failed last
    and a number per line: -1 skipped, -2 no stock row, otherwise the
    quantity times 4 plus 1 applied, 2 refilled, 3 insufficient.
    """
    stop = "b.x.ev" if coupled else "a.stop"
    return f"""WITH ordered AS (
      SELECT o.order_id AS event_seq, o.item_pos, o.product_id, o.quantity, i.id IS NULL AS missing,
        CAST(i.reserved AS BIGINT) AS reserved,
        row_number() OVER (ORDER BY o.order_id, o.item_pos) AS n
      FROM {items} o LEFT JOIN inventory i USING (product_id)),
    stock AS (
      SELECT list(CAST(coalesce(i.quantity, 0) AS BIGINT) ORDER BY p.id) AS q, min(p.id) AS base
      FROM products p LEFT JOIN inventory i ON i.product_id = p.id),
    steps AS (
      SELECT list({{'ev': event_seq, 'i': CAST(product_id - base + 1 AS INT), 'd': CAST(quantity AS BIGINT),
        'r': reserved, 'm': missing}} ORDER BY n) AS l FROM ordered, stock),
    replay AS (
      SELECT list_reduce(
        list_transform(l, lambda x: {{'x': x, 'q': CAST([] AS BIGINT[]), 'stop': CAST(-1 AS BIGINT),
          'out': CAST([] AS BIGINT[])}}),
        lambda a, b: CASE
          WHEN a.stop = b.x.ev THEN {{'x': b.x, 'q': a.q, 'stop': a.stop, 'out': list_append(a.out, -1)}}
          WHEN b.x.m THEN {{'x': b.x, 'q': a.q, 'stop': {stop}, 'out': list_append(a.out, -2)}}
          WHEN a.q[b.x.i] - b.x.r < b.x.d
            THEN {{'x': b.x, 'q': a.q, 'stop': {stop}, 'out': list_append(a.out, a.q[b.x.i] * 4 + 3)}}
          WHEN a.q[b.x.i] - b.x.d <= 0 THEN {{'x': b.x,
            'q': list_transform(a.q, lambda v, k: CASE WHEN k = b.x.i THEN 10 ELSE v END),
            'stop': a.stop, 'out': list_append(a.out, 42)}}
          ELSE {{'x': b.x,
            'q': list_transform(a.q, lambda v, k: CASE WHEN k = b.x.i THEN v - b.x.d ELSE v END),
            'stop': a.stop, 'out': list_append(a.out, (a.q[b.x.i] - b.x.d) * 4 + 1)}} END,
        {{'x': l[1], 'q': q, 'stop': CAST(-1 AS BIGINT), 'out': CAST([] AS BIGINT[])}}) AS state
      FROM steps, stock),
    outcomes AS (
      SELECT unnest(state.out) AS code, generate_subscripts(state.out, 1) AS n FROM replay),
    after AS (
      SELECT unnest(state.q) AS quantity, generate_subscripts(state.q, 1) - 1 + base AS product_id
      FROM replay, stock)
    {select}"""


LINES_SQL = """SELECT o.event_seq, o.item_pos, o.product_id, o.quantity,
  CASE WHEN c.code = -1 THEN 'SKIPPED' WHEN c.code = -2 THEN 'NOT_FOUND' WHEN c.code % 4 = 1 THEN 'APPLIED'
    WHEN c.code % 4 = 2 THEN 'REFILLED' ELSE 'INSUFFICIENT' END AS outcome,
  CASE WHEN c.code >= 0 THEN c.code // 4 END AS stock_after
  FROM ordered o JOIN outcomes c USING (n)"""
_AFTER = """SELECT i.id, i.product_id, CAST(a.quantity AS INT) AS quantity, i.reserved
  FROM inventory i JOIN after a USING (product_id)"""
INVENTORY_SQL = ledger_sql(True, _AFTER)


@query("stock_ledger", ledger_sql(True, LINES_SQL))
def ledger_lines(t: Tables) -> DataFrame:
    return stock_ledger(t.inventory, t.ledger_lines).lines


@query("stock_ledger_inventory", INVENTORY_SQL)
def ledger_inventory(t: Tables) -> DataFrame:
    return stock_ledger(t.inventory, t.ledger_lines).inventory


@query("stock_ledger_independent", ledger_sql(False, LINES_SQL))
def independent_lines(t: Tables) -> DataFrame:
    return stock_ledger(t.inventory, t.ledger_lines, mode="independent").lines
