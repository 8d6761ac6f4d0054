from __future__ import annotations

import random

import pytest
from conftest import rows

from tillspark.operators import ledger

STOCK = "id long, product_id long, quantity int, reserved int"
LINE = "event_seq long, item_pos long, product_id long, quantity int"


def strict(stock, lines, coupled=True):
    """Line after line, as one listener would."""
    held = {p: [q, r] for _, p, q, r in stock}
    stopped, out = set(), []
    for event, item, product, wanted in sorted(lines, key=lambda x: x[:2]):
        after = None
        if coupled and event in stopped:
            outcome = "SKIPPED"
        elif product not in held:
            outcome = "NOT_FOUND"
        elif wanted is None:
            outcome = "NO_QUANTITY"
        else:
            quantity, reserved = held[product]
            if quantity - reserved < wanted:
                outcome, after = "INSUFFICIENT", quantity
            else:
                after, outcome = quantity - wanted, "APPLIED"
                if after <= 0:
                    after, outcome = 10, "REFILLED"
                held[product][0] = after
        if outcome in ("NOT_FOUND", "NO_QUANTITY", "INSUFFICIENT"):
            stopped.add(event)
        out.append((event, item, outcome, after))
    return sorted(out, key=lambda x: x[:2]), sorted((p, q) for p, (q, _) in held.items())


def replayed(table, stock, lines, **options):
    result = ledger.stock_ledger(table(STOCK, *stock), table(LINE, *lines), **options)
    outcomes = [
        (r["event_seq"], r["item_pos"], r["outcome"], r["stock_after"])
        for r in result.lines.collect()
    ]
    return sorted(outcomes, key=lambda x: x[:2]), rows(result.inventory, "product_id", "quantity")


@pytest.mark.parametrize("mode", ["exact", "independent"])
@pytest.mark.parametrize("seed", range(6))
def test_equals_strict_processing(table, seed, mode):
    rnd = random.Random(seed)
    products = rnd.choice([1, 3, 8])
    stock = [
        (p, p, rnd.randint(0, rnd.choice([5, 60, 100_000])), rnd.choice([0, 0, 2, -3]))
        for p in range(products)
    ]
    lines = [
        (event, item, 0 if rnd.random() < 0.4 else rnd.randint(0, products),
         None if rnd.random() < 0.01 else rnd.choice([1, 1, 2, rnd.randint(-1, 30)]))
        for event in range(rnd.choice([5, 60, 150]))
        for item in range(1, rnd.randint(2, 6))
    ]
    got = replayed(table, stock, lines, mode=mode, blocks=rnd.choice([1, 4, 9]))
    assert got == strict(stock, lines, mode == "exact")


def test_one_product_over_many_blocks(table):
    """All ones on a refilling product: the block maps never merge."""
    stock = [(1, 1, 25, 0)]
    lines = [(event, 1, 1, 1) for event in range(400)]
    result = ledger.stock_ledger(table(STOCK, *stock), table(LINE, *lines), blocks=16)
    assert rows(result.inventory, "quantity") == [(strict(stock, lines)[1][0][1],)]
    assert result.rounds <= 4


@pytest.mark.parametrize("start,wanted,left", [(20, 5, 15), (2, 5, 2), (3, 3, 10)])
def test_single_decrease(table, start, wanted, left):
    got = replayed(table, [(1, 10, start, 0)], [(1, 1, 10, wanted)], blocks=2)
    assert got[1] == [(10, left)]


def test_failure_skips_the_rest_of_its_event_only(table):
    stock = [(1, 10, 5, 0), (2, 11, 5, 0)]
    lines = [(1, 1, 10, 2), (1, 2, 99, 1), (1, 3, 11, 1), (2, 1, 11, 1)]
    outcomes, left = replayed(table, stock, lines, blocks=3)
    assert [o[2] for o in outcomes] == ["APPLIED", "NOT_FOUND", "SKIPPED", "APPLIED"]
    assert left == [(10, 3), (11, 4)]


@pytest.mark.parametrize("few", [0, 3, 1_000])
def test_only_a_bounded_number_of_rows_goes_to_all_tasks(table, monkeypatch, few):
    """The lines of a round are not shuffled for few products or events, and results stay."""
    rnd = random.Random(4)
    stock = [(p, p, rnd.randint(5, 60), 0) for p in range(6)]
    lines = [(e, i, rnd.randint(0, 6), rnd.randint(1, 30)) for e in range(80) for i in range(1, 4)]
    sent = []
    broadcast = ledger.F.broadcast
    monkeypatch.setattr(ledger, "FEW_ROWS", few)
    monkeypatch.setattr(ledger.F, "broadcast", lambda df: sent.append((df.columns, df.count())) or broadcast(df))
    assert replayed(table, stock, lines, blocks=3) == strict(stock, lines)
    events = [n for columns, n in sent if "old_stop" in columns]
    assert max(events, default=0) <= few
    assert few < 1_000 or max(events) > 3


def test_round_limit_fails_loudly(table):
    stock = [(p, p, 1, 0) for p in range(3)]
    lines = [(e, i, (e + i) % 3, 2 + e % 2) for e in range(9) for i in range(1, 4)]
    with pytest.raises(RuntimeError):
        ledger.stock_ledger(table(STOCK, *stock), table(LINE, *lines), blocks=2, max_rounds=0)


def test_no_lines(table):
    got = replayed(table, [(1, 10, 5, 0)], [], blocks=2)
    assert got == ([], [(10, 5)])


def test_blocks_may_share_a_task():
    """One task that gets two blocks reports both, as two tasks would."""
    import json

    import pyarrow as pa

    from tillspark.functions.replay import Link, Replay

    lines = [(e, 1, 1, 2, 9, 0, e // 3) for e in range(6)]
    names = ["event_seq", "item_pos", "product_id", "quantity", "stock", "reserved", "block"]
    links = {1: Link(0, 1, 9, 0, 12, True)}

    def reports(*parts):
        found = []
        for part in parts:
            batch = pa.RecordBatch.from_pylist([dict(zip(names, line)) for line in part])
            for out in Replay(links, {1: 3}, False)(iter([batch])):
                found += [json.loads(r) for r in out.column("report").to_pylist() if r]
        return found

    together, apart = reports(lines), reports(lines[:3], lines[3:])
    assert together == apart and len(together) == 2
    assert together[0]["tail"] == 3
