"""Replay of one sorted block of stock lines, inside a task."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

REFILL = 10  # fixed value: quantity after stock runs out

ROUND_SCHEMA = "event_seq long, item_pos long, product_id long, report string"
FINAL_SCHEMA = (
    "event_seq long, item_pos long, product_id long, quantity int, outcome string, "
    "stock_after long"
)


class StartMap:
    """How one run of lines maps start quantities to end quantities.

    Starts that meet in one quantity stay together from there on, so the
    distinct quantities soon are few: ten at most for stock that refills.
    """

    _FEW = 24  # from here on a list beats an array

    def __init__(self, low: int, high: int) -> None:
        self.low = low
        self.values = np.arange(low, high + 1, dtype=np.int64)
        self.index = np.arange(high - low + 1)
        self.taken = 0  # demand so far
        self.needed = -(1 << 62)  # a start this high never fails nor refills
        self.steps = 0

    def take(self, demand: int, reserved: int) -> None:
        values = self.values
        if len(values) > self._FEW:
            left = values - demand
            values = np.where(left < reserved, values, np.where(left <= 0, REFILL, left))
        else:
            values = [
                v if v - demand < reserved else v - demand if v > demand else REFILL
                for v in values
            ]
        self.values = values
        self.taken += demand
        self.needed = max(self.needed, self.taken + max(reserved, 1))
        self.steps += 1
        if self.steps % 64 == 0 and len(values) > 1:
            self._merge()

    def _merge(self) -> None:
        distinct, back = np.unique(np.asarray(self.values), return_inverse=True)
        self.index = back[self.index]
        self.values = distinct if len(distinct) > self._FEW else distinct.tolist()

    def ends(self) -> list[int]:
        """End quantity for each start from `low` on."""
        return np.asarray(self.values)[self.index].tolist()


class Link(NamedTuple):
    """A block whose first product began in the block before, or earlier."""

    previous: int
    product: int
    stock: int
    low: int
    high: int
    risky: bool


class Replay(NamedTuple):
    """What a replay task must know about continued blocks (a row per block)."""

    links: dict[int, Link]
    starts: dict[int, int]
    final: bool

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Replay sorted blocks; give failures and reports, or every outcome."""
        before_link = {link.previous for link in self.links.values()}
        product = block = tracked = link = None
        quantity = 0

        def run_ended(block_ended: bool) -> list[tuple]:
            if self.final or product is None:
                return []
            if tracked is not None:
                return [_head_report(block, product, link, tracked, quantity, self.starts)]
            if block_ended and block in before_link:
                # The run began here, and the next block may go on from its end.
                tail = {"block": block, "product": product, "tail": quantity}
                return [(None, None, None, json.dumps(tail))]
            return []

        for batch in batches:
            out = []
            columns = [c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns]
            for event, item, wanted, demand, stock, reserved, here in zip(*columns):
                if wanted != product or here != block:
                    out += run_ended(here != block)
                    link = self.links.get(here) if here != block else None
                    if link is not None and link.product == wanted:
                        quantity = self.starts[here]
                        tracked = None if self.final else StartMap(link.low, link.high)
                    else:
                        quantity, tracked = stock, None
                    product, block = wanted, here
                if tracked is not None:
                    tracked.take(demand, reserved)
                if quantity - reserved < demand:
                    outcome = "INSUFFICIENT"
                elif quantity - demand <= 0:
                    quantity, outcome = REFILL, "REFILLED"
                else:
                    quantity, outcome = quantity - demand, "APPLIED"
                if self.final:
                    out.append((event, item, wanted, demand, outcome, quantity))
                elif outcome == "INSUFFICIENT":
                    out.append((event, item, wanted, None))
            if out:
                yield _batch(out, self.final)
        out = run_ended(True)
        if out:
            yield _batch(out, self.final)


def _head_report(
    block: int, product: int, link: Link, tracked: StartMap, end: int, starts: dict[int, int]
) -> tuple:
    head = {
        "block": block, "product": product, "low": link.low, "ends": tracked.ends(),
        "needed": tracked.needed, "taken": tracked.taken, "assumed": starts[block], "end": end,
    }
    return (None, None, None, json.dumps(head))


def _batch(rows: list[tuple], final: bool) -> pa.RecordBatch:
    if final:
        kinds = {
            "event_seq": pa.int64(), "item_pos": pa.int64(), "product_id": pa.int64(),
            "quantity": pa.int32(), "outcome": pa.string(), "stock_after": pa.int64(),
        }
    else:
        kinds = {
            "event_seq": pa.int64(), "item_pos": pa.int64(), "product_id": pa.int64(),
            "report": pa.string(),
        }
    arrays = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds.values())]
    return pa.RecordBatch.from_arrays(arrays, list(kinds))
