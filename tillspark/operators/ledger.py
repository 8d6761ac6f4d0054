"""The order-dependent stock ledger.

Event lines take stock in event order, and in item order within an event:

* no stock row, or no quantity: the line fails;
* available (quantity - reserved) below the request: the line fails;
* otherwise the request is subtracted, and a quantity of 0 or less is
  set to REFILL;
* after a failed line the rest of its event is skipped.

The skip ties products together, so one pass per product is not enough.
Rounds repeat: replay every product over the lines not skipped, then work
out from the failures which lines are skipped. The earliest line that is
still wrong depends only on lines that are already right, so every round
settles at least one more line, and two equal rounds in a row are exact.

No task holds a whole product. Lines lie in range partitions ("blocks")
over (product, event, item), so a product of any size spreads over blocks.
For a product that goes on from one block into the next, a block replays
from an assumed start quantity and also reports how it maps every small
start quantity to an end. Chaining these maps gives the true starts for
the next round; it ends only when the assumed starts were the true ones.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tillspark.functions import replay
from tillspark.functions.replay import FINAL_SCHEMA, REFILL, ROUND_SCHEMA, Link, Replay
from tillspark.operators.lookups import NOT_FOUND_TEXT
from tillspark.operators.rejects import error_code, error_message
from tillspark.session import materialize, shuffle_width

# Executors need no copy of this package: the replay travels with its job.
cloudpickle.register_pickle_by_value(replay)

INSUFFICIENT_TEXT = "Insufficient stock for product: "  # fixed value
# Start quantities mapped per block. Others are settled by further rounds.
MAP_STATES = 512
# A block has at least LEAST_ROWS lines and about BLOCK_ROWS at most, as long as
# that makes no more than MOST_BLOCKS blocks. The driver sees two short reports
# per block and no lines.
LEAST_ROWS = 10_000
BLOCK_ROWS = 1_000_000
MOST_BLOCKS = 50_000
# So many products or events of a round at most go to all tasks, which spares a shuffle of all lines.
FEW_ROWS = 1_000_000

_LINE = ["event_seq", "item_pos"]


class Ledger(NamedTuple):
    lines: DataFrame
    inventory: DataFrame
    rounds: int


def _end_of(head: dict, start: int) -> int | None:
    """End quantity for a start, or None where the block must be replayed from it."""
    if start == head["assumed"]:
        return head["end"]
    if 0 <= start - head["low"] < len(head["ends"]):
        return head["ends"][start - head["low"]]
    return start - head["taken"] if start >= head["needed"] else None


def _true_starts(
    links: dict[int, Link], assumed: dict[int, int], reports: list[dict], replayed: set[int]
) -> dict[int, int]:
    """Chain the reports of one round into the start quantities they imply.

    Blocks whose product was not replayed keep their start. Where a chain
    breaks (a start that a block has not mapped), the blocks after it keep
    what they assumed; the broken block's own start differs from its
    assumption, so a further round follows.
    """
    tails = {(r["block"], r["product"]): r["tail"] for r in reports if "tail" in r}
    heads = {r["block"]: r for r in reports if "ends" in r}
    starts: dict[int, int] = {}
    for block in sorted(links):
        link = links[block]
        before = links.get(link.previous)
        if link.product not in replayed:
            start = assumed[block]
        elif before is not None and before.product == link.product:
            start = starts[link.previous]
            if link.previous in heads:  # otherwise all its lines are skipped
                start = _end_of(heads[link.previous], start)
        else:
            start = tails.get((link.previous, link.product), link.stock)
        starts[block] = assumed[block] if start is None else start
    return starts


def _demand(inventory: DataFrame, lines: DataFrame) -> DataFrame:
    """Per requested product: its lines, its stock row, and whether it may fail.

    `risky` marks products whose whole demand may exceed their stock; the
    others can never fail, so the rounds leave them out.
    """
    wanted = lines.groupBy("product_id").agg(
        F.count("*").alias("lines"),
        F.sum(F.greatest(F.col("quantity"), F.lit(0))).alias("wanted"),
    )
    stock = inventory.select(
        "product_id",
        F.col("quantity").cast("long").alias("stock"),
        F.col("reserved").cast("long").alias("reserved"),
    )
    risky = F.col("wanted") > F.col("stock") - F.col("reserved")
    return materialize(
        wanted.join(stock, "product_id", "left").select(
            "product_id", "lines", "stock", "reserved", risky.alias("risky")
        ),
        "ledger-demand",
    )


def _lay_out(demand: DataFrame, lines: DataFrame, blocks: int) -> DataFrame:
    """Lines with their stock row, in even blocks over (product, event, item).

    Lines that can fail, that cannot, and that have no stock row or quantity
    lie in folders of their own, so that the rounds read the first alone.
    """
    joined = lines.select(*_LINE, "product_id", "quantity").join(
        demand.drop("lines"), "product_id", "left"
    )
    usable = F.col("stock").isNotNull() & F.col("quantity").isNotNull()
    kind = (
        F.when(~usable, F.lit("unusable"))
        .when(F.col("risky"), F.lit("risky"))
        .otherwise(F.lit("safe"))
    )
    return materialize(
        joined.withColumn("kind", kind)
        .repartitionByRange(blocks, "product_id", *_LINE)
        .withColumn("block", F.spark_partition_id()),
        "ledger-lines",
        ["kind"],
    )


def _links(lines: DataFrame) -> dict[int, Link]:
    """The continued blocks. One row per block reaches the driver."""
    edges = (
        lines.groupBy("block")
        .agg(
            F.min("product_id").alias("first"),
            F.max("product_id").alias("last"),
            F.min_by(F.struct("stock", "reserved", "risky"), F.col("product_id")).alias("head"),
            F.max("quantity").alias("largest"),
        )
        .orderBy("block")
        .collect()
    )
    links = {}
    for before, edge in zip(edges, edges[1:]):
        if edge["first"] == before["last"]:
            stock, reserved = edge["head"]["stock"], edge["head"]["reserved"]
            low = min(stock, reserved, 1)
            high = max(REFILL, edge["largest"] + reserved)
            links[edge["block"]] = Link(
                before["block"], edge["first"], stock, low, min(high, low + MAP_STATES - 1),
                edge["head"]["risky"],
            )
    return links


def _not_skipped(lines: DataFrame, stops: DataFrame) -> DataFrame:
    """Lines up to and including the first failure of their event."""
    return lines.join(stops, "event_seq", "left").filter(
        F.col("stop").isNull() | (F.col("item_pos") <= F.col("stop"))
    )


def _replayed(lines: DataFrame, blocks: int, replayer: Replay) -> DataFrame:
    columns = [*_LINE, "product_id", "quantity", "stock", "reserved", "block"]
    return (
        lines.select(*columns)
        .repartitionById(blocks, F.col("block"))
        .sortWithinPartitions("product_id", *_LINE)
        .mapInArrow(replayer, FINAL_SCHEMA if replayer.final else ROUND_SCHEMA)
    )


class _Rounds:
    """The state of the repeated rounds."""

    def __init__(
        self, lines: DataFrame, known_failures: DataFrame, blocks: int, max_rounds: int | None
    ) -> None:
        self.lines = lines
        self.known_failures = known_failures
        self.blocks = blocks
        self.max_rounds = max_rounds
        self.links = _links(lines)
        self.starts = {block: link.stock for block, link in self.links.items()}
        self.stops = materialize(_first_failures(known_failures), "ledger-stops")
        self.count = 0

    def _replay(
        self, lines: DataFrame, replayed: set[int], kept: DataFrame | None = None
    ) -> tuple[DataFrame, set[int]]:
        """Replay lines once.

        Gives the failures, with the kept ones of other products, and the
        products whose block starts moved.
        """
        self.count += 1
        if self.max_rounds is not None and self.count > self.max_rounds:
            raise RuntimeError(f"stock ledger not settled after {self.max_rounds} rounds")
        replayer = Replay(self.links, self.starts, False)
        out = _replayed(lines, self.blocks, replayer)
        if kept is not None:
            out = out.unionByName(kept, allowMissingColumns=True)
        out = materialize(out, "ledger-round")
        reports = []
        if replayed:
            # At most two rows per block, each of at most MAP_STATES numbers.
            rows = out.filter(F.col("report").isNotNull()).select("report").collect()
            reports = [json.loads(row["report"]) for row in rows]
        implied = _true_starts(self.links, self.starts, reports, replayed)
        moved = {
            link.product for block, link in self.links.items() if implied[block] != self.starts[block]
        }
        self.starts = implied
        return out.filter(F.col("report").isNull()).drop("report"), moved

    def _products(self, products: set[int]) -> DataFrame:
        """A few split products (at most one per block) as a table."""
        rows = [(product,) for product in sorted(products)]
        return self.lines.sparkSession.createDataFrame(rows, "product_id long")

    def settle_starts(self, products: set[int], coupled: bool) -> None:
        """Chain the blocks of split products whose skipped lines are settled."""
        while products:
            lines = self.lines.join(F.broadcast(self._products(products)), "product_id", "left_semi")
            active = _not_skipped(lines, self.stops) if coupled else lines
            products = self._replay(active, products)[1]

    def settle(self) -> None:
        """Replay risky products until neither skipped lines nor starts change.

        After the first round only products are replayed that have a line
        whose skip has changed, or whose block starts moved.
        """
        risky = self.lines.filter("kind = 'risky'")
        split = {link.product for link in self.links.values() if link.risky}
        replayed, affected, failures = split, None, None
        while True:
            lines = risky
            if affected is not None:
                lines = risky.join(affected, "product_id", "left_semi")
            kept = None
            if failures is not None:
                kept = failures.join(affected, "product_id", "left_anti")
            failures, moved = self._replay(_not_skipped(lines, self.stops), replayed, kept)
            fresh = _first_failures(failures.select(*_LINE).unionByName(self.known_failures))
            old = self.stops.withColumnRenamed("stop", "old_stop")
            compared = materialize(fresh.join(old, "event_seq", "full"), "ledger-stops")
            self.stops = compared.filter(F.col("stop").isNotNull()).select("event_seq", "stop")
            changed = compared.filter(~F.col("stop").eqNullSafe(F.col("old_stop")))
            changed = _sent(changed, changed.count())

            def skipped(stop: str) -> Column:
                return F.coalesce(F.col("item_pos") > F.col(stop), F.lit(False))

            flipped = (
                risky.select(*_LINE, "product_id")
                .join(changed, "event_seq")
                .filter(skipped("stop") != skipped("old_stop"))
                .select("product_id")
            )
            if moved:
                flipped = flipped.unionByName(self._products(moved))
            affected = materialize(flipped.distinct(), "ledger-affected")
            found = affected.join(
                F.broadcast(self._products(split).withColumn("split", F.col("product_id"))),
                "product_id",
                "left",
            ).agg(F.count("*").alias("products"), F.collect_set("split").alias("split"))
            summary = found.first()  # of split products, at most one per block
            if not summary["products"]:
                return
            affected = _sent(affected, summary["products"])
            replayed = set(summary["split"])


def _sent(few: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(few) if rows <= FEW_ROWS else few


def _first_failures(failures: DataFrame) -> DataFrame:
    """Where each event stops."""
    return failures.groupBy("event_seq").agg(F.min("item_pos").alias("stop"))


def ledger_rejects(lines: DataFrame) -> DataFrame:
    """The failed lines of a ledger with error code and message."""
    product = F.col("product_id").cast("string")
    short = F.concat(F.lit(INSUFFICIENT_TEXT), product)
    missing = F.concat(F.lit(NOT_FOUND_TEXT["inventory"]), product)
    reason = (
        F.when(F.col("outcome") == "INSUFFICIENT", F.lit("CONFLICT"))
        .when(F.col("outcome") == "NOT_FOUND", F.lit("NOT_FOUND"))
        .when(F.col("outcome") == "NO_QUANTITY", F.lit("INTERNAL"))
    )
    failed = lines.withColumn("_reason", reason).filter(F.col("_reason").isNotNull())
    detail = F.when(F.col("_reason") == "CONFLICT", short).otherwise(missing)
    return failed.select(
        *_LINE,
        "product_id",
        "quantity",
        error_code("_reason").alias("error_code"),
        error_message(F.col("_reason"), detail).alias("message"),
    )


def _block_count(lines: int, width: int) -> int:
    wide = max(width, min(-(-lines // BLOCK_ROWS), MOST_BLOCKS))
    return max(1, min(wide, lines // LEAST_ROWS))


def stock_ledger(
    inventory: DataFrame,
    lines: DataFrame,
    mode: str = "exact",
    blocks: int | None = None,
    max_rounds: int | None = None,
) -> Ledger:
    """Replay event lines (event_seq, item_pos, product_id, quantity) on stock.

    `mode="independent"` lets a failed line not skip the rest of its
    event; it needs fewer rounds and differs from the shop's behaviour.
    `max_rounds` stops with an error and never with an unsettled result;
    without it the rounds end by themselves.
    """
    if mode not in ("exact", "independent"):
        raise ValueError(f"unknown mode: {mode}")
    coupled = mode == "exact"
    spark = lines.sparkSession
    demand = _demand(inventory, lines)
    if blocks is None:
        total = demand.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("n")).first()["n"]
        blocks = _block_count(total, shuffle_width(spark))
    laid = _lay_out(demand, lines, blocks)
    usable, unusable = laid.filter("kind <> 'unusable'"), laid.filter("kind = 'unusable'")
    rounds = _Rounds(usable, unusable.select(*_LINE), blocks, max_rounds)
    if coupled:
        rounds.settle()
    unsettled = {link.product for link in rounds.links.values() if not (coupled and link.risky)}
    rounds.settle_starts(unsettled, coupled)
    stops = rounds.stops

    active = _not_skipped(usable, stops) if coupled else usable
    taken = materialize(
        _replayed(active, blocks, Replay(rounds.links, rounds.starts, True)), "ledger-taken"
    )
    no_stock = F.lit(None).cast("long").alias("stock_after")
    columns = [*_LINE, "product_id", "quantity"]
    reason = F.when(F.col("stock").isNull(), F.lit("NOT_FOUND")).otherwise(F.lit("NO_QUANTITY"))
    reached = _not_skipped(unusable, stops) if coupled else unusable
    outcomes = taken.unionByName(reached.select(*columns, reason.alias("outcome"), no_stock))
    if coupled:
        skipped = laid.join(stops, "event_seq").filter(F.col("item_pos") > F.col("stop"))
        outcomes = outcomes.unionByName(
            skipped.select(*columns, F.lit("SKIPPED").alias("outcome"), no_stock)
        )
    last = taken.groupBy("product_id").agg(
        F.max_by("stock_after", F.struct(*_LINE)).alias("_after")
    )
    after = inventory.join(last, "product_id", "left").select(
        *[
            F.coalesce(F.col("_after").cast("int"), F.col("quantity")).alias(c)
            if c == "quantity"
            else F.col(c)
            for c in inventory.columns
        ]
    )
    return Ledger(outcomes, after, rounds.count)
