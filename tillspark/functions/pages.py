"""Events of any length as pages in a topic, and put together again.

A message has a size limit, an order has none. So an event with very many
items is published as several rows of the topic. Each of them carries the
event's sequence, its own page, the number of pages, and the number of items
before it; an event that fits one message carries none of these. Readers
see events and lines and never depend on where pages were cut.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tillspark.functions.codec import encode

#: Items per message; only the transport depends on it.
PAGE_ITEMS = 1_000


def item_pages(lines: DataFrame, key: str, entry: Column, page_items: int = PAGE_ITEMS) -> DataFrame:
    """Lines (key, item_pos from 1 without gaps, ...) to (key, page, pages, item_offset, items).

    Lines are counted per key, and only keys of several pages go on from
    there, so the join is a small one; a key that holds a third of all
    lines is spread over its pages.
    """
    page = F.call_function("div", F.col("item_pos") - 1, F.lit(page_items))
    more = (
        lines.groupBy(key).agg(F.count("*").alias("_lines")).filter(F.col("_lines") > page_items)
        .select(key, F.call_function("div", F.col("_lines") + (page_items - 1), F.lit(page_items)).alias("_pages"))
    )
    listed = F.array_sort(F.collect_list(F.struct("item_pos", entry.alias("entry"))))
    nested = lines.withColumn("page", page).groupBy(key, "page").agg(listed.alias("_lines"))
    more = more.withColumnRenamed(key, "_key")
    return nested.join(more, F.col(key).eqNullSafe(F.col("_key")), "left").select(
        key,
        "page",
        F.coalesce("_pages", F.lit(1)).cast("long").alias("pages"),
        (F.col("page") * page_items).alias("item_offset"),
        F.transform("_lines", lambda line: line["entry"]).alias("items"),
    )


def with_item_pages(
    parents: DataFrame, pages: DataFrame, key: str, childless: DataFrame, column: str = "items"
) -> DataFrame:
    """Each parent once per page of its items; `childless` parents get one empty page.

    Items as text (`column`) are null on an empty page.

    An inner join beside the parents without items in place of an outer
    join, which could not be split where one parent has very many pages.
    """
    kind = pages.schema[column].dataType
    nothing = F.array() if isinstance(kind, T.ArrayType) else F.lit(None)
    bare = childless.select(
        "*",
        F.lit(0).cast("long").alias("page"),
        F.lit(1).cast("long").alias("pages"),
        F.lit(0).cast("long").alias("item_offset"),
        nothing.cast(kind).alias(column),
    )
    return parents.join(pages, key).unionByName(bare)


def encode_page(event_seq: Column, *fields: Column) -> Column:
    """JSON of one page, out of the columns page, pages and item_offset."""
    place = [
        event_seq.cast("long").alias("eventSeq"),
        F.col("page"),
        F.col("pages"),
        F.col("item_offset").alias("itemOffset"),
    ]
    return F.when(F.col("pages") > 1, encode(*fields, *place)).otherwise(encode(*fields))


def with_places(decoded: DataFrame, seq: str = "seq") -> DataFrame:
    """Decoded topic rows with event_seq, page, pages and item_offset."""
    nothing = F.lit(0).cast("long")
    return decoded.select(
        "*",
        F.coalesce("event.eventSeq", seq).alias("event_seq"),
        F.coalesce("event.page", nothing).alias("page"),
        F.coalesce("event.pages", nothing + 1).alias("pages"),
        F.coalesce("event.itemOffset", nothing).alias("item_offset"),
    )


def first_pages(placed: DataFrame) -> DataFrame:
    """One row per event, whichever of its pages are there besides the first."""
    return placed.filter("page = 0")


def event_lines(placed: DataFrame, *fields: Column) -> DataFrame:
    """Lines of the events: event_seq, item_pos over all pages, and fields of `_item`."""
    return placed.select(
        "event_seq", "item_offset", F.posexplode("event.items").alias("_pos", "_item")
    ).select("event_seq", (F.col("item_offset") + F.col("_pos") + 1).alias("item_pos"), *fields)


class Arrived(NamedTuple):
    whole: DataFrame
    waiting: DataFrame


def split_arrived(placed: DataFrame) -> Arrived:
    """Pages of events that are all there, and of those that still wait for some.

    A page that came twice counts and stays once.
    """
    single, several = placed.filter("pages = 1"), placed.filter("pages > 1")
    several = several.dropDuplicates(["event_seq", "page"])
    short = (
        several.groupBy("event_seq").agg(F.count("*").alias("_n"), F.max("pages").alias("_of"))
        .filter("_n < _of").select("event_seq")
    )
    return Arrived(
        single.unionByName(several.join(short, "event_seq", "left_anti")),
        several.join(short, "event_seq", "left_semi"),
    )
