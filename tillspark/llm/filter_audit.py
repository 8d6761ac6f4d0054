"""How five quality filters overlap, for every order in which they may run."""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tillspark.llm.common import BLANKS
from tillspark.session import materialize

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: What a step can do to a document; each outcome is one field of the packed counter.
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")
AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long,"
    " unique_fails long, good_lost long, toxic_lost long, shapley long"
)


@lru_cache(maxsize=None)
def outcomes(mask: int) -> tuple[int, ...]:
    """For one set of failed filters: a 0 or 1 per (order, step, outcome), 2,400 in all."""
    bits = []
    for order in ORDERS:
        gone = False
        for letter in order:
            fails = bool(mask >> FILTERS.index(letter) & 1)
            now = fails and not gone
            redundant, gone = fails and gone, gone or now
            bits += [not gone, now, redundant, mask == 1 << FILTERS.index(letter)]
    return tuple(map(int, bits))


@lru_cache(maxsize=256)
def packed(mask: int, width: int) -> int:
    """The outcomes of a mask as one integer with a field of `width` bytes for each."""
    return int.from_bytes(b"".join(bit.to_bytes(width, "little") for bit in outcomes(mask)), "little")


def unpack(total: int, width: int) -> list[int]:
    """The fields of a packed sum, in their order."""
    fields = len(ORDERS) * STEPS * len(OUTCOMES)
    data = total.to_bytes(fields * width, "little")
    return [int.from_bytes(data[at:at + width], "little") for at in range(0, len(data), width)]


def audit_part(masks: pd.DataFrame) -> pd.DataFrame:
    """The 600 rows of one part from its documents per (mask, good, toxic).

    A field counts at most the documents of the part, so a width that holds
    their number cannot overflow into the next field.
    """
    width = (int(masks["n"].sum()).bit_length() + 7) // 8
    every = good = toxic = 0
    for mask, is_good, is_toxic, n in zip(masks["mask"], masks["good"], masks["toxic"], masks["n"]):
        weighted = packed(int(mask), width) * int(n)
        every += weighted
        good += weighted if is_good else 0
        toxic += weighted if is_toxic else 0
    every, good, toxic = (unpack(total, width) for total in (every, good, toxic))
    rows, shapley = [], dict.fromkeys(FILTERS, 0)
    for at, (order, step) in enumerate((o, s) for o in ORDERS for s in range(STEPS)):
        low = at * len(OUTCOMES)
        rows.append([masks["part"].iloc[0], order, step + 1, *every[low:low + 4], good[low + 1], toxic[low + 1]])
        shapley[order[step]] += every[low + 1]
    return pd.DataFrame(
        [[*row, shapley[row[1][row[2] - 1]]] for row in rows],
        columns=[c.split()[0] for c in AUDIT.split(", ")],
    )


def text_failures(text: Column) -> Column:
    """Mask of the filters A to D that a text fails (bits 0 to 3)."""
    words = F.array_remove(F.split(F.regexp_replace(text, BLANKS, " "), " "), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(t, F.lit(1 << at)).otherwise(F.lit(0)) for at, t in enumerate(tests)), F.lit(0))


def document_masks(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
) -> DataFrame:
    """One row per document: part, mask of failed filters, good, toxic.

    Equal texts meet by SHA-256. Filter E spares the row whose id is the
    smallest of its text, which a join on (text, id) finds; so a text that
    a third of the rows share is one key per row there and not one key.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(text, 256)).alias("digest"), text_failures(text).alias("mask"),
        ),
        "audit",
    )
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).filter("id IS NOT NULL").withColumn("first", F.lit(True))
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    known = rows.filter("id IS NOT NULL").join(first, ["id", "digest"], "left").join(marks, "id", "left")
    repeated = F.when(F.col("first"), F.lit(0)).otherwise(F.lit(1 << 4))
    no = F.lit(False)
    return known.select(
        "part", (F.col("mask") + repeated).alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")
    ).unionByName(rows.filter("id IS NULL").select("part", "mask", no.alias("good"), no.alias("toxic")))


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
) -> DataFrame:
    """What each filter does at each step of each of the 120 orders, per part.

    Columns part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley; 600 rows per part, zeros
    included. Documents are counted by (part, mask, labels) before anything
    is grouped, so a part arrives as at most 128 rows whatever its size;
    each mask's packed outcomes times its count are summed per part.

    Null texts count as empty (they fail A alone, and E where repeated), a
    null part is the empty string, so it shares that part's rows. A row
    without an id has no smaller or larger one: it never fails E and has no
    label. Rows that repeat an id and a text are counted each, and none is
    smaller than the other. Of several labels of an id any 1 counts. An
    empty table gives an empty result; other columns are ignored.
    """
    masks = document_masks(docs, labels, id_col, text_col, part_col)
    counts = masks.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    return counts.groupBy("part").applyInPandas(audit_part, AUDIT)


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents),
f AS (
  SELECT doc_id, part, body, min(doc_id) OVER (PARTITION BY body) AS first_id,
    regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(words) < 200,
     100 * len(list_distinct(words)) < 50 * len(words),
     100 * length(regexp_replace(body, '[^A-Z]+', '', 'g')) > 3 * length(body),
     regexp_matches(body, '[#$%&*|]'),
     coalesce(f.doc_id > first_id, false)] AS fails
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
orders AS (
  SELECT [a.k, b.k, c.k, e.k, g.k] AS o
  FROM letters a, letters b, letters c, letters e, letters g
  WHERE len(list_distinct([a.k, b.k, c.k, e.k, g.k])) = 5),
steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
grouped AS (
  SELECT part, fails, good, toxic, count(*) AS n FROM m GROUP BY ALL),
seen AS (
  SELECT part, o, step, n, good, toxic, fails[o[step]] AS here,
    len(list_filter(o[1:step - 1], lambda k: fails[k])) > 0 AS before,
    len(list_filter(fails, lambda x: x)) AS n_fails
  FROM grouped, steps),
counted AS (
  SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order,
    step, o[step] AS letter,
    sum(CASE WHEN NOT here AND NOT before THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN here AND NOT before THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN here AND before THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN here AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN here AND NOT before AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN here AND NOT before AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM seen GROUP BY part, o, step)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted
"""
