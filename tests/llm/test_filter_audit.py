"""The filter audit against a direct count over all orders."""

from __future__ import annotations

import re
from itertools import permutations

import pytest

from tillspark.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, part string, mask int, good boolean, digest string, id long, n long"
LABELS = "doc_id long, quality int, toxic int, text string, first boolean"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    capitals = len(re.findall("[A-Z]", text))
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * capitals > 3 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
    }


def direct(docs, labels):
    """One pass per order and document, nothing shared."""
    good = {i for i, q, *_ in labels if i is not None and q == 1}
    toxic = {i for i, _, t, *_ in labels if i is not None and t == 1}
    first: dict[str, int] = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    found = {}
    for i, text, lang, *_ in docs:
        text, part = text or "", lang or ""
        failed = fails(text) | {"E": i is not None and i > first[text]}
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, letter in enumerate(order, 1):
                row = found.setdefault((part, order, step), [0] * 6)
                here = failed[letter] and not gone
                row[2] += failed[letter] and gone
                gone |= failed[letter]
                row[0] += not gone
                row[1] += here
                row[3] += failed[letter] and sum(failed.values()) == 1
                row[4] += here and i in good
                row[5] += here and i in toxic
    shapley: dict[tuple, int] = {}
    for (part, order, step), row in found.items():
        key = part, order[step - 1]
        shapley[key] = shapley.get(key, 0) + row[1]
    return {(p, o, s, *map(int, row), shapley[p, o[s - 1]]) for (p, o, s), row in found.items()}


def rows_of():
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", " \n", "ab AB", "x " * 300, long, long, long, long.upper(), long + " #", "été & \x0b fin", long + "\x85#"]
    rows = [(i, t, [None, "", "en", "de"][i % 4]) for i, t in enumerate(texts)]
    return rows + [(5, long, "en"), (5, long, "fr"), (None, long, "en"), (None, "only", None), (40, "only", "en"), (-3, "", "de")]


MARKS = [(i, i % 2, (i + 1) % 2) for i in range(12)] + [(None, 1, 1), (5, None, None), (5, 0, 1), (7, 1, None)]


def collected(df):
    return {tuple(r) for r in df.collect()}


def test_matches_a_direct_count(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, "p", 1, True, "d", 9, 8) for r in rows], SCHEMA)
    marks = spark.createDataFrame([(*m, "t", False) for m in MARKS], LABELS)
    got = filter_audit.audit(docs, marks)
    assert got.count() == 600 * 4
    assert collected(got) == direct(rows, MARKS)


def test_empty_tables(spark):
    docs, marks = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs, marks).collect() == []
    one = spark.createDataFrame([(1, None, None, *[None] * 6)], SCHEMA)
    assert collected(filter_audit.audit(one, marks)) == direct([(1, None, None)], [])


@pytest.mark.parametrize("n", [1, 255, 256, 65_535, 65_536, 10**15])
def test_fields_hold_the_largest_count(n):
    """Every document failing everything: the sums reach n and no field spills into the next."""
    width = (n.bit_length() + 7) // 8
    for mask in range(32):
        fields = filter_audit.unpack(filter_audit.packed(mask, width) * n, width)
        assert fields == [n * bit for bit in filter_audit.outcomes(mask)]


def test_a_part_arrives_as_one_row_per_mask(spark):
    docs = spark.createDataFrame([(i, "same text", "en") for i in range(5000)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], LABELS)
    masks = filter_audit.document_masks(docs, marks)
    assert masks.groupBy("part", "mask", "good", "toxic").count().count() == 2
    got = {r["step"]: r for r in filter_audit.audit(docs, marks).filter("filter_order = 'EABCD'").collect()}
    assert (got[1]["removed"], got[1]["kept"], got[2]["removed"], got[2]["redundant"]) == (4999, 1, 1, 4999)
