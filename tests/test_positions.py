from __future__ import annotations

import random

import pytest
from conftest import rows

from tillspark.functions.positions import assign_ids, row_positions


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_ids_follow_the_key_without_gaps(table, parts):
    values = random.Random(parts).sample(range(10_000), 500)
    numbered = assign_ids(table("v long", *[(v,) for v in values]), ["v"], "id", 7, parts)
    assert rows(numbered, "v", "id") == [(v, 8 + i) for i, v in enumerate(sorted(values))]


def test_hot_keys_get_the_same_positions(table):
    rnd = random.Random(1)
    data = [(0 if rnd.random() < 0.5 else rnd.randint(1, 40), v) for v in rnd.sample(range(9_999), 600)]
    df = table("k long, v long", *data)
    plain, hot = (row_positions(df, "k", ["v"], "pos", n) for n in (10_000, 20))
    assert rows(plain, "k", "v", "pos") == rows(hot, "k", "v", "pos")


def test_no_rows(table):
    assert assign_ids(table("v long"), ["v"]).count() == 0
