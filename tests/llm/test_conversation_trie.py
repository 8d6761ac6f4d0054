"""The conversation trie against a dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from tillspark.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, words string, depth int, key binary, n_convs long"


def brute(sequences):
    """Nodes of all prefixes of {conv: [(word, size), ...]}."""
    nodes: dict[tuple, list] = {}
    for conv, seq in sequences.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(conv)
    out = set()
    for path, members in nodes.items():
        below = {p: m for p, m in nodes.items() if p[:len(path)] == path}
        kids = [p for p in nodes if len(p) == len(path) + 1 and p[:len(path)] == path]
        ends = sorted(c for c in members if len(sequences[c]) == len(path))
        out.add((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids),
            sum(1 for p in below if not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in below)),
            sum((len(m) - 1) * p[-1][1] for p, m in below.items() if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


def rebuilt(rows):
    """Sequences of (role, text) and its length, heads taken over."""
    own: dict[int, list] = {}
    for conv, turn, role, text in sorted(
        (r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)
    ):
        own.setdefault(conv, []).append(((role or "", text or ""), len(text or "")))
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        out[conv] = own.get(conv - conv % 100, [])[:h] + turns[h:]
    return out


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


def same(df, expected):
    assert collected(df) == sorted(expected, key=str)


@pytest.mark.parametrize("shards", [1, 3, 17])
def test_shards_of_random_sequences(spark, shards):
    rng = random.Random(shards)
    sequences = {}
    for conv in range(220):
        if conv % 3 == 0:  # one group of equal ones, over several shards
            seq = [7, 7, 9]
        else:
            seq = [rng.randrange(4) for _ in range(rng.randrange(6))]
        sequences[conv * 5 - 40] = [(w, 10 + w) for w in seq]
    sequences[9999] = [(7, 17)] * 2 + [(9, 19)] + [(1, 11)] * 60
    df = spark.createDataFrame(
        [(c, [w for w, _ in s], [n for _, n in s]) for c, s in sequences.items()],
        "conv_id long, words array<long>, sizes array<long>",
    )
    same(ct.trie(df, shards), brute(sequences))


def test_conversations_with_shared_heads_and_odd_rows(spark):
    rng = random.Random(3)
    rows = []
    for conv in [*range(0, 40), *range(100, 130), *range(205, 230), 1000, 77_777]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "é" * 9, "x" * 5000])))
    rows += [(50, None, "user", "first"), (50, 0, "user", "second"), (50, 1, "user", "third"), (None, 0, "user", "lost")]
    rows += [(60, 3, "u", "same")] * 3  # repeated rows are turns of their own
    df = spark.createDataFrame([(*r, "w", 1, b"k", 5) for r in rows], SCHEMA).repartition(5)
    expected = brute(rebuilt(rows))
    same(ct.conversation_trie(df), expected)
    same(ct.conversation_trie(df, 40), expected)


def test_role_and_text_do_not_run_together(spark):
    rows = [(205, 0, "us", "er"), (207, 0, "use", "r"), (209, 0, "", "user"), (211, 0, "user", "")]
    rows += [(c, t, "x", f"{c}") for c in (205, 207, 209, 211) for t in range(1, 7)]
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)
    same(ct.conversation_trie(df), brute(rebuilt(rows)))


def test_empty_table(spark):
    assert ct.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert ct.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", *[None] * 4)], SCHEMA)).collect() == []


def test_median_insertion_keeps_searches_short():
    tree = ct.TernaryTree()
    tree.fill([([w], [1], [w]) for w in range(4095)])
    depth, stack = 0, [(tree.same[0], 1)]
    while stack:
        node, at = stack.pop()
        depth = max(depth, at)
        stack += [(link[node], at + 1) for link in (tree.less, tree.more) if link[node]]
    assert depth == 12
    assert len(tree.order()) == 4096
