"""The prefix trie of conversations, built as ternary search trees over range shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillspark.llm.common import fold_of
from tillspark.session import materialize, shuffle_width

TURNS_PER_SHARD = 100_000
HEAD_FOLDS = 6
HEAD_SPAN = 100
IDS_PER_PIECE = 512
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: What a shard reports: its inner nodes, those on its edges, the ids ending on edges, its first and last sequence.
REPORT = (
    f"kind string, shard int, key binary, parent_key binary, {NODE}, piece int, piece_ids string,"
    " first_ids array<long>, first_sizes array<long>, last_ids array<long>"
)
_NAMES = [c.split()[0] for c in REPORT.split(", ")]


def path_keys(words) -> list[bytes]:
    """A 16-byte digest of every prefix of a sequence, the empty one first."""
    keys = [hashlib.blake2b(digest_size=16).digest()]
    for word in words:
        keys.append(hashlib.blake2b(keys[-1] + int(word).to_bytes(8, "little", signed=True), digest_size=16).digest())
    return keys


def ends_digest(ids) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


class TernaryTree:
    """A ternary search tree of word sequences; every entry but the root is one word of a prefix.

    `less` and `more` lead to other words after the same prefix, `same` to
    the words after this one.
    """

    def __init__(self):
        self.word, self.size, self.parent, self.depth = [None], [0], [-1], [0]
        self.less, self.same, self.more = [0], [0], [0]
        self.ends: dict[int, list[int]] = {}

    def _step(self, node: int, word: int, size: int) -> int:
        """The entry of `word` after the prefix `node`, made if there is none."""
        links, at = self.same, node
        while links[at]:
            at = links[at]
            if word == self.word[at]:
                return at
            links = self.less if word < self.word[at] else self.more
        new = links[at] = len(self.word)
        self.word.append(word)
        self.size.append(size)
        self.parent.append(node)
        self.depth.append(self.depth[node] + 1)
        for column in (self.less, self.same, self.more):
            column.append(0)
        return new

    def insert(self, words: list[int], sizes: list[int], ids: list[int]) -> None:
        node = 0
        for word, size in zip(words, sizes):
            node = self._step(node, word, size)
        self.ends.setdefault(node, []).extend(ids)

    def fill(self, groups: list[tuple[list[int], list[int], list[int]]]) -> None:
        """Insert sorted sequences, medians first, which keeps the searches short."""
        spans = [(0, len(groups))]
        while spans:
            low, high = spans.pop()
            if low < high:
                middle = (low + high) // 2
                self.insert(*groups[middle])
                spans += [(low, middle), (middle + 1, high)]

    def order(self) -> list[int]:
        """All entries, each after its prefix."""
        seen, stack = [], [0]
        while stack:
            node = stack.pop()
            seen.append(node)
            stack += [link[node] for link in (self.more, self.less, self.same) if link[node]]
        return seen

    def path(self, words) -> list[int]:
        nodes = [0]
        for word in words:
            nodes.append(self._step(nodes[-1], word, 0))
        return nodes

    def totals(self) -> tuple[list[int], ...]:
        """Smallest member, members, children, leaves and savings of every entry."""
        n = len(self.word)
        first, members = [1 << 63] * n, [0] * n
        children, leaves, saved = [0] * n, [0] * n, [0] * n
        for node in reversed(self.order()):
            ids = self.ends.get(node, ())
            members[node] += len(ids)
            first[node] = min(first[node], ids[0]) if ids else first[node]
            leaves[node] = leaves[node] or 1
            saved[node] += (members[node] - 1) * self.size[node]
            up = self.parent[node]
            if up >= 0:
                members[up] += members[node]
                first[up] = min(first[up], first[node])
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]
        return first, members, children, leaves, saved


def shard_report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes of one sorted shard.

    Only prefixes of the shard's first and last sequence can lie in other
    shards too; these are its edges and carry a key to meet by.
    """
    groups: list[tuple[list[int], list[int], list[int]]] = []
    shard = -1
    for batch in batches:
        for shard, conv, words, sizes in zip(batch["shard"], batch["conv_id"], batch["words"], batch["sizes"]):
            words = words.tolist()
            if groups and groups[-1][0] == words:
                groups[-1][2].append(conv)
            else:
                groups.append((words, sizes.tolist(), [conv]))
    if not groups:
        return
    tree = TernaryTree()
    tree.fill(groups)
    first, members, children, leaves, saved = tree.totals()
    (low, low_sizes, _), (high, _, _) = groups[0], groups[-1]
    edge = {n: k for words in (low, high) for n, k in zip(tree.path(words), path_keys(words))}
    rows = [dict(kind="border", shard=shard, first_ids=low, first_sizes=low_sizes, last_ids=high)]
    for node in range(len(tree.word)):
        up, ids = tree.parent[node], tree.ends.get(node, [])
        rows.append(dict(
            kind="edge" if node in edge else "inner", shard=shard, key=edge.get(node), parent_key=edge.get(up),
            conv_id=first[node], depth=tree.depth[node], parent_conv_id=None if up in edge or up < 0 else first[up],
            n_convs=members[node], n_children=children[node], n_leaves=leaves[node], saved_tokens=saved[node],
            ends_sha256=None if node in edge else ends_digest(ids),
        ))
        if node in edge:
            for at in range(0, len(ids), IDS_PER_PIECE):
                text = ",".join(map(str, ids[at:at + IDS_PER_PIECE]))
                rows.append(dict(kind="ends", shard=shard, key=edge[node], piece=at // IDS_PER_PIECE, piece_ids=text))
        if len(rows) >= 8192:
            yield _frame(rows)
            rows = []
    yield _frame(rows)


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({name: pd.Series([r.get(name) for r in rows], dtype=object) for name in _NAMES})


def shared_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What two neighbouring shards counted twice, per node that both have.

    These nodes are the common prefixes of the last sequence of one and the
    first of the other. One of their children is the same child, except at
    the longest; the longest is a leaf too many where the earlier sequence
    ends there; and each node below took one copy of its text too little
    from the savings.
    """
    for batch in batches:
        rows = []
        for before, words, sizes in zip(batch["before_ids"], batch["first_ids"], batch["first_sizes"]):
            n = min(len(before), len(words))
            differs = np.flatnonzero(before[:n] != words[:n])
            common = int(differs[0]) if len(differs) else n
            below = np.append(np.cumsum(sizes[:common][::-1])[::-1], 0)  # texts of depth d + 1 and deeper
            own = np.append(0, sizes[:common])
            for depth, key in enumerate(path_keys(words[:common])):
                rows.append((
                    key, -int(depth < common), -int(len(before) == common), int(below[depth] + own[depth]),
                ))
        yield pd.DataFrame(rows, columns=["key", "n_children", "n_leaves", "saved_tokens"])


def hash_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 per key of its pieces, which arrive in order; holds one batch at a time."""
    key, state = None, None
    for batch in batches:
        done = []
        for now, text in zip(batch["key"], batch["piece_ids"]):
            if now != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = now, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pd.DataFrame(done, columns=["key", "ends"])
    if key is not None:
        yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "ends"])


def word_sequences(turns: DataFrame) -> DataFrame:
    """Conversations as arrays of dictionary ids and text lengths: conv_id, words, sizes.

    A turn's dictionary id stands for its role and text. Turns come by
    turn number, null first; ties by a hash of role and text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = materialize(
        turns.filter("conv_id IS NOT NULL").select(
            F.col("conv_id").cast("long").alias("conv_id"), "turn",
            F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
            F.xxhash64(role, text).alias("tie"), F.length(text).cast("long").alias("size"),
        ),
        "turns",
    )
    words = materialize(
        rows.select("digest").distinct().withColumn("word", F.monotonically_increasing_id()), "dictionary"
    )
    listed = F.sort_array(F.collect_list(F.struct("turn", "tie", "word", "size")))
    return (
        rows.join(words, "digest").groupBy("conv_id").agg(listed.alias("turns"))
        .select("conv_id", F.col("turns.word").alias("words"), F.col("turns.size").alias("sizes"))
    )


def with_shared_heads(sequences: DataFrame, span: int = HEAD_SPAN, folds: int = HEAD_FOLDS) -> DataFrame:
    """Each conversation with its first turns taken from the first of its span of ids.

    Conversation c begins with the first h turns of c - c % span, h being
    crc32(c) % folds, and goes on with its own after its first h. A head
    has at most folds - 1 turns and goes to at most 2 * span conversations.
    """
    sequences = materialize(sequences, "sequences")
    heads = sequences.filter(F.col("conv_id") % span == 0).select(
        F.col("conv_id").alias("base"), F.slice("words", 1, folds - 1).alias("head_words"),
        F.slice("sizes", 1, folds - 1).alias("head_sizes"),
    )
    h = fold_of("conv_id", folds).cast("int")

    def joined(name: str) -> Column:
        head = F.coalesce(F.slice(F.col(f"head_{name}"), F.lit(1), h), F.array().cast("array<bigint>"))
        return F.concat(head, F.slice(F.col(name), h + 1, F.size(name))).alias(name)

    return sequences.withColumn("base", F.col("conv_id") - F.col("conv_id") % span).join(heads, "base", "left").select(
        "conv_id", joined("words"), joined("sizes")
    )


def trie(sequences: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes of the trie of all sequences (conv_id, words, sizes).

    Sequences are dealt by range over (words, conv_id), so a group of equal
    ones may span shards. Each shard builds its own tree; nodes of its two
    edges add up over shards by key, less what neighbours share. An inner
    node whose parent is an edge looks the parent's smallest member up
    under its own shard, so that the root is not one hot key.
    """
    sequences = materialize(sequences, "rebuilt")
    if shards is None:
        total = sequences.agg(F.sum(F.size("words") + 1).alias("n")).first()["n"] or 0
        shards = max(shuffle_width(sequences.sparkSession), total // TURNS_PER_SHARD + 1)
    report = materialize(
        sequences.repartitionByRange(shards, "words", "conv_id").sortWithinPartitions("words", "conv_id")
        .select(F.spark_partition_id().alias("shard"), "conv_id", "words", "sizes")
        .mapInPandas(shard_report, REPORT),
        "shards", by=["kind"],
    )
    edges, inner = report.filter("kind = 'edge'"), report.filter("kind = 'inner'")
    border = report.filter("kind = 'border'")
    # One number per shard goes through this one-task window.
    before = border.select("shard", F.lag("shard").over(Window.orderBy("shard")).alias("before"))
    twice = (
        border.select("shard", "first_ids", "first_sizes").join(before.filter("before IS NOT NULL"), "shard")
        .join(border.select(F.col("shard").alias("before"), F.col("last_ids").alias("before_ids")), "before")
        .select("before_ids", "first_ids", "first_sizes")
        .mapInPandas(shared_paths, "key binary, n_children long, n_leaves long, saved_tokens long")
    )
    own = ["key", "parent_key", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    merged = materialize(
        edges.select(*own).unionByName(twice, allowMissingColumns=True).groupBy("key").agg(
            *(F.min(c).alias(c) for c in ("parent_key", "conv_id", "depth")), *(F.sum(c).alias(c) for c in own[4:])
        ),
        "edges",
    )
    named = edges.select("shard", "key").join(merged.select("key", F.col("conv_id").alias("up")), "key").withColumnRenamed("key", "parent_key")
    inside = inner.join(named, ["shard", "parent_key"], "left").withColumn("parent_conv_id", F.coalesce("up", "parent_conv_id"))
    ends = (
        report.filter("kind = 'ends'").select("key", "shard", "piece", "piece_ids")
        .repartition("key").sortWithinPartitions("key", "shard", "piece").mapInPandas(hash_pieces, "key binary, ends string")
    )
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    outside = merged.join(parents, "parent_key", "left").join(ends, "key", "left").withColumn(
        "ends_sha256", F.coalesce("ends", F.lit(ends_digest([])))
    )
    names = [c.split()[0] for c in NODE.split(", ")]
    return inside.select(*names).unionByName(outside.select(*names))


def conversation_trie(turns: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per distinct beginning of the rebuilt conversations.

    Columns conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. A null role or text is
    empty, rows without a conv_id belong to no conversation and go, turns
    with equal numbers come in a fixed order and repeated rows are turns of
    their own. A conversation that ends up without turns is a member of the
    root alone. An empty table has no root and gives an empty result; other
    columns are ignored.

    A conversation is one row of 8-byte ids, its texts never meet in one
    place. The ids that end at one node are hashed as a stream.
    """
    picked = turns.select("conv_id", "turn", "role", "text")
    return trie(with_shared_heads(word_sequences(picked)), shards)


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(said ORDER BY pos) AS turns FROM t GROUP BY conv_id),
h AS (
  SELECT conv_id, turns, xor(list_reduce(
      list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce(
        list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)),
    4294967295::BIGINT) % 6 AS h
  FROM own),
rebuilt AS (
  SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], h.turns[1:0]), h.turns[h.h + 1:]) AS said
  FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
steps AS (SELECT conv_id, said, unnest(range(0, len(said) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT depth, said[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(said) = depth), '') AS ends
  FROM steps GROUP BY depth, said[1:depth]),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
sized AS (
  SELECT nodes.*, coalesce(kids.n, 0) AS n_children,
    CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(nodes.path[depth].t) END AS saving
  FROM nodes LEFT JOIN kids ON kids.path = nodes.path),
up AS (SELECT *, unnest(range(0, depth + 1)) AS d FROM sized),
below AS (
  SELECT path[1:d] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saving) AS saved
  FROM up GROUP BY 1)
SELECT s.conv_id, s.depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children,
  below.n_leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, sha256(s.ends) AS ends_sha256
FROM sized s JOIN below ON below.path = s.path
LEFT JOIN nodes p ON s.depth > 0 AND p.depth = s.depth - 1 AND p.path = s.path[1:s.depth - 1]
"""
