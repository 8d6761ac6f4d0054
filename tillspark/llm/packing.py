"""Packing token sequences by bulk-synchronous best fit."""

from __future__ import annotations

import base64
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tillspark.functions.positions import assign_ids
from tillspark.session import materialize

SEQUENCE = 2048
END = 0
SPECIAL = "<|endoftext|>"
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary() -> str:
    """Path of the default tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of a byte-level BPE file.

    Where the same vocabulary lies beside the file as ranks, plain texts go
    through the faster library; texts that contain the special token's
    string are encoded by the file itself. Both give the same ids.
    """

    def __init__(self, path: str):
        self.path, self.slow, self.fast = path, None, None
        ranks = Path(path).with_suffix(".tiktoken")
        if ranks.exists():
            import public_tokenizers
            import tiktoken

            pairs = (line.split() for line in ranks.read_bytes().splitlines())
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN,
                mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={},
            )

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and SPECIAL not in text:
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids


def cut(ids: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """Pieces of at most `size` ids with their start; only the first may be shorter."""
    head = len(ids) % size
    edges = ([0] if head else []) + list(range(head, len(ids), size)) + [len(ids)]
    return [(a, ids[a:b]) for a, b in zip(edges, edges[1:])]


def pieces_of(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    tokenizer: str | None = None, size: int = SEQUENCE,
) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32."""
    path = tokenizer or vocabulary()

    def encode(frames):
        encoder = Encoder(path)
        for frame in frames:
            out = []
            for key, text in zip(frame["doc_id"], frame["text"]):
                ids = np.array([*encoder(text), END], "<u4")
                for k, (start, part) in enumerate(cut(ids, size)):
                    out.append((key, k, start, len(part), zlib.crc32(part.tobytes())))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype(
                {"doc_id": "Int64"}
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(encode, _PIECES)


def place_classes(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, n, first sequence, offset).

    Pieces of one length are alike, and so are sequences with one gap, so
    the rounds work on classes: `counts` has at most `size` entries. A round
    goes through the lengths from the longest, gives each the sequences with
    the smallest gap that holds it (every sequence takes one piece a round,
    the lower rank first), opens sequences for lengths that neither a gap
    nor what this round leaves can hold, and then brings the gaps up to date.
    """
    left = {length: n for length, n in counts.items() if n}
    rank = dict.fromkeys(left, 0)
    gaps: dict[int, list[list[int]]] = {}  # gap: runs [first sequence, n]
    placed: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        placed.append((length, rank[length], n, first, offset))
        rank[length] += n
        left[length] -= n

    while left:
        after: dict[int, list[list[int]]] = {}
        sizes = sorted(gaps)
        for length in sorted(left, reverse=True):
            at = int(np.searchsorted(sizes, length))
            while left[length] and at < len(sizes):
                gap = sizes[at]
                runs = gaps[gap]
                while left[length] and runs:
                    first, n = runs.pop()
                    take = min(n, left[length])
                    put(length, take, first, size - gap)
                    after.setdefault(gap - length, []).append([first, take])
                    if take < n:
                        runs.append([first + take, n - take])
                if runs:
                    break
                sizes.pop(at)
                del gaps[gap]
            if left[length] and max(after, default=0) < length:
                fresh = -(-left[length] // (size // length))
                first, opened = opened, opened + fresh
                put(length, fresh, first, 0)
                after.setdefault(size - length, []).append([first, fresh])
            if not left[length]:
                del left[length]
        for gap, runs in after.items():
            if gap:
                gaps.setdefault(gap, []).extend(runs)
    return placed


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    tokenizer: str | None = None, size: int = SEQUENCE,
) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    Pieces are range-sorted by length and numbered over partitions; a
    piece's number within its length decides which of the matched gaps is
    its own, so conflicts need no shuffle by gap. Only the counts per
    length (at most `size`) reach the driver.

    Null and empty texts give one piece that holds the end id alone. Rows
    without an id are packed like others. Repeated rows are packed once per
    row. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = materialize(pieces_of(docs, id_col, text_col, tokenizer, size), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for length in sorted(counts):
        before[length], total = total, total + counts[length]
    plan = [(before[length] + r + 1, n, length, s, o) for length, r, n, s, o in place_classes(counts, size)]
    # One row per matched run of a length class: bounded by `size`, not by the data.
    runs = spark.createDataFrame(plan, "_from long, _n long, length long, _sequence long, offset long")
    numbered = assign_ids(pieces, ["length", "doc_id", "piece"], "_index")
    behind = F.col("_index") - F.col("_from")
    return numbered.join(F.broadcast(runs), "length").filter((behind >= 0) & (behind < F.col("_n"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_sequence") + behind).alias("sequence_id"), "offset"
    )
