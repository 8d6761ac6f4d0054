"""Language identification by cross-parsing against suffix automata."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillspark.llm.common import fold_of

UNKNOWN = "und"
CHARS_PER_LANGUAGE = 24_000
SAMPLE_DOCS = 64
SYMBOLS = 62
BLOCK = 1024
LANES = 1024
SLICE_CHARS = 1 << 19
_LETTER = re.compile(r"[^\W\d_]")
_OTHERS = re.compile(r"[\W\d_]+")


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts all factors of a text."""
    moves: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for symbol in symbols:
        new = len(moves)
        moves.append({})
        size.append(size[last] + 1)
        link.append(0)
        state = last
        while state >= 0 and symbol not in moves[state]:
            moves[state][symbol] = new
            state = link[state]
        if state >= 0:
            target = moves[state][symbol]
            if size[target] == size[state] + 1:
                link[new] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                size.append(size[state] + 1)
                link.append(link[target])
                while state >= 0 and moves[state].get(symbol) == target:
                    moves[state][symbol] = copy
                    state = link[state]
                link[target] = link[new] = copy
        last = new
    return moves


class CrossParser:
    """Automata of all languages in one transition table, for the SYMBOLS commonest characters.

    Transitions by all other characters of the labelled texts are sparse:
    sorted by (state, symbol), with the same entries as values.

    An entry holds twice the row offset of the next state, plus one where
    the current phrase ends because no labelled text continues it; the next
    phrase then starts with the symbol that did not fit. Symbol 0 stands for
    every character that occurs in no labelled text.
    """

    def __init__(self, texts: dict[str, list[str]], chars: int):
        self.languages = sorted(texts)
        plain = {k: [self._plain(t) for t in texts[k]] for k in self.languages}
        points, counts = np.unique(
            np.concatenate([self._points("".join(v)) for v in plain.values()] or [np.zeros(0, np.uint32)]),
            return_counts=True,
        )
        points = points[np.lexsort((points, -counts))]
        kept, rare = points[:SYMBOLS], points[SYMBOLS:]
        width = self.width = len(kept) + 2  # one more symbol stands between sample texts
        self.codes = np.zeros(0x110000, np.uint32)
        self.codes[kept] = np.arange(1, len(kept) + 1)
        self.codes[rare] = np.arange(width, width + len(rare))
        self.symbols = width + len(rare)
        tables, roots, used, self.sizes = [], [], 0, []
        sparse: dict[int, int] = {}
        for name in self.languages:
            symbols: list[int] = []
            for text in plain[name]:
                symbols += self.codes[self._points(text)].tolist()
                symbols.append(width - 1)
                if len(symbols) >= chars:
                    break
            symbols = symbols[:chars]
            self.sizes.append(max(2, len(symbols)))
            moves = suffix_automaton(symbols)
            root = np.full(width, used * width * 2 + 1, np.int32)
            for symbol, target in moves[0].items():
                if symbol < width:
                    root[symbol] = (used + target) * width * 2 + 1
            part = np.repeat(root[None, :], len(moves), axis=0)
            for state, out in enumerate(moves):
                for symbol, target in out.items():
                    if symbol >= width:
                        sparse[(used + state) * width * self.symbols + symbol] = (used + target) * width * 2
                    elif symbol not in (0, width - 1):
                        part[state, symbol] = (used + target) * width * 2
            tables.append(part)
            roots.append(used * width)
            used += len(moves)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.roots = np.array(roots, np.int32)
        self.keys = np.array(sorted(sparse), np.int64)
        self.entries = np.array([sparse[k] for k in self.keys.tolist()], np.int32)

    @staticmethod
    def _plain(text: str) -> str:
        return _OTHERS.sub(" ", f" {text.lower()} ")

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def _find(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Entries of sparse transitions; -1 where there is none."""
        key = state.astype(np.int64) * self.symbols + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.entries[at], -1)

    def _sparse(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Entries per lane and language; where the phrase ends, those of the root with the mark."""
        entry = self._find(state, symbol[:, None])
        ends = entry < 0
        if ends.any():
            roots = np.broadcast_to(self.roots, state.shape)[ends]
            again = self._find(roots, np.broadcast_to(symbol[:, None], state.shape)[ends])
            entry[ends] = np.where(again < 0, roots * 2, again) + 1
        return entry

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per text and language, and characters per text."""
        plain = [self._plain(t) for t in texts]
        lengths = np.array([len(t) for t in plain], np.int64)
        symbols = self.codes[self._points("".join(plain))]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = starts[owner] + within * BLOCK
        size = np.minimum(BLOCK, starts[owner] + lengths[owner] - begin)
        order = np.argsort(-size, kind="stable")
        ends = np.zeros((len(owner), len(self.languages)), np.int32)
        padded = np.concatenate([symbols, np.zeros(BLOCK, symbols.dtype)])
        for low in range(0, len(order), LANES):
            lanes = order[low:low + LANES]
            sizes = size[lanes]
            grid = np.ascontiguousarray(padded[begin[lanes][:, None] + np.arange(sizes[0])[None, :]].T)
            rare = grid >= self.width
            common = np.where(rare, 0, grid)
            some = rare.any(1)
            active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
            state = np.repeat(self.roots[None, :], len(lanes), axis=0)
            count = np.ones_like(state)
            for at in range(sizes[0]):
                live = active[at]
                entry = self.table.take(state[:live] + common[at, :live, None].astype(np.int32))
                if some[at]:
                    who = np.flatnonzero(rare[at, :live])
                    entry[who] = self._sparse(state[who], grid[at, who].astype(np.int64))
                count[:live] += entry & 1
                np.right_shift(entry, 1, out=state[:live])
            ends[lanes] = count
        total = np.zeros((len(texts), len(self.languages)), np.int64)
        np.add.at(total, owner, ends)
        return total, lengths

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Language index (-1: none) and confidence of each text."""
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not self.languages:
            return best, score
        # Few characters at a time: a batch of long texts must not be spelt out in codes at once.
        ends = np.cumsum([len(texts[i]) for i in known]) // SLICE_CHARS
        for part in np.split(np.array(known, int), np.flatnonzero(np.diff(ends)) + 1) if known else ():
            count, length = self.phrases([texts[i] for i in part])
            entropy = count * np.log2(self.sizes)[None, :] / np.maximum(1, length)[:, None]
            weight = np.exp2(-(entropy - entropy.min(1, keepdims=True)) * np.minimum(100, length)[:, None])
            best[part] = entropy.argmin(1)
            score[part] = weight.max(1) / weight.sum(1)
        return best, score


def learn(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    chars: int = CHARS_PER_LANGUAGE, sample_docs: int = SAMPLE_DOCS,
) -> CrossParser:
    """Automata of labelled text.

    The sample is bounded: per language the `sample_docs` texts whose ids
    come first by hash, of which `chars` characters are used.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"),
        F.xxhash64(F.col(id_col)).alias("at"), F.col(text_col).alias("text"),
    )
    first = Window.partitionBy("lang").orderBy("at", "id")
    picked = (
        labelled.select("lang", "id", "at").withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= sample_docs).select("lang", "id", "rank")
    )
    # At most sample_docs rows per language: a bounded broadcast.
    sample = (
        labelled.join(F.broadcast(picked.select("lang", "id").distinct()), ["lang", "id"], "left_semi")
        .select("lang", "at", "id", F.substring("text", 1, chars).alias("text"))
    )
    texts: dict[str, list[str]] = {}
    for row in sorted(sample.collect(), key=lambda r: (r["lang"], r["at"], str(r["id"]), r["text"])):
        texts.setdefault(row["lang"], []).append(row["text"])
    return CrossParser(texts, chars)


def language_column(spark, parser: CrossParser, text: Column) -> Column:
    """Struct of lang_pred and score for a text column."""
    # Arrays and names alone, bounded by CHARS_PER_LANGUAGE a language: a worker holds them once.
    shared = spark.sparkContext.broadcast(vars(parser))

    @F.pandas_udf("lang_pred string, score double")
    def predict(column: pd.Series) -> pd.DataFrame:
        known = CrossParser.__new__(CrossParser)
        known.__dict__.update(shared.value)
        best, score = known.predict(column.tolist())
        names = np.array([*known.languages, UNKNOWN], object)
        return pd.DataFrame({"lang_pred": names[best], "score": score})

    return predict(text)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2,
) -> DataFrame:
    """Language of every text: doc_id, held_out, lang_pred, score.

    A text is cut greedily into the longest phrases that occur in the
    labelled text of a language. The language with the smallest number of
    phrases times log2 of its sample size, per character, wins; ties go to
    the first name. Parsing starts anew every BLOCK characters. Case does
    not count, and whatever is not a letter counts as one space.

    Null texts and texts without a letter give `und` and score 0, and so
    does every text where nothing is labelled. Rows without an id are in
    fold 0 and train. Repeated rows each give a row; other columns are
    ignored, whatever their names.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (fold_of(id_col, folds) == held).alias("held_out"),
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
    )
    parser = learn(rows.filter("not held_out"), "doc_id", "text", "lang")
    found = language_column(docs.sparkSession, parser, F.col("text"))
    return rows.select("doc_id", "held_out", found.alias("found")).select(
        "doc_id", "held_out", "found.lang_pred", "found.score"
    )


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is known, all columns; `und` goes.

    Null texts and texts without a letter go, and where nothing is labelled
    all do. Rows without an id train and stay; repeated rows stay each. An
    empty table stays empty.
    """
    parser = learn(docs.filter(fold_of(id_col, 4) != 2), id_col, text_col, lang_col)
    found = language_column(docs.sparkSession, parser, F.col(text_col))
    return docs.filter(found["lang_pred"] != UNKNOWN)
