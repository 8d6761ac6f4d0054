"""Toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tillspark.llm.common import Shipped, fold_of

SAMPLE_ROWS = 8_000
SAMPLE_CHARS = 20_000
LEAST_TEXTS = 6
LEAST_Z = 4.0
ROUNDS = 400
PENALTY = 1e-6
PREFIXES = (3, 4, 5, 6)
_TERM = re.compile(r"[^\W\d_]+")


def terms(text: str) -> set[str]:
    """The words of a text and, marked by a hyphen, their beginnings of PREFIXES letters.

    Beginnings carry over to inflected forms that no labelled text holds.
    """
    words = set(_TERM.findall(text.lower()))
    return words.union(*({w[:n] + "-" for w in words if len(w) > n} for n in PREFIXES))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Severity:
    """One weight per term, shared by all grades, and ordered thresholds.

    P(grade > k) = sigmoid(sum of the weights of a text's terms - cut k).
    A term is a feature if at least LEAST_TEXTS texts hold it and its share
    of toxic texts is LEAST_Z standard deviations from the overall share.
    Equal texts count once in both.
    """

    def __init__(self, texts: list[str], grades: list[int]):
        worst: dict[str, int] = {}
        for text, grade in zip(texts, grades):
            worst[text] = max(grade, worst.get(text, 0))
        texts, grades = list(worst), list(worst.values())
        # Texts hold their terms as numbers: sets of strings take many times the memory of the texts.
        number: dict[str, int] = {}
        found, df_, hits_ = [], array("q"), array("q")
        for text, grade in zip(texts, grades):
            words = terms(text)
            held = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
            fresh = bytes(8 * (len(number) - len(df_)))
            df_.frombytes(fresh)
            hits_.frombytes(fresh)
            np.frombuffer(df_, np.int64)[held] += 1
            if grade > 0:
                np.frombuffer(hits_, np.int64)[held] += 1
            found.append(held)
        df, hits = dict(zip(number, df_)), dict(zip(number, hits_))
        share = sum(g > 0 for g in grades) / max(1, len(grades))
        names = sorted(
            w for w, n in df.items()
            if n >= LEAST_TEXTS and abs(hits[w] - n * share) > LEAST_Z * np.sqrt(n * share * (1 - share))
        )
        at = np.full(len(number), -1, np.int64)  # place of a term among the names
        at[[number[w] for w in names]] = np.arange(len(names))
        grades_ = self._graded(texts, np.array(grades, np.int64), df, hits)
        self.top = int(grades_.max(initial=0))
        used = [at[x][at[x] >= 0] for x in found]
        rows = np.repeat(np.arange(len(used)), [len(x) for x in used])
        cols = np.concatenate([np.zeros(0, np.int64), *(np.sort(x) for x in used)])
        weights, self.cuts = self._fit(rows, cols, grades_, len(names))
        small = 0.05 * np.abs(weights).max(initial=0)
        self.weights = {w: float(v) for w, v in zip(names, weights) if abs(v) > small}

    @staticmethod
    def _graded(texts, grades, df, hits):
        """Grades as labelled; where labels only say yes or no, grade 2 marks the worse half.

        Worse: more occurrences than the median of terms that are toxic in
        four of five texts that hold them.
        """
        if grades.max(initial=0) != 1:
            return grades
        strong = {w for w, n in hits.items() if n >= LEAST_TEXTS and n >= 0.8 * df[w]}
        count = np.array([
            sum(w in strong for w in _TERM.findall(t.lower())) if g else 0 for t, g in zip(texts, grades)
        ])
        middle = np.median(count[grades > 0])
        return grades + ((grades > 0) & (count > middle))

    def _fit(self, rows, cols, grades, width):
        """Accelerated gradient descent on the penalised ordinal likelihood."""
        n = max(1, len(grades))
        weights = np.zeros(width)
        above = np.array([(grades > k).mean() if len(grades) else 0.0 for k in range(self.top)])
        above = np.clip(above, 0.5 / n, 1 - 0.5 / n)
        cuts = np.sort(np.log((1 - above) / above))
        if not self.top:
            return weights, cuts
        seen_w, seen_c = np.zeros(width), np.zeros(len(cuts))
        for _ in range(ROUNDS):
            score = np.bincount(rows, weights[cols], n)
            edges = np.concatenate([[-np.inf], cuts, [np.inf]])
            # Grade k lies between edges k and k + 1 of the latent scale.
            low = _sigmoid(score - edges[grades])
            high = _sigmoid(score - edges[grades + 1])
            p = np.maximum(low - high, 1e-12)
            d_low, d_high = low * (1 - low) / p, high * (1 - high) / p
            slope = (d_low - d_high) / n
            grad_w = -np.bincount(cols, slope[rows], width) + PENALTY * weights
            grad_c = np.zeros(len(cuts))
            inner = grades > 0
            np.add.at(grad_c, grades[inner] - 1, d_low[inner] / n)
            inner = grades < self.top
            np.add.at(grad_c, grades[inner], -d_high[inner] / n)
            seen_w += grad_w**2
            seen_c += grad_c**2
            weights = weights - 0.3 * grad_w / np.sqrt(seen_w + 1e-12)
            cuts = np.maximum.accumulate(cuts - 0.3 * grad_c / np.sqrt(seen_c + 1e-12))
        return weights, cuts

    def above(self, texts: list[str]) -> np.ndarray:
        """P(grade > k) of each text for every threshold."""
        heads = {w.rstrip("-")[: PREFIXES[0]] for w in self.weights}
        get = self.weights.get

        def weigh(text: str) -> float:
            words = {w for w in set(_TERM.findall(text.lower())) if w[: PREFIXES[0]] in heads}
            return sum(get(w, 0.0) for w in terms(" ".join(words)))

        score = np.array([weigh(t) if t else 0.0 for t in texts], np.float64)
        return _sigmoid(score[:, None] - self.cuts[None, :])


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Severity:
    """Fitted on at most `sample_rows` labelled rows, those first by hash of the id.

    Of a sampled text the first SAMPLE_CHARS characters are used.
    """
    marks = (
        labels.filter("doc_id is not null and label is not null")
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    ids = docs.select("doc_id").distinct().join(marks, "doc_id")
    picked = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # At most sample_rows rows: a bounded broadcast.
    sample = docs.join(F.broadcast(picked), "doc_id").select(
        "doc_id", "label", F.substring(F.coalesce("text", F.lit("")), 1, SAMPLE_CHARS).alias("text")
    )
    rows = sorted(sample.collect(), key=lambda r: (r["doc_id"], r["text"]))
    return Severity([r["text"] for r in rows], [max(0, r["label"]) for r in rows])


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    folds: int = 3, held: int = 1, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Severity of every whole text.

    Columns: doc_id; held_out (not learnt from); expected_severity, the sum
    of P(grade > k); max_severity, the highest grade; score, P(grade > 0);
    predicted, 1 if that is at least 0.5.

    Null and empty texts have no terms and get the base rate. Label rows
    without id or label are not used; of several for one id the worst
    counts. Rows without an id are scored only. Without labels everything
    is 0. Repeated rows each give a row; other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (fold_of(id_col, folds) == held).alias("held_out"), F.col(text_col).alias("text")
    )
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    model = learn(rows.filter("not held_out and doc_id is not null"), marks, sample_rows)
    shared = Shipped(docs.sparkSession, model)  # bounded by the sample

    @F.pandas_udf("expected_severity double, score double")
    def severity(text: pd.Series) -> pd.DataFrame:
        above = shared.value.above(text.tolist())
        first = above[:, 0] if above.shape[1] else np.zeros(len(above))
        return pd.DataFrame({"expected_severity": above.sum(1), "score": first})

    return rows.select("doc_id", "held_out", severity("text").alias("s")).select(
        "doc_id", "held_out", "s.expected_severity", F.lit(model.top).alias("max_severity"), "s.score",
        (F.col("s.score") >= 0.5).cast("int").alias("predicted"),
    )
