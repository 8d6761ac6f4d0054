"""Text quality: random Fourier features, ridge regression, isotonic calibration."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tillspark.llm.common import Shipped, fold_of, sum_arrays
from tillspark.session import materialize

FEATURES = 256
RIDGE = 1e-3
SEED = 20240607
STEPS = 1000
_SENTENCE = re.compile(r"[.?!]+")

STATISTICS = (
    "log_chars", "log_words", "mean_word", "std_word", "upper", "digit", "punctuation", "symbol", "blank",
    "distinct_words", "top_word", "repeats", "distinct_lines", "mean_line", "bare_words", "marked_words",
    "mean_sentence", "capital_words", "long_words", "non_ascii",
)


def _classes() -> np.ndarray:
    """Byte value to class: 0 other, 1 upper, 2 lower, 3 digit, 4 sentence punctuation, 5 symbol, 6 blank, 7 above ASCII."""
    kind = np.zeros(256, np.int64)
    for low, high, k in ((65, 90, 1), (97, 122, 2), (48, 57, 3), (33, 47, 5), (58, 64, 5), (91, 96, 5), (123, 126, 5), (9, 13, 6), (128, 255, 7)):
        kind[low:high + 1] = k
    kind[[ord(c) for c in ".,;:?!'\"-()"]] = 4
    kind[32] = 6
    return kind


_KIND = _classes()


def statistics(text: str) -> list[float]:
    """The STATISTICS of one text; an empty text has zeros."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    kind = np.bincount(_KIND, weights=raw, minlength=8)
    size, n = kind.sum(), len(words)
    lengths = np.fromiter(map(len, words), np.float64, n)
    seen: dict[str, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    sentences = max(1, sum(1 for x in _SENTENCE.split(text) if x.strip()))
    return [
        np.log1p(len(text)), np.log1p(n), lengths.mean(), lengths.std(), *(kind[k] / size for k in (1, 3, 4, 5, 6)),
        len(seen) / n, max(seen.values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)),
        sum(not any(c.isalpha() for c in w) for w in seen) / len(seen),
        sum(not w[-1].isalnum() for w in seen) / len(seen), np.log1p(n / sentences),
        sum(c for w, c in seen.items() if w[0].isupper()) / n, float((lengths > 15).mean()), kind[7] / size,
    ]


def _statistics(text: pd.Series) -> pd.Series:
    return pd.Series([statistics(t or "") for t in text])


class Model:
    """Scaling, the random features and the fitted scores."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        width = np.sqrt(len(mean))  # two standardised texts are about sqrt(2 d) apart
        self.turn = rng.normal(size=(len(mean), features)) / width
        self.shift = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.knots, self.levels = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Cosines whose inner products approximate a Gaussian kernel, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.turn + self.shift
        return np.hstack([np.cos(z) * np.sqrt(2 / len(self.shift)), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.project(x) @ self.weights, self.knots, self.levels), 0, 1)


def solve(gram: np.ndarray, moment: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge solution of summed normal equations; `ridge` is per row."""
    n = max(1.0, gram[-1, -1])
    penalty = np.full(len(gram), ridge * n / len(gram) + 1e-9)
    penalty[-1] = 1e-9  # the constant is free
    return np.linalg.solve(gram + np.diag(penalty), moment)


def isotonic(x: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the nondecreasing fit of total / weight along x (pooled neighbours)."""
    pools: list[list[float]] = []  # weight, total, weighted x
    for a, t, w in zip(x, total, weight):
        pools.append([w, t, w * a])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def fit(labelled: DataFrame, features: int = FEATURES, ridge: float = RIDGE) -> Model | None:
    """A model from rows (half 0 or 1, label, stats array); None without rows."""
    d = len(STATISTICS)
    moments = labelled.agg(
        *(F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(d)),
        *(F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(d)),
    ).first()
    if moments["m0"] is None:
        return None
    scale = np.array([moments[f"s{i}"] for i in range(d)])
    model = Model(np.array([moments[f"m{i}"] for i in range(d)]), np.where(scale > 1e-9, scale, 1.0), features)
    shared = Shipped(labelled.sparkSession, model)  # of fixed size

    def equations(frames):
        sums = np.zeros((2, features + 1, features + 2))
        for frame in frames:
            z = shared.value.project(np.stack(frame["stats"].to_numpy()))
            for half in (0, 1):
                mine = (frame["half"] == half).to_numpy()
                part = z[mine]
                sums[half] += part.T @ np.column_stack([part, frame["label"].to_numpy(np.float64)[mine]])
        yield pd.DataFrame(
            [(h, i, sums[h, i]) for h in (0, 1) for i in range(features + 1)], columns=["half", "line", "sums"]
        )

    parts = labelled.select("half", "label", "stats").mapInPandas(equations, "half int, line int, sums array<double>")
    system = np.zeros((2, features + 1, features + 2))
    for row in sum_arrays(parts, ["half", "line"], "sums").collect():  # 2 x features rows at any size
        system[row["half"], row["line"]] = row["sums"]
    gram, moment = system[:, :, :-1], system[:, :, -1]
    # Each half is scored by the other half's fit, so that calibration sees honest scores.
    cross = [solve(gram[1 - h], moment[1 - h], ridge) if gram[1 - h][-1, -1] else np.zeros(features + 1) for h in (0, 1)]
    model.weights = solve(gram.sum(0), moment.sum(0), ridge)
    honest = Shipped(labelled.sparkSession, (model, cross))

    def raw(frames):
        for frame in frames:
            own, weights = honest.value
            z = own.project(np.stack(frame["stats"].to_numpy()))
            score = np.where(frame["half"] == 0, z @ weights[0], z @ weights[1])
            yield pd.DataFrame({"step": np.rint(np.clip(score, -0.5, 1.5) * STEPS).astype(int), "label": frame["label"]})

    steps = (
        labelled.select("half", "label", "stats").mapInPandas(raw, "step int, label double")
        .groupBy("step").agg(F.sum("label").alias("total"), F.count("*").alias("n")).orderBy("step").collect()
    )  # at most 2 x STEPS + 1 rows
    x, total, n = (np.array([float(r[k]) for r in steps]) for k in ("step", "total", "n"))
    model.knots, model.levels = isotonic(x / STEPS, total, n)
    return model


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 3, held: int = 1, features: int = FEATURES, ridge: float = RIDGE,
) -> DataFrame:
    """Quality of every text: doc_id, held_out, score, predicted.

    Statistics of the whole text are mapped to random Fourier features;
    every partition of labelled rows adds up its normal equations, the sums
    give the ridge weights, and scores out of half are calibrated by an
    isotonic fit over bins of a thousandth.

    Null texts count as empty and have a score too. Label rows without a
    label or an id are not used; of several for one id the mean decides
    (0.5 is good). Rows without an id are scored and never learnt from.
    Without any usable label every score is 0.5. Repeated rows each give a
    row; other columns are ignored, whatever their names.
    """
    compute = F.pandas_udf(_statistics, "array<double>")
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"), (fold_of(id_col, folds) == held).alias("held_out"),
            compute(F.col(text_col)).alias("stats"),
        ),
        "statistics",
    )
    marks = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label"))
        .filter("doc_id is not null and label is not null")
        .groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    )
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    labelled = rows.filter("not held_out").join(marks, "doc_id").select(half.alias("half"), "label", "stats")
    model = fit(labelled, features, ridge)
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    shared = Shipped(docs.sparkSession, model)

    @F.pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.stack(stats.to_numpy())) if len(stats) else [])

    return rows.select("doc_id", "held_out", score("stats").alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
