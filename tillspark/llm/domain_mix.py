"""Mixing to target weights through soft domain membership, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tillspark.llm.common import BLANKS
from tillspark.session import materialize

TARGETS = {"clean": 0.90, "low": 0.07, "toxic": 0.03}
SAMPLE_ROWS = 8_000
BUCKETS = 1 << 14
LEAST_Z = 4.0
LEAST_LOG = 0.7
PENALTY = 1e-5
FIT_ROUNDS = 200
ROUNDS = 40
CLOSE = 1e-7


def words_of(text: Column) -> Column:
    """Lower-case words parted by white space."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BLANKS, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _share(text: Column, pattern: str, steps: int) -> Column:
    """How much of a text matches a character class, as a step."""
    hits = F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    return F.floor(hits * steps / F.greatest(F.length(text), F.lit(1)))


def features_of(words: Column, distinct: Column, text: Column) -> Column:
    """Hash buckets of a text's distinct words and of a few coarse statistics."""
    text = F.coalesce(text, F.lit(""))
    size = F.size(words)
    marks = F.array(
        F.concat(F.lit("upper "), _share(text, "[A-Z]", 10)),
        F.concat(F.lit("symbol "), _share(text, r"[|!$%&*#<>{}=@~^+_\[\]\\/]", 20)),
        F.concat(F.lit("digit "), _share(text, "[0-9]", 20)),
        F.concat(F.lit("distinct "), F.floor(F.size(distinct) * 10 / F.greatest(size, F.lit(1)))),
        F.concat(F.lit("blank "), F.floor(size * 40 / F.greatest(F.length(text), F.lit(1)))),
    )
    return F.transform(F.concat(distinct, marks), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def with_buckets(rows: DataFrame) -> DataFrame:
    """The rows (with `text`) and their number of words and buckets; each step a column, so that none is worked out twice."""
    found = rows.withColumn("words", words_of(F.col("text"))).withColumn("distinct", F.array_distinct("words"))
    return found.withColumn("n_tokens", F.size("words").cast("long")).withColumn(
        "buckets", features_of(F.col("words"), F.col("distinct"), F.col("text"))
    ).drop("words", "distinct", "text")


def numbers(values: list[float]) -> Column:
    """A constant array; one literal to the optimiser however long it is."""
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


def fit_posteriors(rows: DataFrame, marks: DataFrame, domains: list[str], sample_rows: int) -> tuple[list[float], list[list[float]]]:
    """Constant and weight per bucket for each domain: multinomial logistic regression.

    Learnt from at most `sample_rows` labelled rows, those first by hash of
    the id. A bucket is used if for some domain the number of texts that
    hold it is LEAST_Z deviations and a factor of e^LEAST_LOG from what
    chance gives.
    """
    ids = rows.select("doc_id").distinct().join(marks, "doc_id")
    picked = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # At most sample_rows rows: a bounded broadcast.
    sample = materialize(
        with_buckets(rows.join(F.broadcast(picked), "doc_id")).select(
            "doc_id", "domain", F.array_distinct("buckets").alias("buckets")
        ),
        "sample",
    )
    place = {d: i for i, d in enumerate(domains)}
    texts = np.zeros(len(domains))
    for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect():
        texts[place[r["domain"]]] = r["n"]
    held = np.zeros((len(domains), BUCKETS))
    counts = sample.select("domain", F.explode("buckets").alias("bucket")).groupBy("domain", "bucket").agg(F.count("*").alias("n"))
    for r in counts.collect():  # at most len(domains) x BUCKETS rows
        held[place[r["domain"]], r["bucket"]] = r["n"]
    share = (held.sum(0) + 0.5) / (texts.sum() + 1)
    expected = texts[:, None] * share
    apart = np.abs(held - expected) > LEAST_Z * np.sqrt(expected * (1 - share) + 0.25)
    strong = np.abs(np.log((held + 1) / (expected + 1))) > LEAST_LOG
    used = np.flatnonzero((apart & strong).any(0))
    weights = np.zeros((len(domains), BUCKETS))
    # The used buckets of at most sample_rows rows.
    few = sample.select("doc_id", "domain", F.sort_array(F.array_intersect("buckets", F.array(*map(F.lit, used.tolist())).cast("array<int>"))).alias("few"))
    read = sorted(few.collect(), key=lambda r: (r["doc_id"], r["domain"], r["few"]))
    constant, weights[:, used] = _logistic([r["few"] for r in read], [place[r["domain"]] for r in read], used, len(domains))
    return constant.tolist(), weights.tolist()


def _logistic(found: list[list[int]], labels: list[int], used: np.ndarray, domains: int) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated gradient descent on the penalised likelihood."""
    n, width = len(found), len(used)
    rows = np.repeat(np.arange(n), [len(f) for f in found])
    cols = np.searchsorted(used, np.array([b for f in found for b in f], np.int64))
    truth = np.eye(domains)[np.array(labels, int)].reshape(n, domains)
    constant = np.log((truth.sum(0) + 1) / (n + domains))
    weights = np.zeros((domains, width))
    if not n:
        return constant, weights
    seen_w, seen_c = np.zeros_like(weights), np.zeros_like(constant)
    for _ in range(FIT_ROUNDS):
        scores = np.stack([np.bincount(rows, w[cols], n) for w in weights], 1) + constant
        raised = np.exp(scores - scores.max(1, keepdims=True))
        slope = (raised / raised.sum(1, keepdims=True) - truth) / n
        grad_w = np.stack([np.bincount(cols, s[rows], width) for s in slope.T]) + PENALTY * weights
        grad_c = slope.sum(0)
        seen_w += grad_w**2
        seen_c += grad_c**2
        weights -= 0.3 * grad_w / np.sqrt(seen_w + 1e-12)
        constant -= 0.3 * grad_c / np.sqrt(seen_c + 1e-12)
    return constant, weights


def weighed(buckets: Column, ratios: list[list[float]]) -> Column:
    """The distinct buckets that weigh anything for some domain; most do not."""
    used = numbers([float(any(line[k] for line in ratios)) for k in range(BUCKETS)])
    return F.array_distinct(F.filter(buckets, lambda b: F.element_at(used, b + 1) > 0))


def log_scores(buckets: Column, prior: list[float], ratios: list[list[float]]) -> Column:
    """Log score of each domain."""
    def score(start: float, line: list[float]) -> Column:
        weights = numbers(line)
        return F.aggregate(buckets, F.lit(start), lambda total, b: total + F.element_at(weights, b + 1))

    return F.array(*(score(p, line) for p, line in zip(prior, ratios)))


def _soft(scores: Column) -> Column:
    top = F.array_max(scores)
    raised = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def rate_of(p: Column, steps: list[list[float]]) -> Column:
    """The rate after projected steps from 1: r = max(0, r - p . step), one step after the other."""
    if not steps:
        return F.lit(1.0)
    width = len(steps[0])
    flat = numbers([v for step in steps for v in step])
    moves = F.sequence(F.lit(0), F.lit(len(steps) - 1))

    def move(rate: Column, k: Column) -> Column:
        out = F.lit(0.0)
        for i in range(width):
            out = out + p[i] * F.element_at(flat, k * width + i + 1)
        return F.greatest(F.lit(0.0), rate - out)

    return F.aggregate(moves, F.lit(1.0), move)


def plain_rate(p: list[float], steps: list[list[float]]) -> float:
    rate = 1.0
    for step in steps:
        rate = max(0.0, rate - sum(a * float(f"{b:.6g}") for a, b in zip(p, step)))
    return rate


def solve_rates(members: DataFrame, targets: list[float], rounds: int = ROUNDS) -> list[list[float]]:
    """Steps of projected gradient descent on the weighted squares of (domain totals - targets).

    A document's gradient is its posterior times the domains' errors, so the
    state of a round is one number a domain and every task can work out a
    document's rate anew. Errors are taken relative to a domain's tokens,
    and a document's step relative to its own.
    """
    width = len(targets)
    steps: list[list[float]] = []
    plain = members.agg(*(F.sum(F.col("n_tokens") * F.col("posterior")[i]).alias(f"t{i}") for i in range(width))).first()
    start = [float(plain[i] or 0) for i in range(width)]
    total = sum(start)
    if not total:
        return steps
    have = start
    for _ in range(rounds):
        errors = [(h - total * t) / total for h, t in zip(have, targets)]
        if max(map(abs, errors)) < CLOSE:
            break
        steps.append([e * total / s if s > 1e-9 * total else 0.0 for e, s in zip(errors, start)])
        weight = F.col("n_tokens") * F.col("rate")
        row = members.withColumn("rate", rate_of(F.col("posterior"), steps)).agg(
            *(F.sum(weight * F.col("posterior")[i]).alias(f"t{i}") for i in range(width))
        ).first()
        have = [float(row[i]) for i in range(width)]
    return steps


def default_domains(labels: DataFrame) -> DataFrame:
    """The labels table as (doc_id, domain): toxic, else low quality, else clean."""
    return labels.filter("doc_id is not null and (quality is not null or toxic is not null)").select(
        "doc_id",
        F.when(F.coalesce("toxic", F.lit(0)) > 0, "toxic").when(F.coalesce("quality", F.lit(1)) <= 0, "low").otherwise("clean").alias("domain"),
    )


def mix(
    docs: DataFrame, marks: DataFrame, targets: Mapping[str, float] = TARGETS,
    id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Rates that bring expected domain token totals to the targets.

    `marks` is a labelled table (doc_id, domain) with domains out of
    `targets`, which are shares of all tokens (normalised here). Columns:
    doc_id, n_tokens (words), posterior (in the order of the targets), rate,
    copies. Rates are scaled so that the largest of the table is 1, whatever
    the classifier can tell apart; each document is drawn at its rate by a
    hash of its id, so expected totals are in the proportion of the targets.

    Null and empty texts have no words; their posterior comes from the
    statistics alone. Labels that are null or name no target are not used;
    of several for one id the first by name counts. Without usable labels
    all domains are equally likely and all rates are 1. Rows without an id
    share one draw. Repeated rows each give a row; other columns are ignored.
    """
    domains = list(targets)
    share = [targets[d] / sum(targets.values()) for d in domains]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    usable = marks.select(F.col("doc_id"), F.col("domain")).filter(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
    usable = usable.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    prior, ratios = fit_posteriors(rows, usable, domains, sample_rows)
    read = with_buckets(rows)
    members = materialize(
        read.select("doc_id", "n_tokens", weighed(F.col("buckets"), ratios).alias("buckets"))
        .select("doc_id", "n_tokens", log_scores(F.col("buckets"), prior, ratios).alias("scores"))
        .select("doc_id", "n_tokens", _soft(F.col("scores")).alias("posterior")),
        "members",
    )
    steps = solve_rates(members, share)
    plain = rate_of(F.col("posterior"), steps)
    top = members.agg(F.max(plain)).first()[0] or 1.0
    rate = plain / F.lit(top)
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(F.col("rate") + draw).cast("int")
    return members.withColumn("rate", rate).withColumn("copies", copies)


def mixed(docs: DataFrame, marks: DataFrame, **options) -> DataFrame:
    """The documents that the rates draw, all columns.

    Repeated rows share their draw, and so do rows without an id. Without
    usable labels all documents stay; an empty table stays empty.
    """
    chosen = (
        mix(docs, marks, **options).groupBy(F.col("doc_id").alias("_drawn_id")).agg(F.max("copies").alias("_copies"))
        .filter("_copies > 0").select("_drawn_id")
    )
    return docs.join(chosen, docs[options.get("id_col", "doc_id")].eqNullSafe(chosen["_drawn_id"]), "left_semi")
