"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tillspark.llm.common import BLANKS, Shipped, components, mix64
from tillspark.session import materialize, shuffle_width

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 12, 4
RARE = 1e-3
SLICE_CHARS = 1_500_000
FLUSH = 1_500_000
PAIRS = 1_000
STEP = 1 << 16
SEED = 0x5EED
SLACK = 1e-9


def _hash_tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    letters = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    turns = np.full(1 << 10, int(rng.integers(1, 1 << 62)) * 2 + 1, np.uint64)
    turns[0] = 1
    return letters, np.cumprod(turns)


_LETTERS, _POWERS = _hash_tables()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the number of words of each text.

    A word's hash sums its bytes, each times a power for its place; beyond
    the table of powers the places start again under another mix.
    """
    flat = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    blank = flat == 32
    begin = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    end = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    edges = np.cumsum([len(t) + 1 for t in texts])
    sizes = np.bincount(np.searchsorted(edges, begin, side="right"), minlength=len(texts))
    if not len(begin):
        return np.zeros(0, np.uint64), sizes
    place = np.arange(len(flat), dtype=np.int32)
    place -= np.repeat(np.append(0, begin).astype(np.int32), np.diff(np.concatenate([[0], begin, [len(flat)]])))
    terms = _LETTERS[flat]
    far = np.flatnonzero(place >= len(_POWERS))
    terms[far] = mix64(terms[far] + (place[far] >> 10).astype(np.uint64))
    place &= len(_POWERS) - 1
    terms *= _POWERS[place]
    sums = np.append(np.uint64(0), np.cumsum(terms))
    return mix64(sums[end] - sums[begin] + (end - begin).astype(np.uint64)), sizes


class Shingles:
    """Word shingles of several texts: hashes and counts, by text and then hash."""

    def __init__(self, texts: list[str], words: int = WORDS):
        """`texts` hold words parted by single spaces. Texts with fewer words are one shingle."""
        flat, sizes = word_hashes([t.encode("utf-8", "surrogatepass") for t in texts])
        grams = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
        owner = np.repeat(np.arange(len(texts)), grams)
        first = np.repeat(np.cumsum(sizes) - sizes, grams) + np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams)
        padded = np.concatenate([flat, np.zeros(words, np.uint64)])
        short = sizes[owner] < words
        mixed = np.zeros(len(owner), np.uint64)
        for k in range(words):
            part = padded[first + k]
            if short.any():
                part = np.where(short & (k >= sizes[owner]), np.uint64(0), part)
            mixed = (mixed ^ part) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)
        # Text number and 44 bits of the hash in one number, so that one plain sort does.
        mixed = np.sort(mix64(mixed) >> np.uint64(20) | owner.astype(np.uint64) << np.uint64(44))
        at = np.flatnonzero(np.append(True, mixed[1:] != mixed[:-1])[: len(mixed)])
        self.owner = (mixed[at] >> np.uint64(44)).astype(np.int64)
        self.hashes = mix64((mixed[at] & np.uint64((1 << 44) - 1)) + np.uint64(1))
        self.counts = np.diff(np.append(at, len(mixed)))
        self.ends = np.searchsorted(self.owner, np.arange(len(texts) + 1))


def slices(frame: pd.DataFrame, column: str):
    """Parts of a frame of about SLICE_CHARS characters each."""
    size = frame[column].str.len().cumsum().to_numpy() // SLICE_CHARS
    for _, part in frame.groupby(size, sort=False):
        yield part


def _planes(values: np.ndarray) -> bytes:
    """Bytes of 32-bit values, the lowest bytes of all first; small values compress well so."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Weights:
    """TF-IDF weights: (1 + ln tf) x (1 + ln(N / max(df, RARE N)) / ln(1 / RARE)).

    The second factor is 2 for what at most RARE of all texts hold and falls
    to 1. Only shingles above that are listed: at most the mean number of
    shingles a text divided by RARE, whatever the size of the corpus.
    """

    def __init__(self, texts: int, buckets: int, keys: np.ndarray, df: np.ndarray):
        order = np.argsort(keys)
        self.buckets, self.keys = buckets, keys[order]
        share = np.clip(df[order] / max(1, texts), RARE, 1)
        self.factor = 1 + np.log(1 / share) / np.log(1 / RARE)

    def __call__(self, found: Shingles) -> np.ndarray:
        weight = np.full(len(found.hashes), 2.0)
        if len(self.keys):
            key = shingle_keys(found.hashes, self.buckets)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            weight = np.where(self.keys[at] == key, self.factor[at], weight)
        return weight * (1 + np.log(found.counts))


def shingle_keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32-bit hash within it, as one number."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def learn_weights(texts: DataFrame) -> Weights:
    """Document frequencies over all texts (column `body`).

    Tasks send sorted hashes in packed runs, one for each bucket; a bucket
    adds up its runs and keeps what more than RARE of all texts hold.
    """
    spark = texts.sparkSession
    buckets = 2 * shuffle_width(spark)
    total = texts.count()
    least = max(1.0, RARE * total)

    def pack(keys: list[np.ndarray]) -> pd.DataFrame:
        keys, n = np.unique(np.concatenate(keys), return_counts=True)
        bucket = (keys >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets + 1))
        out = []
        for a, b in zip(edges, edges[1:]):
            low = (keys[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            out.append((bucket[a], _planes(np.diff(low, prepend=np.uint32(0))), _planes(n[a:b])))
        return pd.DataFrame(out, columns=["bucket", "steps", "n"])

    def collect(frames):
        held, size = [], 0
        for frame in frames:
            for part in slices(frame, "body"):
                held.append(shingle_keys(Shingles(part["body"].tolist()).hashes, buckets))
                size += len(held[-1])
                if size >= FLUSH:
                    yield pack(held)
                    held, size = [], 0
        if size:
            yield pack(held)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        values = np.concatenate([np.cumsum(_unplanes(s), dtype=np.uint32) for s in frame["steps"]])
        n = np.concatenate([_unplanes(s) for s in frame["n"]])
        order = np.argsort(values, kind="stable")
        values = values[order]
        at = np.flatnonzero(np.diff(values.astype(np.int64), prepend=-1))
        df = np.add.reduceat(n[order].astype(np.int64), at)
        often = df > least
        return pd.DataFrame({"bucket": frame["bucket"].iloc[0], "value": values[at][often].astype(np.int64), "df": df[often]})

    rows = (
        texts.select("body").mapInPandas(collect, "bucket long, steps binary, n binary")
        .groupBy("bucket").applyInPandas(merge, "bucket long, value long, df long").toPandas()
    )
    keys = rows["bucket"].to_numpy(np.uint64) << np.uint64(32) | rows["value"].to_numpy(np.uint64)
    return Weights(total, buckets, keys, rows["df"].to_numpy(np.float64))


class Sampler:
    """Consistent weighted samples, taken from a hash of the shingle.

    For each sample a shingle draws r and c from Gamma(2, 1) and b from
    [0, 1); with t = floor(ln w / r + b) it offers ln c - r (t - b) - r, and
    the least offer wins. An offer depends on the weight through t alone, so
    two texts agree exactly where the same shingle wins with the same t,
    which happens with their weighted Jaccard similarity.
    """

    def __init__(self, samples: int):
        rng = np.random.default_rng(SEED)
        self.seeds = rng.integers(1, 1 << 63, samples, dtype=np.uint64)
        self.turns = rng.integers(1, 1 << 63, samples, dtype=np.uint64) | np.uint64(1)
        # Quantiles of Gamma(2, 1) at the middles of 2^16 steps, by bisection.
        level = (np.arange(1 << 16) + 0.5) / (1 << 16)
        low, high = np.zeros(1 << 16), np.full(1 << 16, 40.0)
        for _ in range(60):
            middle = (low + high) / 2
            under = 1 - (1 + middle) * np.exp(-middle) < level
            low, high = np.where(under, middle, low), np.where(under, high, middle)
        self.gamma = high.astype(np.float32)
        self.log_gamma = np.log(high).astype(np.float32)
        self.uniform = level.astype(np.float32)

    def __call__(self, hashes: np.ndarray, weights: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Least offers, one row a text; texts between `ends` must not be empty."""
        out = np.empty((len(ends) - 1, len(self.seeds)), np.float32)
        log_weight = np.log(weights).astype(np.float32)
        low_text = 0
        while low_text < len(ends) - 1:
            high_text = max(low_text + 1, int(np.searchsorted(ends, ends[low_text] + STEP, side="right")) - 1)
            a, b = ends[low_text], ends[high_text]
            h, lw, starts = hashes[a:b], log_weight[a:b], ends[low_text:high_text] - a
            for j, (seed, turn) in enumerate(zip(self.seeds, self.turns)):
                x = (h ^ seed) * turn
                x ^= x >> np.uint64(32)
                x = x.view(np.int64)
                r = self.gamma.take(x & 0xFFFF)
                shift = self.uniform.take((x >> 32) & 0xFFFF)
                t = lw / r
                t += shift
                np.floor(t, out=t)
                t -= shift
                t += 1
                t *= r
                offer = self.log_gamma.take((x >> 16) & 0xFFFF)
                offer -= t
                out[low_text:high_text, j] = np.minimum.reduceat(offer, starts)
            low_text = high_text
        return out


def band_hashes(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash for each band of samples."""
    bits = np.ascontiguousarray(samples).view(np.uint32).astype(np.uint64).reshape(len(samples), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(samples), bands)).copy()
    for k in range(rows):
        out = mix64((out ^ bits[:, :, k]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return out.view(np.int64)


def similarity(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (hashes, weights)."""
    _, i, j = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    shared = np.minimum(one[1][i], two[1][j]).sum()
    return float(shared / max(1e-300, one[1].sum() + two[1].sum() - shared))


def _sign(rows: DataFrame, weights: Shipped, bands: int, per_band: int) -> DataFrame:
    def sign(frames):
        sampler = Sampler(bands * per_band)
        for frame in frames:
            for part in slices(frame, "body"):
                found = Shingles(part["body"].tolist())
                filled = np.flatnonzero(np.diff(found.ends))
                hashes, total = np.empty((len(part), bands), np.int64), np.zeros(len(part))
                if len(filled):
                    ends = np.append(found.ends[filled], found.ends[-1])
                    w = weights.value(found)
                    hashes[filled] = band_hashes(sampler(found.hashes, w, ends), bands, per_band)
                    total[filled] = np.add.reduceat(w, ends[:-1])
                lists = [list(h) if e else [] for h, e in zip(hashes, np.diff(found.ends))]
                yield pd.DataFrame(
                    {"doc_id": part["doc_id"], "node": part["node"], "total": total, "buckets": lists}
                ).astype({"doc_id": "Int64"})

    return rows.select("doc_id", "node", "body").mapInPandas(
        sign, "doc_id long, node string, total double, buckets array<long>"
    )


def _private(bodies: DataFrame, weights: Shipped) -> DataFrame:
    """Weight of the shingles that no other of these nodes holds: columns node, private."""

    def spread(frames):
        for frame in frames:
            for part in slices(frame, "body"):
                found = Shingles(part["body"].tolist())
                names = np.frombuffer(bytes.fromhex("".join(part["node"])), ">i8").reshape(-1, 2).astype(np.int64)
                yield pd.DataFrame({
                    "shingle": found.hashes.view(np.int64), "weight": weights.value(found),
                    "high": names[found.owner, 0], "low": names[found.owner, 1],
                })

    rows = bodies.select("node", "body").mapInPandas(spread, "shingle long, weight double, high long, low long")
    name = F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("high", "low")]))
    return (
        rows.groupBy("shingle")
        .agg(F.count("*").alias("n"), F.min("high").alias("high"), F.min("low").alias("low"), F.min("weight").alias("weight"))
        .filter("n = 1").groupBy("high", "low").agg(F.sum("weight").alias("private"))
        .select(name.alias("node"), "private")
    )


def _may_match(similar: float) -> Column:
    """Whether two nodes can be similar, by their weights alone.

    They share at most what neither holds alone, so their similarity is at
    most that over the sum of both weights less it.
    """
    most = F.least(F.col("total_a") - F.col("private_a"), F.col("total_b") - F.col("private_b"))
    return most >= (similar - SLACK) * (F.col("total_a") + F.col("total_b") - most)


def _verified(pairs: DataFrame, bodies: DataFrame, weights: Shipped, similar: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""

    def check(frames):
        for frame in (f.iloc[low:low + PAIRS] for f in frames for low in range(0, len(f), PAIRS)):
            names = np.unique(np.concatenate([frame["a"].to_numpy(str), frame["b"].to_numpy(str)]))
            texts = dict(zip(frame["a"], frame["body_a"])) | dict(zip(frame["b"], frame["body_b"]))
            known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            for part in slices(pd.DataFrame({"node": names, "body": [texts[n] for n in names]}), "body"):
                found = Shingles(part["body"].tolist())
                w = weights.value(found)
                for i, name in enumerate(part["node"]):
                    own = slice(found.ends[i], found.ends[i + 1])
                    known[name] = found.hashes[own], w[own]
            kept = [similarity(known[a], known[b]) >= similar for a, b in zip(frame["a"], frame["b"])]
            yield frame.loc[kept, ["a", "b"]]

    both = (
        pairs.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a")
        .join(bodies.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b")
    )
    return both.select("a", "b", "body_a", "body_b").mapInPandas(check, "a string, b string")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    similar: float = SIMILAR, bands: int = BANDS, rows_per_band: int = ROWS,
) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept.

    Texts are similar if the weighted Jaccard similarity of their shingles
    of WORDS lower-case words (parted by white space) is at least `similar`.
    A class is what similar texts connect; class_id is its smallest doc_id.

    Equal texts form one node. Nodes that share a band meet in a bucket.
    What a node holds alone bounds its similarity to all others, and pairs
    that the bound rules out are never made. All nodes of a bucket are
    compared with the one that holds least alone (in a group of copies, the
    text they come from), then those that are still in different classes
    with each other. So links are found without all pairs of a large group,
    and none within a bucket is left out.

    Null, empty and blank texts have no shingles and are classes of their
    own; texts of fewer words than WORDS are one shingle. Rows without an id
    have class_id null unless a similar row has one. Repeated rows are in one
    class, and each is reported. Other columns are ignored.
    """
    spark = docs.sparkSession
    body = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), BLANKS, " "))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body")).withColumn("node", F.md5("body"))
    weights = Shipped(spark, learn_weights(rows))
    signed = materialize(_sign(rows, weights, bands, rows_per_band), "signed")
    nodes = signed.filter(F.size("buckets") > 0)
    members = materialize(
        nodes.select("node", F.explode("buckets").alias("bucket")).groupBy("bucket", "node").agg(F.lit(1).alias("one")).drop("one"),
        "members",
    )
    crowded = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    # Buckets of several nodes hold all that is ever compared.
    shared = materialize(members.join(crowded.select("bucket"), "bucket", "left_semi"), "shared")
    involved = shared.select("node").distinct()
    bodies = materialize(
        rows.select("node", "body").join(involved, "node", "left_semi").groupBy("node").agg(F.first("body").alias("body")),
        "bodies",
    )
    weighed = (
        nodes.groupBy("node").agg(F.max("total").alias("total"))
        .join(_private(bodies, weights), "node", "left").withColumn("private", F.coalesce("private", F.lit(0.0)))
        .filter(F.col("total") - F.col("private") >= (similar - SLACK) * F.col("total"))
    )
    meeting = materialize(shared.join(weighed, "node"), "meeting")
    heads = meeting.groupBy("bucket").agg(
        F.min(F.struct((F.col("private") / F.col("total")).alias("share"), "node", "total", "private")).alias("head"),
        F.count("*").alias("n"),
    ).filter("n > 1").select(
        "bucket", F.col("head.node").alias("x"), F.col("head.total").alias("total_a"), F.col("head.private").alias("private_a")
    )
    others = meeting.select(
        "bucket", F.col("node").alias("y"), F.col("total").alias("total_b"), F.col("private").alias("private_b")
    )
    in_order = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    pairs = materialize(
        others.join(heads, "bucket").filter((F.col("x") != F.col("y")) & _may_match(similar)).select(*in_order).distinct(), "pairs"
    )
    links = materialize(_verified(pairs, bodies, weights, similar), "similar")
    named = meeting.join(components(links).withColumnRenamed("component", "label"), "node", "left").withColumn(
        "label", F.coalesce("label", "node")
    )
    mixed = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y")
    left = materialize(named.join(mixed.select("bucket"), "bucket", "left_semi"), "left")
    # A pair is made in the smallest of its buckets only.
    met = left.groupBy("node").agg(F.array_sort(F.collect_list("bucket")).alias("met"))
    left = left.join(met, "node")
    one, two = (
        left.select(
            "bucket", F.col("node").alias(name), F.col("label").alias(f"label_{side}"),
            F.col("total").alias(f"total_{side}"), F.col("private").alias(f"private_{side}"),
            F.col("met").alias(f"met_{side}"),
        )
        for name, side in (("x", "a"), ("y", "b"))
    )
    more = materialize(
        one.join(two, "bucket").filter(
            (F.col("x") < F.col("y")) & (F.col("label_a") != F.col("label_b")) & _may_match(similar)
            & (F.array_min(F.array_intersect("met_a", "met_b")) == F.col("bucket"))
        ).select(*in_order).join(pairs, ["a", "b"], "left_anti"),
        "pairs",
    )
    labels = components(links.union(materialize(_verified(more, bodies, weights, similar), "similar")))
    classes = signed.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # Texts without shingles share one node, but each is a class of its own.
    filled = classes.filter(F.size("buckets") > 0)
    sizes = filled.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    grouped = filled.select("doc_id", "component").join(sizes, "component").select("doc_id", "class_id", "class_size")
    alone = classes.filter(F.size("buckets") == 0).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")
    )
    return grouped.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with one document of each class, all columns. Rows that repeat a kept id stay."""
    kept = near_groups(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")
