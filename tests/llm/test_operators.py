"""The training-data operators against brute force, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillspark.llm import (
    disclosure, domain_mix, exact_dedup, language, lm_mixing, packing, pivots, quality, queries, severity, weighted_minhash,
)

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, body string, kept boolean"


def held(doc_id, parts):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, a very long word, ties, repeated rows, columns with clashing names."""
    long = "ab" * 40_000
    texts = [
        None, "", "  \n", "!!! 123", "one two", "one  two", "One two three four five six seven", long, long, "x " * 3000,
        "mail a.b@c.de or +1 (23) 456-7890 or 1.2.3.4 or 4111 1111 1111 1111", "été \U0001f600 fin", "<|endoftext|> a",
    ]
    rows = [(i, t, "en" if i % 2 else None, None, None, 0.5, "b", True) for i, t in enumerate(texts)]
    rows += [(3, texts[3], None, None, None, None, None, None), (None, "one two", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


APPLY = {
    "lm": lambda d, m: lm_mixing.score_texts(d),
    "exact": lambda d, m: exact_dedup.exact_groups(d),
    "quality": lambda d, m: quality.score_quality(d, m),
    "disclosure": lambda d, m: disclosure.digest_columns(disclosure.find(d)),
    "near": lambda d, m: weighted_minhash.near_groups(d),
    "mixing": lambda d, m: domain_mix.mix(d, domain_mix.default_domains(m)),
    "severity": lambda d, m: severity.score_toxicity(d, m),
    "language": lambda d, m: language.identify(d),
}


@pytest.mark.parametrize("name", sorted(APPLY))
def test_odd_rows_each_give_a_row(odd, marks, name):
    result = APPLY[name](odd, marks).collect()
    assert sorted(map(str, (r["doc_id"] for r in result))) == sorted(str(r["doc_id"]) for r in odd.collect())


@pytest.mark.parametrize("name", sorted(APPLY))
def test_empty_tables(no_docs, marks, name):
    assert APPLY[name](no_docs, marks.limit(0)).collect() == []


def test_exact_groups_of_odd_rows(odd):
    by_id = {r["doc_id"]: r for r in exact_dedup.exact_groups(odd).collect()}
    assert (by_id[1]["keep_id"], by_id[1]["group_size"], by_id[1]["kept"]) == (0, 2, False)
    assert by_id[5]["keep_id"] == 4 and by_id[None]["keep_id"] == 4 and not by_id[None]["kept"]
    assert by_id[2]["text_sha256"] == hashlib.sha256(b" ").hexdigest()
    assert exact_dedup.keep_first(odd).count() == 10


def test_exact_groups_of_one_digest_compare_texts(docs):
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs).collect()}
    rows = [(r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in docs.collect()]
    groups: dict[str, list[int]] = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    assert got == {(i, min(groups[t]), len(groups[t])) for i, t in rows}


def test_exact_groups_move_no_text_past_its_digest(spark, monkeypatch):
    """Also where different texts share a digest."""
    kept = []
    monkeypatch.setattr(exact_dedup, "materialize", lambda df, *a: kept.append(df) or df)
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: exact_dedup.F.substring(c, 1, 1))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "ab", "ab", "b", "b", "c", "aa", "aa"])], "doc_id long, text string")
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect())
    assert got == [
        (0, 0, 3, True), (1, 1, 2, True), (2, 1, 2, False), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 1, True), (6, 0, 3, False), (7, 0, 3, False),
    ]
    assert [sorted(df.columns) for df in kept] == [["digest", "group_size", "keep_id", "texts"]]


def test_base_score_is_the_unigram_model(docs):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(lower)) + [None] for r in docs.collect()}
    count = Counter(w for i, t in tokens.items() if held(i, 7) != 2 for w in t)
    total = sum(count.values())
    for r in lm_mixing.score_texts(docs).collect():
        own = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in count for w in own), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in own), abs=1e-6)
        assert r["held_out"] == (held(r["doc_id"], 7) == 2) and r["score"] < 0 and r["bits_per_byte"] > 0


def test_model_probabilities_of_words_do_not_exceed_one():
    sample = [b"the cat sat on the mat", b"the dog sat on the log"] * 4
    coder = lm_mixing.Coder(sample)
    share = (0.5 ** coder.size).sum(1)
    assert share[0] == pytest.approx(1) and (share <= 1 + 1e-9).all()
    learner = lm_mixing.Learner(coder)
    learner.learn(lm_mixing.Words(sample, coder), np.ones(len(sample), bool))
    assert learner.words == sum(len(t.split()) + 1 for t in sample)


def test_contexts_of_different_words_never_share_counts():
    rng = np.random.default_rng(5)
    words = sorted({bytes(rng.integers(97, 123, rng.integers(4, 12)).astype(np.uint8)) for _ in range(20_000)})
    coder = lm_mixing.Coder([b"the cat sat on the mat", b"the dog sat on the log"])
    found = lm_mixing.Words([b" ".join(words)], coder)
    which = np.arange(1, len(found.hashes))
    _, keys, _ = lm_mixing.bit_rows(found, which, np.zeros(len(which), np.int64), coder)
    code, contexts = coder.pair, set()
    for word in words:
        spelt = word + b" "
        for i, byte in enumerate(spelt):
            pair = (spelt[i - 1] if i else 0) + 256 * (spelt[i - 2] if i > 1 else 0)
            first, size = coder.first[code[pair], byte], coder.size[code[pair], byte]
            contexts |= {(spelt[:i], int(step) >> 1) for step in coder.steps[first:first + size]}
    assert len(np.unique(keys[2])) == len(contexts)


def test_every_word_teaches_whatever_the_partitions(docs, monkeypatch):
    made, plain = [], lm_mixing.Model

    class Seen(plain):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self.weights)

    monkeypatch.setattr(lm_mixing, "Model", Seen)
    scores = []
    for parts in (1, 7):
        rows = lm_mixing.score_texts(docs.repartition(parts, "doc_id")).select("doc_id", "score").collect()
        scores.append([r["score"] for r in sorted(rows, key=lambda r: (r["doc_id"], r["score"]))])
    assert np.abs(made[0] - lm_mixing._first_weights()).max() > 0.01
    assert made[0] == pytest.approx(made[1], abs=1e-9) and scores[0] == pytest.approx(scores[1], rel=1e-6)


def test_lexicon_hands_over_a_word_once_a_task(monkeypatch):
    """Whatever the slices; words beyond the bound go in parts, with the same sums."""
    texts = [f"the cat{i % 50} sat {'x' * (i % 7)}" for i in range(400)]
    count = Counter(w for t in texts for w in t.split())
    monkeypatch.setattr(lm_mixing, "SLICE_TEXTS", 30)
    shared = SimpleNamespace(value=lm_mixing.Coder())
    for bound in (10_000, 40):
        monkeypatch.setattr(lm_mixing, "LEXICON_WORDS", bound)
        found = pd.concat(lm_mixing._lexicon(shared)(iter([pd.DataFrame({"text": texts[k:k + 100]}) for k in range(0, 400, 100)])))
        sums = found.groupby("spelt")["n"].sum()
        assert {k.decode(): n for k, n in sums.items()} == count and found.groupby("spelt")["hash"].nunique().max() == 1
        assert bound < 10_000 or len(found) == len(count)


def test_code_and_classes_follow_every_training_text(spark, monkeypatch):
    """What comes late in a text, or in one text of many, counts for the byte code and the markers of classes."""
    made = []

    class Seen(lm_mixing.Shipped):
        def __init__(self, session, value):
            super().__init__(session, value)
            made.append(value)

    monkeypatch.setattr(lm_mixing, "Shipped", Seen)
    ids = [i for i in range(1, 3_000) if held(i, 7) != 2]
    assert len(ids) > 2_200
    rows = [(i, "aa ab", None, None, None, None, None, None) for i in ids]
    late = (10_000, "aa " * 7_000 + "qzw " * 300, None, None, None, None, None, None)
    assert held(late[0], 7) != 2
    table = spark.createDataFrame([*rows, late], SCHEMA)
    assert lm_mixing.score_texts(table).count() == len(rows) + 1
    coder = [c for c in made if isinstance(c, lm_mixing.Coder)][-1]
    assert coder.pair[ord("z") + 256 * ord("q")] > 0
    words = lm_mixing.Words([b"qzw"], coder)
    assert words.hashes[1] in coder.markers


def test_statistics_and_isotonic_fit():
    knots, levels = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 2, 1, 3]), np.array([2.0, 2, 2, 3]))
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) > 0).all()
    assert len(quality.statistics("A b.\nc d")) == len(quality.STATISTICS) == len(quality.statistics(""))


def test_quality_of_held_out_rows(docs, labels):
    mark = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = [(r["score"], mark[r["doc_id"]]) for r in quality.score_quality(docs, labels).collect() if r["held_out"] and r["doc_id"] in mark]
    good = [s for s, m in got if m == 1]
    bad = [s for s, m in got if m == 0]
    assert not bad or np.mean(good) > np.mean(bad) + 0.3


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and disclosure.luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]
            if fits:
                yield kind, *m.span()


@pytest.mark.parametrize("text", [
    "a@b.c_d@e.f x@y z@w.", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 001.2.3.4", "a@@b.c a..b@c-d.e.f, +1 234 567 8901)", "1" * 60 + ".1.1.1",
    "4111-1111 1111-1111 4111 1111 1111 1112", "a@b@c.de %@x.y", "+12 (34) 567.8-9", "9" * 3000,
])
def test_base_spans(text):
    assert disclosure.base_spans(text) == list(plain_spans(text))


def test_base_spans_of_documents(docs):
    for r in docs.collect():
        assert disclosure.base_spans(r["text"]) == list(plain_spans(r["text"]))


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"word{i % 7}x common text zebrafan wrote from john@example.com today plain{'abcdefg'[i % 7]}") for i in range(8)]
    rows += [(100 + i, "common text today and more common words from others") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in disclosure.sanitise(docs).collect()}
    assert "zebrafan" not in found[0]["text"] and "john@" not in found[0]["text"] and "common" in found[0]["text"]
    assert found[100]["text"] == rows[8][1]


def test_terms_of_copied_texts_and_later_occurrences(spark):
    """All copies count, and a term goes wherever it stands in a text with the entity."""
    copy = "ask zebrafan at john@example.com for it, and then some more words follow until Zebrafan signs"
    rows = [(i, copy) for i in range(100)] + [(500 + i, "other words of other people, more and more of them") for i in range(300)]
    rows += [(900, "nobody else writes zebra or fan")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in disclosure.sanitise(docs).collect()}
    for i in range(100):
        assert "zebrafan" not in found[i]["text"].lower() and "[EMAIL]" in found[i]["text"]
        spans = [(s["start"], s["end"]) for s in found[i]["spans"] if s["kind"] == "term" and copy[s["start"]:s["end"]].lower() == "zebrafan"]
        assert spans == [(m.start(), m.end()) for m in re.finditer("zebrafan", copy, re.I)]
    assert all(found[i]["text"] == t for i, t in rows[100:])


def test_term_spans_against_direct_counts(spark):
    import random

    rng = random.Random(4)
    words = ["amber", "birch", "cedar", "delta", "ember", "fable", "grove", "hazel", "indigo", "jasper"]
    rows = []
    for i in range(400):
        said = [rng.choice(words) for _ in range(rng.randrange(3, 12))]
        if i % 3 == 0:
            who = rng.choice(["a@x.org", "b@y.org", "10.0.0.7"])
            close = {"a@x.org": "quartz", "b@y.org": rng.choice(["raven", "quartz"]), "10.0.0.7": "sable"}[who]
            at = rng.randrange(len(said) + 1)
            said[at:at] = [close, who]
            said.append(rng.choice([close, "tail"]))
        elif rng.random() < 0.05:
            said.append("sable")
        rows.append((i, " ".join(said)))
    texts = dict(rows)
    ents = {i: {(k, texts[i][a:b].lower()) for k, a, b in disclosure.base_spans(t)} for i, t in rows}
    held = {i: e | {(k, None) for k, _ in e} for i, e in ents.items()}
    near, holds = Counter(), Counter()
    for i, t in rows:
        own = {
            (k, v, w) for k, a, b in disclosure.base_spans(t) for w, s, e in disclosure.neighbours(t, a, b)
            for v in (t[a:b].lower(), None) if not any(s < y and x < e for _, x, y in disclosure.base_spans(t))
        }
        near.update(own)
        holds.update({w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)})
    around = Counter(e for h in held.values() for e in h)
    ratio = {}
    for (k, v, w), both in near.items():
        if both >= disclosure.SUPPORT:
            n = len(rows)
            share = math.log2(both * n / (max(holds[w], both) * around[k, v])) / math.log2(n / min(around[k, v], n / 2))
            if share >= disclosure.DISCLOSES:
                ratio[k, v, w] = share
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: {(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "term"} for r in disclosure.find(docs).collect()}
    for i, t in rows:
        taken = [(a, b) for _, a, b in disclosure.base_spans(t)]
        expected = {
            m.span() for m in re.finditer(r"[^\W\d_]{3,}", t)
            if any((k, v, m[0].lower()) in ratio for k, v in held[i]) and not any(m.start() < b and a < m.end() for a, b in taken)
        }
        assert got[i] == expected, (i, t)
    assert any(got.values()) and len({w for _, _, w in ratio}) >= 2


def test_near_groups_hold_all_similar_pairs(spark, docs):
    base = " ".join(f"w{k}" for k in range(120))
    rows = [(900_000, base), (900_001, base.replace("w60 ", "changed ")), (900_002, base.upper()), (900_003, "w1 w2 w3 quite another text here")]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra)
    got = {r["doc_id"]: r["class_id"] for r in weighted_minhash.near_groups(both).collect()}
    assert got[900_001] == got[900_002] == 900_000 and got[900_003] == 900_003
    sets = {}
    for r in both.collect():
        w = (r["text"] or "").lower().split()
        sets[r["doc_id"]] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            shared = len(sets[a] & sets[b])
            if shared and shared / len(sets[a] | sets[b]) >= 0.9:
                assert got[a] == got[b], (a, b)


def test_weights_held_alone_bound_similarity(spark):
    rng = np.random.default_rng(5)
    texts = {}
    for k in range(40):
        words = [f"w{i}" for i in range(60)]
        for i in rng.integers(0, 60, k % 7):
            words[i] = f"new{rng.integers(0, 30)}"
        texts[f"{k:032x}" if k % 2 else f"f{k:031x}"] = " ".join(words[: 60 - k % 3])
    bodies = spark.createDataFrame(list(texts.items()), "node string, body string")
    weights = weighted_minhash.Shipped(spark, weighted_minhash.Weights(10, 4, np.zeros(0, np.uint64), np.zeros(0)))
    alone = {r["node"]: r["private"] for r in weighted_minhash._private(bodies, weights).collect()}
    found = {n: weighted_minhash.Shingles([t]) for n, t in texts.items()}
    holders = Counter(h for f in found.values() for h in f.hashes.tolist())
    weighed = {}
    for name, f in found.items():
        w = weights.value(f)
        assert alone.get(name, 0.0) == pytest.approx(sum(x for h, x in zip(f.hashes.tolist(), w) if holders[h] == 1))
        weighed[name] = (name, float(w.sum()), float(alone.get(name, 0.0)))
    one, two = (
        spark.createDataFrame(list(weighed.values()), f"{n} string, total_{s} double, private_{s} double")
        for n, s in (("x", "a"), ("y", "b"))
    )
    may = {(r["x"], r["y"]) for r in one.join(two, one["x"] < two["y"]).filter(weighted_minhash._may_match(0.8)).collect()}
    similar = {
        (a, b) for a in texts for b in texts if a < b and weighted_minhash.similarity(
            (found[a].hashes, weights.value(found[a])), (found[b].hashes, weights.value(found[b]))
        ) >= 0.8
    }
    assert similar and similar <= may and len(may) < len(texts) * (len(texts) - 1) // 2


def test_samples_agree_as_often_as_texts_are_similar():
    one, two = (weighted_minhash.Shingles([t]) for t in ("a b c d e f g h i j k l m n", "a b c d e f g h i j k l m x"))
    sampler = weighted_minhash.Sampler(2000)
    w1, w2 = np.full(len(one.hashes), 2.0), np.full(len(two.hashes), 1.5)
    agree = (sampler(one.hashes, w1, one.ends) == sampler(two.hashes, w2, two.ends)).mean()
    assert agree == pytest.approx(weighted_minhash.similarity((one.hashes, w1), (two.hashes, w2)), abs=0.04)


def test_similar_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 32))
    near = x[:100] + rng.normal(size=(100, 32)) * 0.3
    x = np.vstack([x, near, x[:5], x[:5]])
    labels = np.concatenate([np.arange(300) % 3, np.arange(100) % 3, np.arange(5) % 3, np.arange(5) % 3])
    rows = [(i, [float(v) for v in row], int(label)) for i, (row, label) in enumerate(zip(x, labels))]
    bad = [[0.0] * 32, [float("nan")] * 32, None, [], [None] * 32]
    rows += [(1000 + i, v, 1) for i, v in enumerate(bad)] + [(2000, [1.0] * 32, None)]
    got = {r["vec_id"]: r for r in pivots.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(links, False)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert 0.9 * links.sum() <= found <= links.sum()
    assert all(got[i]["n_links"] <= links[i].sum() for i in range(len(x)))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in [*range(1000, 1005), 2000])
    assert got[400]["component_id"] == got[405]["component_id"] == 0


def test_no_vectors(spark):
    assert pivots.similar_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


@pytest.mark.parametrize("which", ["docs", "odd", "no_docs"])
def test_pieces_fill_sequences_without_gaps(request, which):
    from tokenizers import Tokenizer

    table = request.getfixturevalue(which)
    got = packing.pack(table).collect()
    slow = Tokenizer.from_file(packing.vocabulary())
    expected = Counter()
    for r in table.collect():
        ids = np.array([*slow.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        head = len(ids) % 2048
        cuts = ([0] if head else []) + list(range(head, len(ids), 2048))
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
            expected[r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    filled: dict[int, list[tuple[int, int]]] = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(filled) <= 1.02 * sum(r["length"] for r in got) / 2048 + 2


def test_rates_meet_the_targets(spark):
    folder = "/root/testdata/sf0.01"
    marks = domain_mix.default_domains(spark.read.parquet(f"{folder}/labels.parquet"))
    got = domain_mix.mix(spark.read.parquet(f"{folder}/documents.parquet"), marks).collect()
    p = np.array([r["posterior"] for r in got])
    tokens = np.array([r["rate"] * r["n_tokens"] for r in got])
    assert (tokens[:, None] * p).sum(0) / tokens.sum() == pytest.approx([0.90, 0.07, 0.03], abs=0.02)
    assert all(0 <= r["rate"] <= 1 and r["copies"] in (0, 1) for r in got)


def test_documents_of_small_rates_are_drawn(spark):
    kinds = {"clean": "sunny garden meadow river", "low": "buy cheap click offer", "toxic": "idiot moron hate stupid"}
    rows = [(3 * i + k, f"{words} t{i % 9} and more common text", name) for i in range(2_000) for k, (name, words) in enumerate(kinds.items())]
    table = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    got = domain_mix.mix(table.select("doc_id", "text"), table.select("doc_id", "domain")).collect()
    tokens = dict.fromkeys(kinds, 0)
    for r in got:
        tokens[rows[r["doc_id"]][2]] += r["n_tokens"] * r["copies"]
    share = np.array(list(tokens.values())) / sum(tokens.values())
    assert share == pytest.approx([0.90, 0.07, 0.03], abs=0.01)


def test_buckets_are_scored_once(spark):
    ratios = [[0.0] * domain_mix.BUCKETS]
    ratios[0][3] = ratios[0][5] = 1.0
    row = spark.range(1).select(domain_mix.weighed(F.array(*map(F.lit, (3, 4, 3, 5, 3))), ratios).alias("b")).first()
    assert row["b"] == [3, 5]


def test_rates_follow_plain_projected_descent(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.5, 0.5, 0.5], 200)
    n = rng.integers(1, 500, 200)
    table = spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(n, p)], "n_tokens long, posterior array<double>")
    target = [0.5, 0.3, 0.2]
    steps = domain_mix.solve_rates(table, target)
    start, rate = (n[:, None] * p).sum(0), np.ones(200)
    have = start
    for _ in steps:
        rate = np.maximum(0, rate - p @ ((have - n.sum() * np.array(target)) / start))
        have = (n[:, None] * rate[:, None] * p).sum(0)
    mine = [domain_mix.plain_rate(list(q), steps) for q in p]
    assert mine == pytest.approx(list(rate), abs=1e-4)
    assert have / have.sum() == pytest.approx(target, abs=1e-3)


def test_severity_orders_texts(spark):
    words = ["good day to all", "you idiot", "idiot idiot you moron idiot"]
    texts = [words[i % 3] + f" filler{i}" for i in range(90)]
    model = severity.Severity(texts, [int(i % 3 > 0) for i in range(90)])
    above = model.above(words).sum(1)
    assert above[0] < above[1] <= above[2] and (np.diff(model.cuts) >= 0).all()


def test_severity_holds_terms_as_numbers():
    """A fit takes no more memory than a few times its texts."""
    rng = random.Random(5)
    vocabulary = [f"{''.join(rng.choices('abcdefghij', k=8))}" for _ in range(3_000)]
    texts = [" ".join(rng.choices(vocabulary, k=500)) for _ in range(300)]
    tracemalloc.start()
    severity.Severity(texts, [i % 2 for i in range(300)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * sum(map(len, texts))


def test_automaton_accepts_exactly_the_factors():
    text = [1, 2, 1, 3, 1, 2, 2]
    moves = language.suffix_automaton(text)
    factors = {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)}
    reached, todo = {()}, [((), 0)]
    while todo:
        word, state = todo.pop()
        for symbol, target in moves[state].items():
            reached.add((*word, symbol))
            todo.append(((*word, symbol), target))
    assert reached == factors


def test_phrases_match_greedy_parsing():
    parser = language.CrossParser({"x": ["abab cab"], "y": ["dede fed"]}, 100)
    for text in ("abcab", "dedefab", "zz ab"):
        count, _ = parser.phrases([text])
        for k, sample in enumerate((" abab cab ", " dede fed ")):
            phrases, now = 1, ""
            for c in f" {text} ":
                if now + c in sample:
                    now += c
                else:
                    phrases, now = phrases + 1, c if c in sample else ""
            assert count[0, k] == phrases


def test_phrases_of_large_alphabets():
    rng = np.random.default_rng(8)
    letters = [chr(0x4E00 + i) for i in range(900)]
    texts = {}
    for name in ("b", "c"):  # the same characters in different words
        words = ["".join(rng.choice(letters, 3)) for _ in range(400)]
        texts[name] = ["".join(rng.choice(words, 4_000)) for _ in range(2)]
    texts["a"] = ["a latin text with letters of its own and no others"]
    parser = language.CrossParser({k: v[:1] for k, v in texts.items()}, 24_000)
    parts = [texts["b"][1][:600], texts["c"][1][:600], texts["b"][0][300:340] + "\u9fa0" + texts["c"][0][5:50]]
    count, _ = parser.phrases(parts)
    for text, row in zip(parts, count):
        for name, got in zip(parser.languages, row):
            sample, n, phrase = parser._plain(texts[name][0])[:24_000], 1, ""
            for c in parser._plain(text):
                phrase += c
                if phrase not in sample:
                    n, phrase = n + 1, c if c in sample else ""
            assert got == n
    assert [parser.languages[i] for i in parser.predict(parts[:2])[0]] == ["b", "c"]


def test_languages(docs):
    got = language.identify(docs).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in got if lang[r["doc_id"]]]
    assert np.mean(right) > 0.95


def test_texts_without_letters_have_no_language(odd):
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd).collect()}
    assert got[0] == got[1] == got[2] == got[3] == "und" != got[4]


def test_registered_queries_match_their_sql(spark):
    import oracle

    con = oracle.connect(SMALL)
    for name, sql in queries.LLM_SQL.items():
        assert oracle.difference(queries.LLM_QUERIES[name](spark, SMALL), con, sql) is None


def test_uninformative_table_keeps_most_of_its_documents(spark):
    """Words say nothing of the domain: all rates are about equal, so nearly all documents are drawn."""
    rows = [(i, f"w{i % 50} w{(i * 7) % 50} common words of any text", None, None, None, None, None, None) for i in range(1500)]
    marks = spark.createDataFrame([(i, int(i * 2654435761 % 7 < 5), 0) for i in range(1500)], "doc_id long, quality int, toxic int")
    got = domain_mix.mix(spark.createDataFrame(rows, SCHEMA), domain_mix.default_domains(marks)).collect()
    assert sum(r["copies"] for r in got) > 750 and max(r["rate"] for r in got) == pytest.approx(1)


def test_kept_rows_with_clashing_columns_and_repeated_ids(spark):
    schema = "doc_id long, text string, _body string, body string, id long, row string"
    rows = [(7, "one", "a", "b", 1, "c"), (7, "two", "d", None, 2, "e"), (7, "one ", "f", "g", 3, "h"), (8, "one", "i", "j", 4, "k")]
    kept = exact_dedup.keep_first(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "_body", "body", "id", "row"]
    assert sorted((r["doc_id"], r["text"].strip()) for r in kept.collect() if r["id"] != 3) == [(7, "one"), (7, "two")]


def test_language_of_slices_equals_that_of_whole_batches(docs, monkeypatch):
    parser = language.learn(docs)
    texts = [r["text"] for r in docs.collect()] + [None, "", "1 2 3", "x" * 50_000]
    best, score = parser.predict(texts)
    monkeypatch.setattr(language, "SLICE_CHARS", 3_000)
    sliced = parser.predict(texts)
    assert (sliced[0] == best).all() and sliced[1] == pytest.approx(score)


def test_shared_keys_and_local_ones_make_the_whole_table(docs, monkeypatch):
    """Whatever the units, every bit sees the counts of all words that share its context."""
    text = b" ".join((r["text"] or "").encode() for r in docs.limit(60).collect())
    words = lm_mixing.Words([text], lm_mixing.Coder([text]))
    coder = lm_mixing.Coder([text])
    spelt = sorted({words.flat[a:a + n].tobytes() for a, n in zip(words.start[1:], words.size[1:])})
    count = [1 + len(w) % 4 for w in spelt]
    sizes = [len(w) for w in spelt]
    flat = np.frombuffer(b"".join(spelt) + b"\0", np.uint8)
    spelling = lm_mixing.Spelling(flat, np.cumsum(sizes) - sizes, np.array(sizes))
    owner, keys, bit = lm_mixing.bit_rows(spelling, np.arange(len(spelt)), np.zeros(len(spelt), np.int64), coder)
    whole = []
    for key in keys:
        names, code = np.unique(key, return_inverse=True)
        weight = np.array(count, float)[owner]
        whole.append((np.bincount(code, weight * (bit == 0))[code], np.bincount(code, weight * bit)[code]))
    units, table = [], {}
    for low in range(0, len(spelt), 97):
        part = spelt[low:low + 97]
        row = {
            "a": lm_mixing._planes(np.frombuffer(b"".join(part), np.uint8), 1), "b": lm_mixing._planes(np.array([len(w) for w in part])),
            "c": lm_mixing._planes(np.ones(len(part), int), 1), "d": lm_mixing._planes(np.zeros(len(part), int), 1),
            "e": lm_mixing._planes(np.array(count[low:low + 97]), 8),
        }
        units.append((row, lm_mixing.Unit(row, coder)))
        for key, zero, one in zip(units[-1][1].keys, *units[-1][1].own_counts()):
            have = table.setdefault(key, [0, 0])
            have[0] += zero
            have[1] += one
    at = 0
    for row, unit in units:
        given = np.array([table[k] for k in unit.keys])
        row |= {"g": lm_mixing._planes(given[:, 0], 8), "h": lm_mixing._planes(given[:, 1], 8)}
        now = slice(at, at + len(unit.bit))
        for (zero, one), (all_zero, all_one) in zip(unit.corpus_counts(row), whole):
            assert (zero == all_zero[now]).all() and (one == all_one[now]).all()
        assert unit.edge.mean() < 0.8
        at = now.stop


def test_predictions_are_worked_out_once_a_context(monkeypatch):
    """Not once a bit, with the numbers that a bit's own counts give."""
    spelt = sorted({f"{a}{b}{'e' * k}".encode() for a in "abcdefgh" for b in "stuvw" for k in range(12)})
    count = np.array([len(w) % 4 for w in spelt])
    coder = lm_mixing.Coder([b" ".join(spelt)])
    row = {
        "a": lm_mixing._planes(np.frombuffer(b"".join(spelt), np.uint8), 1), "b": lm_mixing._planes(np.array([len(w) for w in spelt])),
        "c": lm_mixing._planes(np.ones(len(spelt), int), 1), "d": lm_mixing._planes(np.zeros(len(spelt), int), 1),
        "e": lm_mixing._planes(count, 8), "chunk": 0, "bucket": 0, "f": b"",
    }
    unit = lm_mixing.Unit(row, coder)
    zero, one = unit.own_counts()
    row |= {"g": lm_mixing._planes(3 * zero, 8), "h": lm_mixing._planes(2 * one, 8)}
    counts = unit.corpus_counts(row)
    level = lm_mixing._level
    inputs, gate = unit.inputs(row)
    assert all((x == lm_mixing._stretched(*c)).all() for x, c in zip(inputs, counts))
    assert (gate == level(sum(counts[3])) * lm_mixing.LEVELS + level(sum(counts[2]))).all()
    used = np.flatnonzero(unit.weight > 0)
    assert 0 < len(used) < len(unit.bit)
    bit = unit.bit[used]
    rest = [(z[used] - (bit == 0), o[used] - bit) for z, o in counts]
    inputs, gate = unit.inputs_of_others(row, used)
    assert all((x == lm_mixing._stretched(*c)).all() for x, c in zip(inputs, rest))
    assert (gate == level(sum(rest[3])) * lm_mixing.LEVELS + level(sum(rest[2]))).all()

    plain, made = lm_mixing._stretched, []
    monkeypatch.setattr(lm_mixing, "_stretched", lambda z, o: made.append(len(z)) or plain(z, o))
    monkeypatch.setattr(lm_mixing, "TaskContext", None)
    model = lm_mixing.Model(np.zeros(lm_mixing.GATES * (lm_mixing.PREDICTORS + 2 * lm_mixing.STEPS) + 1), np.zeros((2, lm_mixing.PLACES, 2)))
    bits, shared = len(unit.bit), SimpleNamespace(value=coder)
    for run in (lm_mixing._teach(shared, None), lm_mixing._spell(shared, SimpleNamespace(value=model))):
        made.clear()
        assert len(list(run(iter([pd.DataFrame([row])])))) == 1
        assert sum(made) < 2 * bits


def test_rounds_of_classes_read_only_markers_that_a_text_holds(monkeypatch):
    """The sums of a round are those over all markers, zeros included."""
    texts = ["", "zzz", *(" ".join(f"m{(i * i + k * k) % (40 + i % 7)}" for k in range(5 + i % 60)) for i in range(300))]
    coder = lm_mixing.Coder()
    known = lm_mixing.Words([" ".join(f"m{k}" for k in range(500)).encode()], coder)
    coder.markers = np.sort(known.hashes[1:])
    width = len(coder.markers)
    monkeypatch.setattr(lm_mixing, "SLICE_TEXTS", 64)
    marked = pd.concat(lm_mixing._marked(SimpleNamespace(value=coder))(iter([pd.DataFrame({"text": texts})])))
    marks = [lm_mixing.Marks.of(row) for row in marked.itertuples(index=False)]
    dense = np.concatenate([m.rows(np.arange(len(m.held)), width) for m in marks]).astype(float)
    place = {h: k for k, h in enumerate(coder.markers.tolist())}
    expected = np.zeros((300, width))
    for counts, text in zip(expected, texts[2:]):
        for word, n in Counter(text.split()).items():
            counts[place[int(lm_mixing.Words([word.encode()], coder).hashes[1])]] = n
    assert (dense == expected).all()
    assert sum(len(m.marker) for m in marks) == (dense > 0).sum() < dense.size / 10
    unit = np.sqrt(dense) / np.linalg.norm(np.sqrt(dense), axis=1, keepdims=True)
    centre = unit[[3, 50, 117]]
    near = np.round(unit @ centre.T, 9).argmax(1)
    monkeypatch.setattr(lm_mixing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    found = np.frombuffer(next(lm_mixing._near(centre)(iter([marked])))["a"][0]).reshape(2, 3, width)
    for k in range(3):
        assert np.abs(found[0, k] - np.rint(unit[near == k] * (1 << 20)).sum(0)).max() <= (near == k).sum()
        assert (found[1, k] == dense[near == k].sum(0)).all()
    start = next(lm_mixing._start([], width)(iter([marked])))
    assert (np.frombuffer(start["a"][0], "<u4").sum(), -start["score"][0]) == (dense.sum(1).max(),) * 2


def test_bounds_of_ranges_sort_spellings_alone(spark, monkeypatch):
    """Two words of one beginning fill two places."""
    spelt = [bytes([97 + k % 9, 97 + k % 4]) for k in range(60)]
    lexicon = spark.createDataFrame([(k * 7919 % 61, w, 1) for k, w in enumerate(spelt)], "hash long, spelt binary, n long")
    plain, sorted_by = lm_mixing.assign_ids, []
    monkeypatch.setattr(lm_mixing, "assign_ids", lambda df, by, out: sorted_by.append(df.columns) or plain(df, by, out))
    found = lm_mixing._bounds(lexicon, 7)
    assert found.tolist() == [sorted(spelt)[k * 60 // 7] for k in range(1, 7)]
    assert sorted_by == [["spelt"]]


def test_shuffles_are_dropped_within_the_operator_only(spark):
    before = spark.conf.get(lm_mixing.DROP_SHUFFLES)
    with pytest.raises(ValueError):
        with lm_mixing._shuffles_dropped(spark):
            assert spark.conf.get(lm_mixing.DROP_SHUFFLES) == "true"
            raise ValueError
    assert spark.conf.get(lm_mixing.DROP_SHUFFLES) == before


def test_planes_leave_out_bytes_that_are_zero_in_all():
    rng = np.random.default_rng(3)
    for width in (1, 2, 4, 8):
        for used in range(width + 1):
            values = rng.integers(0, 1 << 8 * used, 1_000, dtype=np.uint64)
            back = lm_mixing._unplanes(lm_mixing._planes(values.astype(f"<u{width}"), width), width)
            assert back.dtype == f"<u{width}" and (back == values).all()
        assert len(lm_mixing._unplanes(lm_mixing._planes(np.zeros(0, np.int64), width), width)) == 0
    noise = rng.integers(0, 256, 4_000)
    assert len(lm_mixing._planes(noise, 8)) <= len(lm_mixing._planes(noise, 1))


def test_scores_of_a_toy_corpus_are_probabilities(spark):
    """All words of a tiny alphabet as one-word texts: their probabilities with the end add to at most 1."""
    train = [(7 * i, "ab ba ab aab b", None, None, None, None, None, None) for i in range(1, 60) if held(7 * i, 7) != 2]
    words = ["".join(w) for n in (1, 2, 3, 4, 5, 6) for w in __import__("itertools").product("ab", repeat=n)]
    ids = [i for i in range(10**6, 10**6 + 3000) if held(i, 7) == 2][:len(words)]
    table = spark.createDataFrame(train + [(i, w, None, None, None, None, None, None) for i, w in zip(ids, words)], SCHEMA)
    got = {r["doc_id"]: r for r in lm_mixing.score_texts(table).collect() if r["held_out"]}
    share = sum(10 ** got[i]["score"] for i in ids)
    assert 0.02 < share <= 1 + 1e-9
    by_word = {w: got[i]["score"] for i, w in zip(ids, words)}
    assert by_word["ab"] > by_word["bb"] and by_word["ab"] > by_word["bbbbab"]
