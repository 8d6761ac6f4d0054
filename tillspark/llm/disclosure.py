"""Personal data: base patterns, and terms that give protected entities away."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tillspark.llm.common import Shipped, mix64
from tillspark.session import materialize

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
NEAR = 5
REACH = 120
SUPPORT = 3
DISCLOSES = 0.8
REMOVES = 0.95
FILTER_BITS = 1 << 23
FILTER_BLOCKS = 256

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that no address follows is taken whole, so long runs are read once.
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Addresses from left to right, found from their @ signs outwards."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            floor = domain.end()
            out.append((start, floor))
        else:
            floor = max(floor, at + 1)
        at = text.find("@", floor)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def neighbours(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """The NEAR words on either side of a span, within REACH characters."""
    low, high = max(0, start - REACH), min(len(text), end + REACH)
    before = [m.span() for m in _WORD.finditer(text, low, start)]
    after = [m.span() for m in _WORD.finditer(text, end, high)]
    if before and before[0][0] == low and low and text[low - 1].isalpha():
        before.pop(0)  # its beginning is out of reach
    if after and after[-1][1] == high and high < len(text) and text[high].isalpha():
        after.pop()
    return [(text[a:b].lower(), a, b) for a, b in before[-NEAR:] + after[:NEAR]]


def _examine(frames):
    """Base spans of each row, the words near them, once each, and the text where there is a span."""
    for frame in frames:
        out = []
        for key, doc_id, text in zip(frame["row"], frame["doc_id"], frame["text"]):
            spans = base_spans(text)
            taken = _covered(text, spans)
            near = set()
            for kind, a, b in spans:
                value = text[a:b].lower()
                near |= {(kind, value, w) for w, s, e in neighbours(text, a, b) if not taken[s:e].any()}
            out.append((
                key, doc_id, [{"kind": k, "value": text[a:b].lower(), "start": a, "end": b} for k, a, b in spans],
                [dict(zip(("kind", "value", "term"), n)) for n in sorted(near)], text if spans else None,
            ))
        yield pd.DataFrame(out, columns=["row", "doc_id", "base", "near", "text"]).astype({"doc_id": "Int64"})


def _covered(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Which characters lie in a span."""
    taken = np.zeros(len(text) + 1 if spans else 0, bool)
    for _, a, b in spans:
        taken[a:b] = True
    return taken


_EXAMINED = (
    "row long, doc_id long, base array<struct<kind: string, value: string, start: int, end: int>>, "
    "near array<struct<kind: string, value: string, term: string>>, text string"
)


def _places(words: list[str]) -> np.ndarray:
    codes = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    return (mix64(codes) % np.uint64(FILTER_BITS)).astype(np.int64)


def term_filter(terms: DataFrame) -> Shipped:
    """A bit table of fixed size in which all these terms (and by chance a few others) are set."""

    def bits_of(frames):
        for frame in frames:
            bits = np.zeros(FILTER_BITS, bool)
            bits[_places(frame["term"].tolist())] = True
            packed = np.packbits(bits).reshape(FILTER_BLOCKS, -1)
            used = np.flatnonzero(packed.any(1))
            yield pd.DataFrame({"block": used, "bits": [packed[k].tobytes() for k in used]})

    def either(frame: pd.DataFrame) -> pd.DataFrame:
        whole = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in frame["bits"]])
        return pd.DataFrame({"block": frame["block"].iloc[:1], "bits": [whole.tobytes()]})

    schema = "block int, bits binary"
    packed = np.zeros((FILTER_BLOCKS, FILTER_BITS // 8 // FILTER_BLOCKS), np.uint8)
    # FILTER_BLOCKS rows, one megabyte in all.
    for row in terms.select("term").mapInPandas(bits_of, schema).groupBy("block").applyInPandas(either, schema).collect():
        packed[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return Shipped(terms.sparkSession, packed.ravel())


def document_counts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """In how many texts the wanted terms occur: term, n. The row with a null term counts all texts.

    Tasks add up what they hold first. A bit table of fixed size keeps words
    back that cannot be wanted; what passes by chance is harmless.
    """
    shared = term_filter(wanted)

    def count(frames):
        known = np.unpackbits(shared.value).astype(bool)
        total: Counter[str] = Counter()
        every = 0
        for frame in frames:
            words: Counter[str] = Counter()
            for text in frame["text"]:
                words.update({w.lower() for w in set(_WORD.findall(text))})
            every += len(frame)
            names = list(words)
            for i in np.flatnonzero(known[_places(names)]):
                total[names[i]] += words[names[i]]
            if len(total) > 200_000:
                yield pd.DataFrame({"term": list(total), "n": list(total.values())})
                total.clear()
        yield pd.DataFrame({"term": [*total, None], "n": [*total.values(), every]})

    counted = texts.select("text").mapInPandas(count, "term string, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n"))


def occurring(near: DataFrame) -> DataFrame:
    """In how many texts terms stand near entities: kind, value (null: any of the kind), term, both.

    `near` has each (row, kind, value, term) once.
    """
    any_value = near.select("row", "kind", "term").distinct().select("kind", F.lit(None).cast("string").alias("value"), "term")
    return near.select("kind", "value", "term").union(any_value).groupBy("kind", "value", "term").agg(F.count("*").alias("both"))


def entities(examined: DataFrame) -> DataFrame:
    """The entities of each row, once each: row, kind, value, and value null for any of the kind."""
    named = examined.select("row", F.explode("base").alias("b")).select("row", "b.kind", "b.value").distinct()
    general = named.select("row", "kind").distinct().withColumn("value", F.lit(None).cast("string"))
    return named.union(general)


def _occurrences(shared: Shipped):
    """Where possible terms stand in the texts with entities, outside the base spans."""

    def run(frames):
        known = np.unpackbits(shared.value).astype(bool)
        for frame in frames:
            out = []
            for row, text, base in zip(frame["row"], frame["text"], frame["base"]):
                taken = _covered(text, [(s["kind"], s["start"], s["end"]) for s in base])
                found = [(text[a:b].lower(), a, b) for a, b in (m.span() for m in _WORD.finditer(text)) if not taken[a:b].any()]
                for i in np.flatnonzero(known[_places([w for w, _, _ in found])]):
                    out.append((row, *found[i]))
            yield pd.DataFrame(out, columns=["row", "term", "start", "end"])

    return run


def disclosing(pairs: DataFrame, sizes: DataFrame, counts: DataFrame, support: int, threshold: float) -> DataFrame:
    """Terms that give an entity away: kind, value (null: any of the kind), term, ratio.

    All counts are of texts: with the term beside the entity (`pairs`), with
    the entity (`sizes`), with the term (`counts`). The pointwise mutual
    information of term and entity, as a share of the entity's information
    content, is 1 where the term's texts all have it beside the entity, copies
    or not, and 0 where they are independent.
    """
    texts = counts.filter("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("texts"))
    total = F.greatest(F.col("texts"), F.lit(2)).cast("double")
    information = F.log2(total / F.least(F.col("around").cast("double"), total / 2))
    shared = F.log2(F.col("both") * total / (F.greatest("n", "both") * F.col("around")))
    joined = (
        pairs.filter(F.col("both") >= support)
        .join(sizes.withColumnRenamed("kind", "k").withColumnRenamed("value", "v"),
              F.col("kind").eqNullSafe(F.col("k")) & F.col("value").eqNullSafe(F.col("v"))).drop("k", "v")
        .join(counts.filter("term is not null"), "term")
    )
    # `texts` is one row.
    return joined.join(F.broadcast(texts)).withColumn("ratio", shared / information).filter(
        F.col("ratio") >= threshold
    ).select("kind", "value", "term", "ratio")


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False,
    support: int = SUPPORT, threshold: float = DISCLOSES, removes: float = REMOVES,
) -> DataFrame:
    """Spans of personal data in every whole text: doc_id, spans (and the text, if kept).

    A span is (kind, start, end, action): base kinds are masked. Terms that
    stand near an entity in `support` texts or more and give its value, or
    its kind, away are generalised from `threshold` on and removed from
    `removes` on (see `disclosing`), wherever they stand in a text that holds
    the entity. Base spans always stay; kinds may overlap each other, terms
    overlap nothing.

    Null and empty texts have no spans. Rows without an id and repeated rows
    each give a row of their own. An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    if keep_text:
        rows = materialize(rows, "rows")
    examined = materialize(rows.mapInPandas(_examine, _EXAMINED), "examined")
    near = examined.select("row", F.explode("near").alias("w")).select("row", "w.*")
    pairs = materialize(occurring(near).filter(F.col("both") >= support), "occurring")
    # Fewer texts than the support cannot disclose, however rare the term.
    counts = materialize(document_counts(rows, pairs.select("term").distinct()), "counts")
    held = materialize(entities(examined), "entities")
    sizes = held.groupBy("kind", "value").agg(F.count("*").alias("around"))
    given = materialize(disclosing(pairs, sizes, counts, support, threshold), "disclosing")
    places = examined.filter("text is not null").select("row", "text", "base").mapInPandas(
        _occurrences(term_filter(given)), "row long, term string, start int, end int"
    )
    told = places.join(given, "term").withColumnsRenamed({"row": "r", "kind": "k", "value": "v"})
    hits = told.join(
        held, (F.col("r") == F.col("row")) & (F.col("k") == F.col("kind")) & F.col("v").eqNullSafe(F.col("value")), "left_semi"
    ).select(F.col("r").alias("row"), "start", "end", "ratio")
    action = F.when(F.col("ratio") >= removes, "remove").otherwise("generalise")
    extra = (
        hits.groupBy("row", "start", "end").agg(F.max("ratio").alias("ratio"))
        .select("row", F.struct(F.lit(TERM).alias("kind"), "start", "end", action.alias("action")).alias("s"))
        .groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("extra"))  # of one text
    )
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit("mask").alias("action")))
    spans = examined.select("row", "doc_id", base.alias("base")).join(extra, "row", "left").select(
        "row", "doc_id", F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.concat("base", "extra")).alias("spans")
    )
    if keep_text:
        return rows.select("row", "text").join(spans, "row").select("doc_id", "text", "spans")
    return spans.drop("row")


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """doc_id, spans and the text with its spans masked, generalised or removed."""

    @F.pandas_udf("string")
    def apply(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_replaced(t, s) for t, s in zip(text, spans)], dtype=object)

    return find(docs, keep_text=True, **options).withColumn("text", apply("text", "spans"))


def _replaced(text: str, spans) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["end"] <= at:
            continue
        out.append(text[at:max(at, s["start"])])
        if s["action"] == "mask":
            out.append(f"[{s['kind'].upper()}]")
        elif s["action"] == "generalise":
            out.append("[WORD]")
        at = s["end"]
    return "".join([*out, text[at:]])


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans, and all spans as text."""

    def listed(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *(of(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != TERM)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), of(TERM).alias("n_term"),
    )
