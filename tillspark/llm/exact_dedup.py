"""Exact duplicates by skew-safe combining of digest groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillspark.llm.common import BLANKS
from tillspark.session import materialize

SALTS = 32


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: its group of equal texts and the row that stays.

    Texts are equal when identical after each run of white space became one
    space; null counts as empty. Every stage groups by digest and full
    content: the map side combines what one task holds, (digest, salt)
    groups merge what the tasks with one salt found, and one row per salt
    is combined per digest at the end. So a text that a third of all rows
    share arrives anywhere as a few rows.

    Rows without an id take part but never stay while a row with one is in
    the group. Rows that repeat an id and its text are all reported, each
    as kept. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), BLANKS, " ").alias("body"),
    ).withColumn("digest", F.sha2("body", 256))
    salted = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "salt", "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    )
    # Dealt by digest alone, so that texts sharing a digest meet in one task; no text leaves it.
    winners = (
        salted.repartition("digest").groupBy("digest", "body")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
        .groupBy("digest")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("texts"))
    )
    winners = materialize(winners, "exact")
    shared = winners.filter("texts > 1").select("digest")
    found = rows.select("doc_id", "digest").join(
        winners.filter("texts = 1").select("digest", "keep_id", "group_size"), "digest"
    )
    if not shared.isEmpty():  # different texts under one digest: their rows join on the text too
        parted = (
            salted.join(shared, "digest", "left_semi").groupBy("digest", "body")
            .agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
        )
        found = found.unionByName(rows.join(parted, ["digest", "body"]).drop("body"))
    return found.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without the duplicates: all columns, one row per text.

    Of rows that repeat an id within a group one stays.
    """
    groups = exact_groups(docs, id_col, text_col).filter("kept")
    ids = materialize(groups.groupBy(F.col("doc_id").alias("_kept_id")).agg(F.count("*").alias("_copies")), "kept")
    once = docs.join(ids.filter("_copies = 1"), docs[id_col].eqNullSafe(ids["_kept_id"]), "left_semi")
    several = ids.filter("_copies > 1")
    if several.isEmpty():
        return once
    again = docs.join(several, docs[id_col].eqNullSafe(several["_kept_id"]), "left_semi")
    # The same id may stand on different texts; each text keeps one row.
    names = docs.columns
    packed = again.select(F.struct(*(again[c] for c in names)).alias("row")).select(
        "row", F.regexp_replace(F.coalesce(F.col(f"row.{text_col}"), F.lit("")), BLANKS, " ").alias("body"),
        F.col(f"row.{id_col}").alias("id"),
    )
    return once.unionByName(packed.dropDuplicates(["id", "body"]).select("row.*"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (
  SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g ON d.body = g.body
"""
