"""The pipeline against its stages applied by hand."""

from __future__ import annotations

import re

import corpus_pipeline
from tillspark.llm import domain_mix, weighted_minhash

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_rows_add_up(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now
        now = stage(spark, before, SMALL)
        assert now.columns == docs.columns
        ids = [r["doc_id"] for r in now.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= set(kept)
        if name == "language_id":
            expected = {i for i, t in kept.items() if t and re.search(r"[^\W\d_]", t)}
        elif name == "exact_dedup":
            first: dict[str, int] = {}
            for i in sorted(kept):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i]), i)
            expected = set(first.values())
        elif name == "near_dedup":
            expected = {r["doc_id"] for r in weighted_minhash.near_groups(before).collect() if r["kept"]}
        else:
            marks = domain_mix.default_domains(spark.read.parquet(f"{SMALL}/labels.parquet"))
            expected = {r["doc_id"] for r in domain_mix.mix(before, marks).collect() if r["copies"]}
        assert set(ids) == expected
        kept = {i: kept[i] for i in ids}
    packed = corpus_pipeline.run(spark, SMALL)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(kept)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _body string, _kept_id long, _drawn_id long, copies int, body string, row string"


def _stored(spark, tmp_path, rows):
    """A folder with these documents and a few labels."""
    folder = str(tmp_path / "tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    marks = [(i, i % 2, 0) for i in range(8)] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_on_odd_rows(spark, tmp_path):
    texts = [
        None, "", " \n", "123 !?", "one two three four five six", "one two  three four five six", "wort für wort und satz für satz",
        "ab" * 30_000, "one two three four five six seven eight nine ten eleven", "éé ff gg hh ii jj kk",
    ]
    extra = ("b", 1, 2, 3, "c", "d")
    rows = [(i, t, ["en", "de", None][i % 3], "s", 5, *extra) for i, t in enumerate(texts)]
    rows += [(4, texts[6], "de", None, None, *extra), (8, texts[8], "en", "s", 1, *extra), (None, texts[9], None, None, None, *extra)]
    folder = _stored(spark, tmp_path, rows)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == columns
        kept[name] = sorted((str(r["doc_id"]), r["text"]) for r in now.collect())
    known = [(str(r[0]), r[1]) for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    assert kept["language_id"] == sorted(known)
    bodies = [re.sub(r"[\x20\x09-\x0D]+", " ", t) for _, t in kept["exact_dedup"]]
    assert sorted(bodies) == sorted({re.sub(r"[\x20\x09-\x0D]+", " ", t) for _, t in known})
    assert set(kept["mixing"]) <= set(kept["near_dedup"]) <= set(kept["exact_dedup"])
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {str(r["doc_id"]) for r in packed} == {i for i, _ in kept["mixing"]}


def test_stages_on_empty_tables(spark, tmp_path):
    folder = _stored(spark, tmp_path, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect() == []
    assert corpus_pipeline.run(spark, folder).collect() == []
