"""The corpus pipeline, stage by stage, each on what its predecessor kept."""

import pytest

import corpus_pipeline
from tests.llm.brute import suffix_repeats
from tests.llm.test_near_duplicates import table
from tests.llm.test_similar import all_pairs
from vectide.llm.common import materialize

SF = "/root/testdata/sf0.001"


pytestmark = pytest.mark.seconds(240)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], SF), name))
    before, clean, single, cut, mixed, packed = seen
    assert all(df.columns == docs.columns for df in seen[:-1])

    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in clean.collect()}
    gone = {r.doc_id for r in before.collect()} - ids
    assert not [i for i in gone if toxic.get(i) == 0]

    _, root = all_pairs([(r.doc_id, r.text) for r in clean.collect()])  # five words, similarity 0.8
    assert {r.doc_id for r in single.collect()} == set(root.values())

    left = [(r.doc_id, r.text) for r in single.collect()]
    wanted = suffix_repeats(left)
    after = {r.doc_id: r.text for r in cut.collect()}
    assert set(after) == set(wanted)
    for i, text in left:
        lost = len((text or "").encode()) - len((after[i] or "").encode())
        assert wanted[i][1] - 6 * wanted[i][2] <= lost <= wanted[i][1]

    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        assert r.text == after[r.doc_id]
    assert max(copies.values()) <= 3
    firsts = packed.where("piece = 0").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in firsts} == copies
    sizes = packed.selectExpr("sequence_id", "offset + length as ends", "length").groupBy("sequence_id").agg({"ends": "max", "length": "sum"}).collect()
    assert all(r["max(ends)"] == r["sum(length)"] <= 2048 for r in sizes)


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and clashing column names pass through all stages."""
    texts = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "d e f g h i"), (5, "word " * 30_000), (6, "some other text here, longer than fifty bytes for sure, yes")]
    docs = table(spark, texts).unionByName(table(spark, [(7, "x y z")]).selectExpr("doc_id", "text", "cast(null as string) as lang", "cast(null as string) as source", "cast(null as long) as n_chars", "fp", "id", "k", "`row`", "component_id", "size", "copies"))
    spark.createDataFrame([(1, 0), (None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            before = rows
            rows = materialize(stage(spark, rows, str(tmp_path)), name)
            if name != "pattern_packing":
                assert rows.columns == before.columns
        assert (rows.count() > 0) == (before.count() > 0)
