"""The pipeline's stages against brute force, each on its own input."""

import pytest

import corpus_pipeline as pipeline
from intervalis.llm import quality_rules
from intervalis.llm.oracle import ORACLE
from intervalis.llm.queries import QUERIES

from .helpers import components, cut_repeats, places
from .test_models_and_media import DATA, needs_data

TABLE = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_names():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality_rules", "ngram_join", "suffix_dedup", "packing"]
    assert set(ORACLE) <= set(QUERIES) and sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@needs_data
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, "/root/testdata/sf0.001")
        rows = made.collect()
        if name == "packing":
            assert set(places(rows)) == set(before)
            break
        after = {r.doc_id: r for r in rows}
        assert made.columns == docs.columns and len(after) == len(rows) and set(after) <= set(before)
        if name == "quality_rules":
            kept = {r.doc_id for r in quality_rules.judge(docs).collect() if r.kept}
            assert set(after) == kept
        if name == "ngram_join":
            assert set(after) == set(components([(i, r.text) for i, r in before.items()])[0].values())
        if name == "suffix_dedup":
            ids = sorted(before)
            for i, (_, gone, _, left, _) in zip(ids, cut_repeats([before[i].text for i in ids]), strict=True):
                assert after[i].text == (left.decode("utf-8", "ignore") if gone else before[i].text) and after[i].n_chars == len(after[i].text)
        else:
            assert all(after[i] == before[i] for i in after)
        docs, before = spark.createDataFrame(rows, docs.schema), after


@needs_data
def test_run_is_its_stages(spark):
    """run() gives what the stages give one after the other; each is held against brute force above."""
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    schema = docs.schema
    for name, stage in pipeline.STAGES:
        rows = stage(spark, docs, small).collect()
        if name != "packing":
            docs = spark.createDataFrame(rows, schema)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    ran = pipeline.run(spark, small).collect()
    assert sorted(map(key, ran)) == sorted(map(key, rows)) and len(places(ran)) > 20


@needs_data
def test_run(spark):
    documents = places(pipeline.run(spark, DATA).collect())
    assert 500 < len(documents) < 1000


def test_near_copies_without_an_id(spark):
    """Rows without an id give way to like rows with one, and to each other; different texts of one id both stay."""
    base = [f"word{i}" for i in range(60)]
    near, other = " ".join(["x", *base]), " ".join(f"other{i}" for i in range(60))
    rows = [(5, " ".join(base)), (None, near), (None, other), (None, other), (7, "first text of seven"), (7, "second text of seven"), (7, "second text of seven"), (8, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], TABLE)
    kept = pipeline.drop_near_copies(spark, docs, "").collect()
    expected = [(5, rows[0][1]), (None, other), (7, rows[4][1]), (7, rows[5][1]), (8, None), (None, None)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, expected))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (1, None, None, None, None), (None, "a", None, None, None), (2, "", "en", "s", 0)]])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, TABLE)
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, "/root/testdata/sf0.001")
        if name != "packing":
            assert made.columns == pipeline.COLUMNS
        made.collect()
