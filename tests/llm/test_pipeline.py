"""The pipeline's stages on the smallest tables, each against a plain version on its own input."""

import zlib

import pytest
from brute import base_secrets, near_duplicates, repeats

import corpus_pipeline as pipeline
from ruleloom.llm import suffix

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Input of each stage and, last, the result."""
    at = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out.append((name, docs))
        stage(spark, docs, DIR).write.parquet(str(at / str(k)))
        docs = spark.read.parquet(str(at / str(k)))
    return [*out, ("result", docs)]


def text_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_return_the_columns_of_documents(tables):
    for _, df in tables[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert all(r.n_chars == len(r.text) for r in df.collect())


def test_quality_drops_what_is_labelled_bad(spark, tables):
    before, after = text_of(tables[0][1]), text_of(tables[1][1])
    assert all(before[i] == t for i, t in after.items())
    held = [r for r in spark.read.parquet(f"{DIR}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.doc_id in after) == (r.quality == 1) for r in held) >= 0.9 * len(held)


def test_near_duplicates_leave_one_of_each_group(tables):
    before, after = text_of(tables[1][1]), text_of(tables[2][1])
    assert after == {i: before[i] for i, (_, c) in near_duplicates(before, 5).items() if i == c}


def test_repeats_are_cut(tables):
    before, after = text_of(tables[2][1]), text_of(tables[3][1])
    for i, (n, removed, _, _) in repeats(before, 100).items():
        assert 0 <= len(after[i].encode()) - (n - removed) <= 6 * 100
        assert removed or after[i] == before[i]
    assert sum(v[1] for v in repeats(after, 130).values()) <= sum(v[1] for v in repeats(before, 130).values()) / 10 + 130
    assert suffix.shortened("aéb", [(2, 4)]) == "aé"


def test_secrets_are_gone(tables):
    before, after = text_of(tables[3][1]), text_of(tables[4][1])
    assert before.keys() == after.keys()
    assert not any(base_secrets(t) for t in after.values())
    assert all(after[i] == t for i, t in before.items() if not base_secrets(t) and "[SECRET]" not in after[i])


def test_packing_holds_every_document(tables):
    docs, rows = text_of(tables[4][1]), tables[5][1].collect()
    assert {r.doc_id for r in rows} == set(docs)
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert all(total[r.doc_id] == r.doc_tokens for r in rows)


def test_stages_on_empty_tables(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0


def test_run(spark, tables):
    assert pipeline.run(spark, DIR).count() == tables[-1][1].count()
