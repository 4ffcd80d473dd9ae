"""The pipeline's stages keep the columns and act on what is left; its query is registered."""

from __future__ import annotations

import hashlib

import pytest
from cases import messy  # noqa: F401

import corpus_pipeline
from tailgauge.llm.queries import QUERIES, SQL, vocabulary


@pytest.fixture(scope="module")
def sf_dir(spark, messy, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    messy.write.parquet(f"{folder}/documents.parquet")
    items = [(1, "qq ww ee rr tt yy uu ii oo pp aa ss dd ff"), (2, "short one")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_each_stage_returns_the_columns(spark, messy, sf_dir):
    docs = messy
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), messy.schema)
        assert docs.columns == messy.columns and docs.count() <= before
    assert docs.count() > 10


def test_run_encodes_what_is_left(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir).collect()
    ids = [r.doc_id for r in found if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and all(len(r.ids) == r.n_tokens for r in found)
    import base64

    with open(vocabulary()[0], "rb") as lines:
        tokens = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    for r in found:
        assert hashlib.sha256(b"".join(tokens[i] for i in r.ids)).hexdigest() == r.decoded_sha256


def test_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "decontaminate", "tokenize"]
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(SQL) <= set(QUERIES)
