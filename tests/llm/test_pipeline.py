"""The pipeline's stages against brute force on a small corpus."""

from __future__ import annotations

import hashlib

import pytest
from test_minhash import similar
from test_operators import PASSAGE, graded

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("sf")
    rows, labels = graded(200)
    texts = {i: t for i, t in rows}
    texts |= {1000: texts[2], 1001: texts[3] + " " + PASSAGE, 1002: texts[4] + " token = abcdefgh", 1003: "short", 1004: None}
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), texts


def test_pipeline_rows(spark, folder):
    path, texts = folder
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert not {1000, 1001, 1003, 1004} & set(rows) and not any(i % 5 == 0 for i in rows if i < 200)
    # What the quality rules keep, linked where five-word shingles have a similarity of 0.8 or more: the smallest of each group stays.
    kept = sorted([i for i in texts if i < 200 and i % 5] + [1000, 1001, 1002])
    group = {i: i for i in kept}
    for i in kept:
        for j in kept:
            if j < i and group[i] != group[j] and similar(texts[i], texts[j]):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    first = {i for i in kept if group[i] == i and PASSAGE not in texts[i]}
    assert set(rows) == first
    wanted = texts[1002].replace("token = abcdefgh", "[SECRET]")
    if 1002 in rows:
        assert rows[1002].decoded_sha256 == hashlib.sha256(wanted.encode()).hexdigest()


def test_stages_keep_the_columns(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns


def test_empty_documents(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0
