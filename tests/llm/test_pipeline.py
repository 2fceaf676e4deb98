"""The pipeline on a small corpus with planted cases, and the queries of the registry."""

import os

import numpy as np
import pytest

import corpus_pipeline
from unimass.llm.queries import QUERIES
from unimass.session import stage_root

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    rng = np.random.default_rng(1)
    pools = {"en": ["the", "of", *(f"thing{i}er" for i in range(400))],
             "de": ["der", "und", *(f"schung{i}ich" for i in range(400))]}
    draw = lambda lang, n: " ".join(rng.choice(pools[lang], n))
    items = [draw("en", 30) for _ in range(5)]
    rows = [(i, draw(lang, 120), lang) for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(200, rows[0][1], "en"), (201, rows[2][1].replace("the ", "that ", 1), "en"),
             (202, draw("en", 40) + " " + items[1] + " " + draw("en", 40), "en"),
             (203, None, "en"), (204, "123 !!", None),
             (205, draw("en", 50) + " write to me@home.example.com", "en")]
    spark.createDataFrame([(i, t, lang, "src0", len(t or "")) for i, t, lang in rows],
                          "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(
        f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int"
                          ).write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(120)],
                          "vec_id long, embedding array<float>, label int").write.parquet(
        f"{root}/embeddings.parquet")
    spark.createDataFrame([(i, j, ["user", "assistant"][j % 2], f"turn {j} <s>") for i in range(20) for j in range(i % 5)],
                          "conv_id long, turn long, role string, text string").write.parquet(f"{root}/conversations.parquet")
    return str(root)


def test_stages_take_effect(spark, folder):
    docs, gone = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.collect()}
        docs = stage(spark, docs, folder)
        assert docs.columns == COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        gone[name] = before - {r["doc_id"] for r in docs.collect()}
    assert gone == {"language ID": {203, 204}, "SimHash near-dedup": {200, 201},
                    "benchmark decontamination": {202}, "PII": set()}
    masked = {r["doc_id"]: r["text"] for r in docs.collect()}[205]
    assert masked.endswith("write to <email>")


def test_run_packs_what_is_kept(spark, folder):
    pieces = corpus_pipeline.run(spark, folder)
    ids = {r["doc_id"] for r in pieces.collect()}
    assert ids == set(range(120)) | {205}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    left = os.listdir(stage_root(spark))  # of this run only the last stage
    assert not any(n.startswith("scratch-") for n in left)
    assert [n.rsplit("-", 1)[0] for n in left if n.startswith("stage-")] == ["stage-packing"]


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert len(df.columns) == len(set(df.columns)) and df.count() >= 0
