"""The pipeline, stage by stage, against what each stage must keep."""

import numpy as np
import pytest
from edge import TEXTS, frame
from pyspark.sql import functions as F
from test_documents import WORD, brute_force_groups, brute_force_print, brute_force_removal

import corpus_pipeline as pipeline
from gridmill.llm.queries import table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, FOLDER, "documents")
    out = [docs.collect()]
    for name, stage in pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), stage(spark, docs, FOLDER).schema)
        out.append(docs.collect())
    return out


def test_stages(stages):
    source, spoken, single, cut, mixed, tokens = stages
    assert len(spoken) >= 0.97 * len(source) and all(any(c.isalpha() for c in r["text"]) for r in spoken)
    prints = [(r["doc_id"], brute_force_print(r["text"])) for r in spoken]
    assert {r["doc_id"] for r in single} == {i for i, _, first in brute_force_groups(prints, 2) if i == first}
    left = {i: kept for i, _, removed, _, kept in brute_force_removal([(r["doc_id"], r["text"]) for r in single], 50) if kept or not removed}
    assert {r["doc_id"]: r["text"] for r in cut} == {i: kept.decode("utf-8", "ignore") for i, kept in left.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in cut)
    words = sum(len(WORD.findall(r["text"])) for r in cut)
    taken = sum(len(WORD.findall(r["text"])) for r in mixed)
    assert abs(taken - 1.5 * words) < 0.25 * words
    assert np.array_equal(sorted(r["doc_id"] for r in tokens), sorted(r["doc_id"] for r in mixed))
    assert all(r["n_pieces"] == len(r["ids"]) > 0 for r in tokens)
    assert [r.asDict().keys() == source[0].asDict().keys() for part in stages[1:5] for r in part[:1]] == [True] * 4


def test_language_keeps_every_lettered_document(spark, monkeypatch):
    predict = pipeline.bigru.predict_languages
    monkeypatch.setattr(pipeline.bigru, "predict_languages", lambda *a, **k: predict(*a, **k).withColumn("score", F.lit(0.1)))
    kept = pipeline.language(spark, frame(spark), FOLDER).collect()
    assert sorted(r["text"] for r in kept) == sorted(t for _, t in TEXTS if t and any(c.isalpha() for c in t))


@pytest.mark.parametrize("rows", [TEXTS, []])
def test_awkward_documents_pass(spark, rows):
    docs = frame(spark, rows)
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert pipeline.tokens(spark, docs, FOLDER).count() == docs.count()


def test_run(spark):
    assert pipeline.run(spark, FOLDER).count() > 0 and pipeline.ORACLE_SQL is None
