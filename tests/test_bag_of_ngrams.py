"""Embeddings and a logistic layer trained together."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec.operators import bag_of_ngrams as B

SIGNS = {"not good": 0, "good": 1, "not bad": 1, "bad": 0}


@pytest.fixture(scope="module")
def docs(spark):
    """The label hangs on a pair of words: single words alone can't tell."""
    rnd = random.Random(5)
    rows = []
    for i in range(900):
        said = rnd.choice(list(SIGNS))
        tail = [rnd.choice(["a", "b", "c", "not"]) if rnd.random() < 0.3 else "x" for _ in range(rnd.randrange(4))]
        rows.append((i, said.split() + ["and"] + tail, SIGNS[said], "clash"))
    rows += [(1000, None, 1, "clash"), (1001, [], 0, "clash"), (1002, ["good"], None, "clash")]
    return spark.createDataFrame(rows, "doc_id long, tok array<string>, y int, ids string").repartition(5)


@pytest.fixture(scope="module")
def model(docs):
    return B.fit(docs.where("doc_id % 5 <> 0"), F.col("tok"), F.col("y"), epochs=8, dim=8, buckets=512)


def test_pairs_of_words_decide(docs, model):
    test = docs.where("doc_id % 5 = 0 AND doc_id < 900")
    got = B.score(test, F.col("tok"), model).join(test, "doc_id").select("score", "y").collect()
    assert len(got) == 180 and np.mean([(r.score >= 0.5) == r.y for r in got]) > 0.95


def test_scores_equal_the_models_numbers(docs, model):
    asked = docs.select("doc_id", B.hashed_ngrams(F.coalesce("tok", F.array().cast("array<string>")), 2, 512).alias("g"))
    got = {r.doc_id: r.score for r in B.score(docs, F.col("tok"), model).collect()}
    assert len(got) == 903
    for r in asked.collect():
        mean = np.mean([model.table[g] for g in r.g], axis=0) if r.g else np.zeros(8)
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-(mean @ model.weights + model.bias))))
    assert got[1000] == got[1001] == pytest.approx(1 / (1 + np.exp(-model.bias)))


def test_saved_model_and_empty_fit(spark, docs, model, tmp_path):
    model.save(spark, str(tmp_path / "m"))
    back = B.NgramModel.load(spark, str(tmp_path / "m"))
    assert np.array_equal(back.table, model.table) and np.array_equal(back.weights, model.weights) and (back.bias, back.n) == (model.bias, 2)
    blank = B.fit(docs.where("y > 5"), F.col("tok"), F.col("y"), dim=4, buckets=64)
    assert blank.bias == 0.0 and B.score(docs.where("doc_id = 1001"), F.col("tok"), blank).first().score == 0.5


def test_workers_share_one_model(docs, monkeypatch):
    monkeypatch.setattr(B, "ROWS_OF_A_WORKER", 300)
    model = B.fit(docs, F.col("tok"), F.col("y"), epochs=12, dim=8, buckets=512)
    known = docs.where("y IS NOT NULL AND size(tok) > 0")
    got = B.score(known, F.col("tok"), model).join(known, "doc_id").select("score", "y").collect()
    assert np.mean([(r.score >= 0.5) == r.y for r in got]) > 0.95
