import zlib

import numpy as np
import pytest
from conftest import DOCS, ODD, SF01, doc
from lexivec.llm import quality as q
from pyspark.sql import functions as F

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    import pandas as pd
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    got = q.scores(docs, labels).select("doc_id", "_score", q.held_out(F.col("doc_id")).alias("held_out")).toPandas()
    assert len(got) == docs.count()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got["doc_id"], got["held_out"]))
    d = got.merge(pd.read_parquet(f"{SF01}/labels.parquet"), on="doc_id")
    out = d[d["held_out"]]
    assert ((out["_score"] >= q.CUT) == out["quality"]).mean() > 0.95
    assert (d[d["quality"] == 1]["_score"] >= q.CUT).mean() > 0.99


def test_votes_like_brute_force():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "###", "$$$"], 12)) for _ in range(80)]
    good = np.array(["###" not in t for t in texts], float)
    v = q.fit(np.stack([q.features(t) for t in texts]), good)
    for t, got in zip(texts[:20] + ["", "ab"], v.scores(texts[:20] + ["", "ab"])):
        x = q.weighed(q.features(t)[None], v.rarity)[0] @ v.axes
        n = np.linalg.norm(x)
        like = v.vectors @ (x / n if n else x)
        near = np.argsort(-like)[: q.NEIGHBOURS]
        w = np.maximum(like[near], 0) ** q.SHARPNESS
        assert got == pytest.approx((w * good[near]).sum() / w.sum() if w.sum() else good.mean(), abs=0.02)


def test_held_out_labels_are_not_learnt(spark):
    docs = spark.createDataFrame([doc(i, f"text {i} " * 5) for i in range(60)], DOCS)
    labels = [(i, i % 2, 0) for i in range(60)]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, 1) for i, y, _ in labels]
    one, two = ([r["_score"] for r in q.scores(docs, spark.createDataFrame(x, LABELS)).orderBy("doc_id").collect()] for x in (labels, turned))
    assert one == two


def test_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], LABELS)
    assert {r["_score"] for r in q.scores(odd, none).collect()} == {0.5}
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, 1, 0), (6, None, 0), (None, 1, 0), (7, 0, None), (999, 0, 0)], LABELS)
    got = q.scores(odd, labels)
    assert got.columns == [*odd.columns, "_score"] and got.count() == len(ODD)
    assert all(0 <= r["_score"] <= 1 for r in got.collect())
    assert q.scores(empty, labels).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([doc(i, f"t{i}") for i in range(200)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)] * 2, LABELS)
    counts, good = q.labelled_sample(docs, labels, 10)
    assert counts.shape == (20, q.WIDTH + q.LAGS) and good.sum() == 10
