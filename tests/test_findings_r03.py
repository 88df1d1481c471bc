"""Bounded batches, chunked dictionaries, work done once, streams over folder tables."""
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexivec.functions import text as T
from lexivec.operators import bag_of_ngrams as B
from lexivec.operators import dictionary as D
from lexivec.operators import scoring, similarity, tagging
from lexivec.session import in_slices


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small tables of the driver's schema; documents are a folder of files."""
    d = str(tmp_path_factory.mktemp("tables"))
    words = ["good", "bad", "day", "night", "not", "never,", "SOOO", "über", "x1"]
    docs = [(i, " ".join(words[(i * k) % 9] for k in range(1, 12 + i % 5))) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "good bad day night")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    vecs = [(i, [float(math.sin(i * k)) for k in range(1, 5)], i % 3) for i in range(30)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_stream_over_a_folder_of_files(spark, tables):
    from lexivec.plans.q_misc import stream_label
    from lexivec.plans.q_text import distant_label_q
    got = {tuple(r) for r in stream_label(spark, tables).collect()}
    assert got == {tuple(r) for r in distant_label_q(spark, tables).collect()} and len(got) == 40


def test_stream_without_files(spark, tmp_path):
    from lexivec.streaming.label_stream import label_stream
    (tmp_path / "none").mkdir()
    words = spark.createDataFrame([("good",)], "term string")
    schema = spark.createDataFrame([], "doc_id long, text string").schema
    got = label_stream(spark, str(tmp_path / "none"), schema, words, words)
    assert got.columns == ["doc_id", "label", "first_pos"] and got.count() == 0


def test_char_ngrams_in_one_scan(spark):
    texts = ["Ab  cü\U0001f600d\n", "ab", "", "\U0001f600\U0001f601\U0001f602\U0001f603", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = df.select("doc_id", T.char_ngrams("text", 3).alias("g"))
    assert "arrays_zip" not in _plan(got)
    flat = [None if t is None else "ab cü\U0001f600d " if t.startswith("Ab") else t for t in texts]
    assert {r.doc_id: r.g for r in got.collect()} == {i: None if t is None else [t[k:k + 3] for k in range(len(t) - 2)] for i, t in enumerate(flat)}


@pytest.mark.parametrize("chunk", [3, 1000])
def test_parts_equal_entries_numbered_one_by_one(spark, chunk):
    nan = float("nan")
    words = [(1, "b", 1.0), (1, "a", 1.0), (2, "b", 1.0), (2, "b", 1.0), (None, "c", 1.0), (3, "z", 1.0), (1, "b", 1.0), (4, None, 1.0)]
    marks = [(1, "a", 0.0), (2, "a", -3.0), (3, "a", 6.0), (3, "n", None), (2, "q", nan), (3, "q", 2.0), (5, "a", 0.0)]
    block = lambda rows: spark.createDataFrame(rows, "doc_id long, name string, value double")
    parts, names = D.fit_parts(D.rows_of({"words": block(words).repartition(2), "marks": block(marks)}), chunk=chunk)
    key = lambda x: (x is None, str(x))
    numbers, rows = {}, [(0, *r) for r in words if r[1]] + [(1, *r) for r in marks]
    for b, n in sorted({(b, n) for b, _, n, _ in rows}):
        numbers[b, n] = len(numbers)
    found = {(r.block_no, r["name"]): (r.idx, r.max_abs) for r in names.collect()}
    assert {k: v[0] for k, v in found.items()} == numbers
    assert found[1, "n"][1] is None and found[1, "a"][1] == 6 and math.isnan(found[1, "q"][1]) and found[0, "b"][1] == 1
    got = [(r.doc_id, i, v) for r in parts.collect() for i, v in zip(r.indices, r["values"])]
    want = [(d, numbers[b, n], v) for b, d, n, v in rows if v is not None and v != 0]
    assert sorted(map(str, got), key=key) == sorted(map(str, want), key=key)
    assert all(r.indices == sorted(r.indices) for r in parts.collect())


def test_names_cross_once_a_chunk():
    n = 300
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2 * n) // 2), pa.array(np.zeros(2 * n, np.int32)), pa.array(["a", "b"] * n), pa.array(np.ones(2 * n))],
                                       ["id", "block_no", "name", "value"])
    coded = pa.Table.from_batches(D._coded(pa.Table.from_batches([batch]), 7))
    heads = coded.filter(coded["cell"].is_valid())
    assert sorted(heads["name"].to_pylist()) == ["a", "b"] and coded.num_rows == n + 2


def test_slices_by_items():
    lists = pa.array([["a"] * n for n in (3, 4, 0, 20, 1, 1)] + [None])
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), lists], ["id", "x"])
    assert [b.column(0).to_pylist() for b in in_slices([batch, batch.slice(0, 0)], 1, 7)] == [[0, 1, 2], [3], [4, 5, 6]]


def test_taggers_and_scores_see_bounded_batches(spark):
    n, most = 60, tagging.TOKENS
    docs = spark.range(n, numPartitions=1).select(F.col("id").alias("doc_id"), F.array_repeat(F.lit("good"), 5_000).alias("tok"))

    def tagger(found):
        assert sum(map(len, found)) <= most
        return found, found, found

    got = tagging.enrich_tags(docs, tagger).select(F.sum(F.size("ner")).alias("s")).first()
    assert got.s == n * 5_000
    lex = spark.createDataFrame([("good", 1.0)], "term string, score double")
    held, scored = scoring.ITEMS, scoring.unigram_scores(docs, F.col("tok"), lex, "doc_id").collect()
    assert held < n * 5_000 and {(r.n_pos, r.sum_pos) for r in scored} == {(5_000, 5_000.0)} and len(scored) == n


def test_features_are_computed_once(spark, tables):
    from lexivec.plans import q_classifier, q_eval, q_misc
    assert "MapInArrow" not in _plan(q_misc._features(spark, tables))
    assert "MapInArrow" not in _plan(q_eval.lexicon_grid(spark, tables))
    found = q_classifier.fitted_features(spark, tables)
    assert "LeftSemi" not in _plan(found) and found.count() == 4


def test_top_k_parts_no_block_whose_rows_are_below_the_floor(monkeypatch):
    sims = np.random.default_rng(3).normal(size=(400, 6))
    words = np.array([f"w{i:03d}" for i in range(400)])
    sims[390] = sims[17]  # ties go to the lesser word
    order = np.argsort(-sims[:200].max(axis=1), kind="stable")
    sims[:200], calls, real = sims[order], [], np.partition
    monkeypatch.setattr(similarity.np, "partition", lambda *a, **k: calls.append(1) or real(*a, **k))
    top = similarity.TopK(5, 6)
    for lo in range(0, 400, 100):
        top.add(sims[lo:lo + 100].copy(), words[lo:lo + 100], 0)
    want = [(q, w) for q in range(6) for _, w in sorted(zip(-sims[:, q], words))[:5]]
    assert sorted(zip(top.query.tolist(), top.word.tolist())) == sorted(want) and len(calls) == 1


def test_adam_step_is_the_formula():
    rng, adam = np.random.default_rng(5), B._Adam((6, 3), 0.05)
    mean, square, steps = np.zeros((6, 3)), np.zeros((6, 3)), np.zeros(6)
    for _ in range(4):
        rows, g = np.array([0, 2, 5]), rng.normal(size=(3, 3))
        steps[rows] += 1
        mean[rows], square[rows] = 0.9 * mean[rows] + 0.1 * g, 0.999 * square[rows] + 0.001 * g**2
        t = steps[rows][:, None]
        want = 0.05 * (mean[rows] / (1 - 0.9**t)) / (np.sqrt(square[rows] / (1 - 0.999**t)) + 1e-8)
        assert np.array_equal(adam.step(rows, g), want)
