"""Python functions of the pipeline's stages run once a row, in workers that don't load pandas."""
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from lexivec.llm import lines, quality
from lexivec.llm.components import components
from lexivec.session import checkpointed

PASSAGE = " ".join(f"word{i}" for i in range(60)) + "."


def _documents(spark):
    rows = [(1, f"One start. {PASSAGE}\nOwn end of one."), (2, f"Two is other. {PASSAGE}\nEnd of two."), (3, PASSAGE), (4, None), (5, "short")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def _evals(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_each_function_stands_once_in_the_plan(spark):
    docs = _documents(spark)
    assert _evals(lines.spans_by_words(docs)) == 1
    kept = corpus_pipeline.remove_repeats(spark, docs, "")
    assert _evals(kept) == 1
    assert {r.doc_id: r.text for r in kept.collect()} == {
        1: f"One start. {PASSAGE}\nOwn end of one.", 2: "Two is other.\nEnd of two.", 4: None, 5: "short"}


def test_removed_spans(spark):
    got = {r.doc_id: (r.text, [tuple(s) for s in r._removed]) for r in lines.remove_repeats(_documents(spark)).collect()}
    assert got[3] == ("", [(0, len(PASSAGE))]) and got[4] == (None, []) and got[5] == ("short", [])
    assert got[2][1][0][1] - got[2][1][0][0] >= len(PASSAGE)


def test_scores_of_odd_texts(spark):
    docs = spark.createDataFrame([(i, ["good day " * 5, "bad, bad night", "", None][i % 4]) for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("quality"))
    got = quality.scores(docs, labels).collect()
    assert len(got) == 40 and all(0 <= r._score <= 1 for r in got)
    assert quality.scores(docs.limit(0), labels).count() == 0


def test_workers_do_without_pandas():
    names = "lines, quality, simhash, mixing, bpe"
    code = f"import sys, pyspark.worker\nfrom lexivec.llm import {names}\nassert 'pandas' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[1])


def test_checkpoints_of_few_files(spark):
    edges = spark.range(0, 300, 1, 40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a % 10 <> 9")
    kept = checkpointed(edges, few=True)
    assert kept.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism < edges.rdd.getNumPartitions()
    assert sorted(kept.collect()) == sorted(edges.collect())
    values = spark.range(300).select(F.col("id").alias("node"), F.col("id").alias("value"))
    assert {r.node: r.least for r in components(edges, values).collect()} == {i: i // 10 * 10 for i in range(300)}
