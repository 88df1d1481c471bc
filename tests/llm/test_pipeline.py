import corpus_pipeline as cp
import public_tokenizers as P
from conftest import DOCS, ODD, SF001, doc
from lexivec.llm import queries
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def test_stages_name_their_order():
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "substrings", "mix", "bpe"]


def test_all_stages_keep_the_columns_of_documents(spark, odd):
    docs = odd
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out
    assert cp.encode(spark, docs, SF001).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF001).count() == 0


def test_each_stage_takes_effect(spark):
    good = spark.read.parquet(f"{SF001}/documents.parquet")
    kept = cp.keep_good(spark, good, SF001)
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    left = kept.join(labels, "doc_id").groupBy("quality").count().collect()
    assert {r["quality"]: r["count"] for r in left}[1] >= 0.95 * labels.where("quality = 1").join(good, "doc_id").count()
    p = " ".join(f"w{i}" for i in range(60))
    rows = [doc(1, f"first words here\n{p}"), doc(2, f"second document of its own words\n{p}\nand an end that differs from all else"), doc(3, p + " " + p), doc(4, p + " " + p)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(r["doc_id"] for r in cp.keep_one_of_each(spark, docs, SF001).collect()) == [1, 2, 3]
    cut = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cp.remove_repeats(spark, docs, SF001).collect()}
    text = "second document of its own words\nand an end that differs from all else"
    assert cut[2] == (text, len(text)) and cut[1][0] == rows[0][1] and 4 not in cut


def test_run_like_its_stages_one_by_one(spark):
    rows = cp.run(spark, SF001).collect()
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF001)
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = sorted((r["doc_id"], len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in rows) == want and rows


def test_every_operator_has_its_query():
    import __spark_entry__ as E
    assert [f"op{n}_" for n in range(1, 14)] == [q.split("_")[0] + "_" for q in queries.QUERIES]
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries()) and set(queries.ORACLE_SQL) <= set(E.oracle_sql())
