"""Streaming, source/sink round trips, tokenizer, HTML decoding and ML queries."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lexivec.functions import html as H
from lexivec.functions import text as T
from lexivec.operators import bag_of_ngrams as B
from lexivec.operators import corpus as C
from lexivec.operators import evaluate as E
from lexivec.operators import ml as M
from lexivec.operators import vectors as V
from lexivec.plans.catalog import query
from lexivec.plans.q_text import marked_tokens
from lexivec.plans.sqlparts import CLASS_SCORE_SQL, DOC_TOKENS_CTE, LEXICON_CTE, NEG_MARK_CTE, r6, score_block_cte
from lexivec.session import ensure_checkpoint_dir, written
from lexivec.sources import cache as CA
from lexivec.sources import readers as RD
from lexivec.sources import sinks as K
from lexivec.sources import tables as S
from lexivec.operators import lexicon as L
from lexivec.streaming.label_stream import label_stream, opinion_tweets


def scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


def stream_label(spark, sf_dir):
    lex = S.lexicon(spark, sf_dir)
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    # A glob path names the table whether it is one file or a folder of them; as many files a batch as tasks run.
    return label_stream(spark, f"{sf_dir}/document[s].parquet", schema, lex.where("cls = 'positive'"), lex.where("cls = 'negative'"),
                        max_files_per_trigger=spark.sparkContext.defaultParallelism)


query("stream_label", f"""WITH {LEXICON_CTE}, {DOC_TOKENS_CTE}
SELECT dt.doc_id, arg_min(CASE lex.cls WHEN 'positive' THEN 'positives' ELSE 'negatives' END, dt.pos) AS label,
  min(dt.pos) AS first_pos
FROM dt JOIN lex ON lex.term = dt.tok GROUP BY dt.doc_id""")(stream_label)


def stream_tweets(spark, sf_dir):
    """Turns written as a tweet log, then its stream to the end."""
    c = S.load(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    base = scratch(spark, "tweets")
    K.write_tweet_log(c.select(F.concat_ws("-", "conv_id", "turn").alias("tweet_id"), "text"), f"{base}/log")
    lex = S.lexicon(spark, sf_dir)
    opinion_tweets(spark, f"{base}/log", lex.where("cls = 'positive'"), lex.where("cls = 'negative'"), f"{base}/out", f"{base}/state", preserve_case=False).awaitTermination()
    return spark.read.schema("tweet_id string, text string, label string, first_pos long").parquet(f"{base}/out").select("tweet_id", "label", "first_pos")


# The texts hold words, dots and commas only (as for tweet_tokens); numbers and runs of dots are no lexicon words.
query("stream_tweets", f"""WITH {LEXICON_CTE},
t AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]{{3,}}|[\\p{{L}}]+|\\.(?:\\s*\\.)+|\\S') AS tok FROM conversations),
e AS (SELECT conv_id, turn, lower(unnest(tok)) AS tok, unnest(generate_series(0, len(tok) - 1))::BIGINT AS pos FROM t)
SELECT conv_id || '-' || turn AS tweet_id, arg_min(CASE lex.cls WHEN 'positive' THEN 'positives' ELSE 'negatives' END, pos) AS label,
  min(pos) AS first_pos FROM e JOIN lex ON lex.term = e.tok GROUP BY ALL""")(stream_tweets)


def preprocess_corpus(spark, sf_dir):
    """K1/K2: a labelled file, toxic texts as one of the classes that become
    "neutral", through the preprocessing chain and its cache."""
    c = S.corpus(spark, sf_dir).join(S.load(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    label = F.when(F.col("toxic") == 1, "objective-OR-neutral").otherwise(F.col("label"))
    base = scratch(spark, "preprocess")
    K.write_lines(c.select("sid", "uid", label.alias("label"), T.collapse_space("text").alias("text")), ["sid", "uid", "label", "text"], f"{base}/semeval", sep="\t")
    done = CA.cached(spark, f"{base}/cache", CA.preprocess, [f"{base}/semeval"])
    return done.select("sid", "label", F.col("target").cast("long").alias("target"), F.size("tok").cast("long").alias("n_tok"), F.size("tok_neg").cast("long").alias("n_tok_neg"))


query("preprocess_corpus", r"""WITH c AS (SELECT d.doc_id::VARCHAR AS sid,
  CASE WHEN l.toxic = 1 THEN 'neutral' WHEN l.quality = 1 THEN 'positive' ELSE 'negative' END AS label,
  len(string_split(trim(regexp_replace(d.text, '\s+', ' ', 'g')), ' ')) AS n FROM documents d JOIN labels l USING (doc_id))
SELECT sid, label, list_position(['positive', 'negative', 'neutral'], label)::BIGINT - 1 AS target, n AS n_tok, n AS n_tok_neg FROM c""")(preprocess_corpus)


def roundtrip_semeval(spark, sf_dir):
    """Labelled corpus written as SemEval TSV and read back."""
    c = S.corpus(spark, sf_dir).select("sid", "uid", "label", T.collapse_space("text").alias("text"))
    path = scratch(spark, "semeval")
    K.write_lines(c, ["sid", "uid", "label", "text"], path, sep="\t")
    rows, _rejects = RD.read_semeval(spark, path)
    return rows.drop("line_no")


query("roundtrip_semeval", r"""SELECT d.doc_id::VARCHAR AS sid, d.source AS uid,
  CASE WHEN l.quality = 1 THEN 'positive' ELSE 'negative' END AS label, trim(regexp_replace(d.text, '\s+', ' ', 'g')) AS text
FROM documents d JOIN labels l USING (doc_id)""")(roundtrip_semeval)


def roundtrip_vectors(spark, sf_dir):
    """Vectors written as ``%.4f`` text and read back L2-normalised (eps)."""
    path = scratch(spark, "vectors")
    K.write_word_vectors(S.vectors(spark, sf_dir), path)
    return V.to_long(RD.read_word_vectors(spark, path, normalize=True), "word")


query("roundtrip_vectors", f"""WITH r AS (SELECT vec_id::VARCHAR AS word, list_transform(embedding::DOUBLE[], lambda x: round(x, 4)) AS v
  FROM embeddings),
y AS (SELECT word, unnest(v) AS x, unnest(generate_series(0, len(v) - 1))::BIGINT AS dim,
        sqrt(list_sum(list_transform(v, lambda t: t * t)) + 1e-6) AS nrm FROM r)
SELECT word, dim, {r6('x / nrm')} AS value FROM y""")(roundtrip_vectors)


def roundtrip_lexicon(spark, sf_dir):
    """Lexicon written as one-word-per-line class files (with ``;``
    comments) and read back with later classes overriding."""
    lex = S.lexicon(spark, sf_dir)
    paths = {}
    for cls in ("positive", "negative"):
        p = scratch(spark, f"lex-{cls}")
        words = lex.where(F.col("cls") == cls).select(F.col("term").alias("value"))
        spark.createDataFrame([(f"; {cls} words",)], "value string").unionByName(words).write.text(p)
        paths[cls] = p
    return RD.read_bing_liu(spark, paths)


query("roundtrip_lexicon", f"WITH {LEXICON_CTE} SELECT term, cls FROM lex")(roundtrip_lexicon)


def html_unescape(spark, sf_dir):
    p = S.load(spark, sf_dir, "pages")
    d = p.select("page_id", H.decode_entities("html").alias("text"))
    return d.select("page_id", F.length("text").cast("long").alias("n_chars"),
                    F.size(F.filter(T.tweet_tokens(F.col("text")), lambda t: t.startswith("<"))).cast("long").alias("n_tags"))


query("html_unescape")(html_unescape)


def html_decode(spark, sf_dir):
    """P9a on whole pages: the decoded text itself."""
    p = S.load(spark, sf_dir, "pages")
    return p.select("page_id", H.decode_entities("html").alias("text"))


# The oracle spells out the named entities that occur in the driver's pages
# (amp, middot, copy, quot; no numeric ones).  None of the replacements holds
# '&', so chained replaces equal the decoder's single left-to-right pass.
query("html_decode", """SELECT page_id,
  replace(replace(replace(replace(html, '&amp;', ' and '), '&middot;', '·'), '&copy;', '©'), '&quot;', '"') AS text
FROM pages""")(html_decode)


def tweet_tokens_q(spark, sf_dir):
    c = S.load(spark, sf_dir, "conversations")
    t = c.select("conv_id", "turn", T.tweet_tokens(F.col("text"), preserve_case=False).alias("tok"))
    return t.select("conv_id", "turn", F.size("tok").cast("long").alias("n_tokens"),
                    F.array_join("tok", " ").alias("tokens"))


# These texts hold words, dots and commas only; runs of three ASCII letters end where another letter follows.
query("tweet_tokens", r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]{3,}|[\p{L}]+|\.(?:\s*\.)+|\S') AS tok FROM conversations)
SELECT conv_id, turn, len(tok)::BIGINT AS n_tokens, lower(array_to_string(tok, ' ')) AS tokens FROM t""")(tweet_tokens_q)


def train_word2vec(spark, sf_dir):
    d = S.documents(spark, sf_dir).select("doc_id", T.tokens("text").alias("tok"))
    model = M.word2vec(d, "tok", vector_size=16, min_count=5, max_iter=1)
    v = model.getVectors()
    return v.select("word", F.round(V.l2_norm(vector_to_array("vector")), 6).alias("norm"))


query("train_word2vec")(train_word2vec)


def _model_words(model, counts):
    """What training fixes whatever the weights: the model's words, their counts."""
    words = model.getVectors().select("word", F.size(vector_to_array("vector")).cast("long").alias("dim"))
    return words.join(counts, "word")


def word2vec_vocab(spark, sf_dir):
    d = S.documents(spark, sf_dir).select(T.tokens("text").alias("tok"))
    counts = written(C.vocabulary(d, F.col("tok"), 5))
    return _model_words(M.word2vec(d, "tok", vector_size=8, max_iter=1, vocab=counts), counts)


query("word2vec_vocab", f"""WITH {DOC_TOKENS_CTE}
SELECT tok AS word, 8::BIGINT AS dim, count(*) AS cnt FROM dt GROUP BY tok HAVING count(*) >= 5""")(word2vec_vocab)


def projected_word2vec_vocab(spark, sf_dir):
    """Every lexicon word is its class in the corpus the model trains on."""
    lex = S.lexicon(spark, sf_dir)
    d = S.documents(spark, sf_dir).select("doc_id", T.tokens("text").alias("tok"))
    projected = L.project_lexicon(d, F.col("tok"), lex).select(F.split("projected", " ").alias("tok"))
    counts = written(C.vocabulary(projected, F.col("tok"), 5))
    return _model_words(M.projected_word2vec(d, F.col("tok"), lex, vector_size=8, max_iter=1, vocab=counts), counts)


query("projected_word2vec_vocab", f"""WITH {LEXICON_CTE}, {DOC_TOKENS_CTE}
SELECT coalesce(lex.cls, dt.tok) AS word, 8::BIGINT AS dim, count(*) AS cnt
FROM dt LEFT JOIN lex ON lex.term = dt.tok GROUP BY 1 HAVING count(*) >= 5""")(projected_word2vec_vocab)


def _features(spark, sf_dir):
    blk = L.lexicon_scores(marked_tokens(spark, sf_dir), F.col("items"), S.lexicon(spark, sf_dir).select("term", "cls"))
    d = S.documents(spark, sf_dir).select("doc_id", "text", T.split_tokens(T.collapse_space("text")).alias("tok"))
    syn = d.select("doc_id", T.count_all_caps("tok").alias("n_caps"), T.count_elongated("tok").alias("n_elongated"),
                   T.punctuation_features("text")["excl_runs"].alias("excl_runs"))
    lab = S.load(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "positive")
                                                 .otherwise("negative").alias("label"))
    return written(blk.join(syn, "doc_id").join(lab, "doc_id"))  # each reader of the rows would score the texts again


FEATS = ["n_pos", "n_neg", "sum_pos", "sum_neg", "net", "max_pos", "max_neg", "last_nonzero", "last_score",
         "n_caps", "n_elongated", "excl_runs"]


def _split(spark, sf_dir):
    """Labelled feature rows: a tenth by hash order for the test, the rest to train."""
    return C.holdout_split(_features(spark, sf_dir), "doc_id", 0.1)


def svm_classifier(spark, sf_dir):
    """M7: fitted on the train rows, predicts the test rows only."""
    f = _split(spark, sf_dir)
    model = M.svm_model(FEATS, max_iter=25).fit(f.where("split = 'train'"))
    return model.transform(f.where("split = 'valid'")).select(
        "doc_id", F.col("label").alias("gold"), C.decode_labels(F.col("prediction").cast("int"), model.stages[0].labels).alias("pred"))


query("svm_classifier")(svm_classifier)


def svm_report(spark, sf_dir):
    """A8 over the held-out predictions."""
    return E.classification_report(svm_classifier(spark, sf_dir))


query("svm_report")(svm_report)


def svm_test_rows(spark, sf_dir):
    """Which rows the classifier is tested on, and their labels."""
    return _split(spark, sf_dir).where("split = 'valid'").select("doc_id", "label")


query("svm_test_rows", """WITH l AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label,
  row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '42'), doc_id) AS i, count(*) OVER () AS n
  FROM labels JOIN documents USING (doc_id))
SELECT doc_id, label FROM l WHERE i <= floor(n * 0.1)""")(svm_test_rows)


def svd_features(spark, sf_dir):
    from pyspark.ml.feature import VectorAssembler
    f = VectorAssembler(inputCols=FEATS, outputCol="features").transform(_features(spark, sf_dir))
    out = M.svd_projection(f, "features", 3, "doc_id")
    return out.select("doc_id", F.transform("components", lambda x: F.round(x, 4)).alias("components"))


query("svd_features")(svd_features)


def svd_gram(spark, sf_dir):
    """M9 at full rank: components keep every row's length and its products
    with the columns' sums, which SQL gives without an SVD."""
    from pyspark.ml.feature import VectorAssembler
    f = VectorAssembler(inputCols=FEATS, outputCol="features").transform(_features(spark, sf_dir))
    out = M.svd_projection(f, "features", len(FEATS), "doc_id")
    return out.select("doc_id", F.round(F.aggregate("components", F.lit(0.0), lambda a, x: a + x * x), 3).alias("length2"))


query("svd_gram", f"""WITH {LEXICON_CTE}, {DOC_TOKENS_CTE}, {NEG_MARK_CTE},
{score_block_cte('mk', CLASS_SCORE_SQL, 'blk')},
d AS (SELECT doc_id, text, string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS tok FROM documents),
syn AS (SELECT doc_id, len(list_filter(tok, lambda w: upper(w) = w AND lower(w) <> w)) AS n_caps,
  len(list_filter(tok, lambda w: len(list_filter(range(1, length(w) - 1), lambda i: substr(w, i, 1) = substr(w, i + 1, 1) AND substr(w, i, 1) = substr(w, i + 2, 1))) > 0)) AS n_elongated,
  len(regexp_extract_all(text, '!{{2,}}')) AS excl_runs FROM d)
SELECT doc_id, round({' + '.join(f'{c}::DOUBLE * {c}::DOUBLE' for c in FEATS)}, 3) AS length2
FROM blk JOIN syn USING (doc_id) JOIN labels USING (doc_id)""")(svd_gram)


def bag_ngram_classifier(spark, sf_dir):
    """M13 with the operator's defaults: fitted on the train rows, predicts
    the test rows only."""
    d = S.documents(spark, sf_dir).select("doc_id", T.tokens("text").alias("tok"))
    lab = S.load(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "positive")
                                                 .otherwise("negative").alias("label"))
    split = C.holdout_split(lab.join(S.documents(spark, sf_dir).select("doc_id"), "doc_id"), "doc_id", 0.1)
    data = d.join(split, "doc_id")
    model = B.fit(data.where("split = 'train'"), F.col("tok"), (F.col("label") == "positive").cast("int"))
    test = data.where("split = 'valid'")
    found = B.score(test, F.col("tok"), model)
    return test.select("doc_id", "label").join(found, "doc_id").select("doc_id", "label", (F.col("score") >= 0.5).cast("int").alias("pred"))


query("bag_ngram_classifier")(bag_ngram_classifier)


def bag_ngram_check(spark, sf_dir):
    """What the tables fix of those predictions: the rows, and whether more of
    them are right than by always saying the commonest class."""
    p = bag_ngram_classifier(spark, sf_dir)
    good = F.col("label") == "positive"
    by = p.agg(F.count(F.lit(1)).alias("n_test"), F.count_if(good).alias("n_positive"), F.count_if(good == (F.col("pred") == 1)).alias("right"))
    most = F.greatest("n_positive", F.col("n_test") - F.col("n_positive"))
    return by.select("n_test", "n_positive", (F.col("right") > most).alias("above_commonest"))


query("bag_ngram_check", """WITH l AS (SELECT quality, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '42'), doc_id) AS i, count(*) OVER () AS n
  FROM labels JOIN documents USING (doc_id))
SELECT count(*) AS n_test, count_if(quality = 1)::BIGINT AS n_positive, true AS above_commonest FROM l WHERE i <= floor(n * 0.1)""")(bag_ngram_check)
