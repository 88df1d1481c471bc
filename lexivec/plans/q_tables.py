"""Table queries: vocabulary, id sequences, labels, filters, lexicon tables, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivec.functions import text as T
from lexivec.operators import corpus as C
from lexivec.operators import lexicon as L
from lexivec.plans.catalog import query
from lexivec.plans.sqlparts import BIGRAM_LEXICON_CTE, DOC_TOKENS_CTE, LEXICON_CTE, toks
from lexivec.sources import tables as S

MAX_WORDS = 1000
MAXLEN = 50
LABELS = ["positive", "negative", "neutral"]


def _tokens(spark, sf_dir):
    return S.documents(spark, sf_dir).select("doc_id", T.tokens("text").alias("tok"))


def _ids_str(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _corpus3(spark, sf_dir):
    """Corpus with three classes: toxic -> negative, quality -> positive, else neutral."""
    d = S.documents(spark, sf_dir)
    lab = S.load(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(
        "doc_id", F.col("source").alias("uid"),
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral").alias("label"))


CORPUS3_SQL = """c3 AS (SELECT d.doc_id, d.source AS uid,
  CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS label
  FROM documents d JOIN labels l USING (doc_id))"""


def _docs(spark, sf_dir):
    return S.documents(spark, sf_dir).select("doc_id", "text")


def vocab(spark, sf_dir):
    # tokens are exploded straight from the text expression (no intermediate
    # array column: saves an array copy per document)
    return C.vocabulary(_docs(spark, sf_dir), T.tokens("text"), min_count=5)


query("vocab", f"""WITH {DOC_TOKENS_CTE}
SELECT tok AS word, count(*) AS cnt FROM dt GROUP BY tok HAVING count(*) >= 5""")(vocab)


def word_index_q(spark, sf_dir):
    return C.word_index(C.vocabulary(_docs(spark, sf_dir), T.tokens("text")))


query("word_index", f"""WITH {DOC_TOKENS_CTE}
SELECT word, row_number() OVER (ORDER BY cnt DESC, word) AS idx, cnt
FROM (SELECT tok AS word, count(*) AS cnt FROM dt GROUP BY tok)""")(word_index_q)


def _sequences(spark, sf_dir):
    d = _docs(spark, sf_dir)
    idx = C.top_words(C.vocabulary(d, T.tokens("text")), MAX_WORDS - 1)
    return C.to_ids(d, T.tokens("text"), idx, max_words=MAX_WORDS)


SEQ_SQL = f"""{DOC_TOKENS_CTE},
wi AS (SELECT word, row_number() OVER (ORDER BY cnt DESC, word) AS idx
       FROM (SELECT tok AS word, count(*) AS cnt FROM dt GROUP BY tok)),
seq AS (SELECT d.doc_id, coalesce(list(wi.idx::INTEGER ORDER BY dt.pos) FILTER (WHERE wi.idx IS NOT NULL), []::INTEGER[]) AS ids
        FROM (SELECT DISTINCT doc_id FROM dt) d JOIN dt USING (doc_id) LEFT JOIN wi ON wi.word = dt.tok AND wi.idx < {MAX_WORDS}
        GROUP BY d.doc_id)"""


def pad_sequences_q(spark, sf_dir):
    s = _sequences(spark, sf_dir)
    return s.select("doc_id", _ids_str(C.pad_sequences(F.col("ids"), MAXLEN)).alias("ids"))


query("pad_sequences", f"""WITH {SEQ_SQL}
SELECT doc_id, array_to_string(list_concat(list_resize([]::INTEGER[], greatest({MAXLEN} - len(ids), 0), 0),
  ids[greatest(len(ids) - {MAXLEN}, 0) + 1:]), ',') AS ids FROM seq""")(pad_sequences_q)


def ngram_dictionary_q(spark, sf_dir):
    return C.ngram_dictionary(_sequences(spark, sf_dir), "ids", 2, start=MAX_WORDS + 1)


NGRAM_DICT_SQL = f"""nd AS (SELECT ngram, (row_number() OVER (ORDER BY ngram) + {MAX_WORDS})::BIGINT AS token
  FROM (SELECT DISTINCT s1.i::VARCHAR || ',' || s2.i::VARCHAR AS ngram
        FROM (SELECT doc_id, unnest(ids) AS i, unnest(generate_series(1, len(ids))) AS p FROM seq) s1
        JOIN (SELECT doc_id, unnest(ids) AS i, unnest(generate_series(1, len(ids))) AS p FROM seq) s2
          ON s1.doc_id = s2.doc_id AND s2.p = s1.p + 1))"""

query("ngram_dictionary", f"""WITH {SEQ_SQL}, {NGRAM_DICT_SQL}
SELECT ngram, token FROM nd""")(ngram_dictionary_q)


def add_ngrams_q(spark, sf_dir):
    s = _sequences(spark, sf_dir)
    d = C.ngram_dictionary(s, "ids", 2, start=MAX_WORDS + 1)
    out = C.add_ngrams(s, "ids", d, 2)
    return out.select("doc_id", _ids_str(F.col("ids")).alias("ids"), F.size("ids").cast("long").alias("n_ids"))


query("add_ngrams", f"""WITH {SEQ_SQL}, {NGRAM_DICT_SQL},
el AS (SELECT doc_id, unnest(ids) AS i, unnest(generate_series(1, len(ids))) AS p FROM seq),
ext AS (SELECT a.doc_id, list(nd.token::INTEGER ORDER BY a.p) AS extra
        FROM el a JOIN el b ON a.doc_id = b.doc_id AND b.p = a.p + 1
        JOIN nd ON nd.ngram = a.i::VARCHAR || ',' || b.i::VARCHAR GROUP BY a.doc_id)
SELECT seq.doc_id, array_to_string(list_concat(seq.ids, coalesce(ext.extra, []::INTEGER[])), ',') AS ids,
  (len(seq.ids) + coalesce(len(ext.extra), 0))::BIGINT AS n_ids
FROM seq LEFT JOIN ext USING (doc_id)""")(add_ngrams_q)


def label_encode(spark, sf_dir):
    c = _corpus3(spark, sf_dir)
    tgt = C.encode_labels(F.col("label"), LABELS)
    return c.select("doc_id", "label", tgt.alias("target"),
                    C.decode_labels(tgt, LABELS).alias("decoded"),
                    F.array_join(F.transform(C.one_hot(tgt, 3), lambda x: x.cast("string")), ",").alias("onehot"))


query("label_encode", f"""WITH {CORPUS3_SQL}
SELECT doc_id, label, (CASE label WHEN 'positive' THEN 0 WHEN 'negative' THEN 1 ELSE 2 END)::INTEGER AS target,
  label AS decoded,
  CASE label WHEN 'positive' THEN '1,0,0' WHEN 'negative' THEN '0,1,0' ELSE '0,0,1' END AS onehot FROM c3""")(label_encode)


def merge_classes_q(spark, sf_dir):
    c = _corpus3(spark, sf_dir)
    return c.select("doc_id", "label", C.merge_classes(F.col("label"), ["negative", "neutral"], "other").alias("merged"))


query("merge_classes", f"""WITH {CORPUS3_SQL}
SELECT doc_id, label, CASE WHEN label IN ('negative', 'neutral') THEN 'other' ELSE label END AS merged FROM c3""")(merge_classes_q)


def filter_label(spark, sf_dir):
    return _corpus3(spark, sf_dir).where(F.col("label").isin("positive", "neutral"))


query("filter_label", f"""WITH {CORPUS3_SQL} SELECT * FROM c3 WHERE label IN ('positive', 'neutral')""")(filter_label)


def filter_uid(spark, sf_dir):
    return _corpus3(spark, sf_dir).where(F.col("uid") == "src3")


query("filter_uid", f"""WITH {CORPUS3_SQL} SELECT * FROM c3 WHERE uid = 'src3'""")(filter_uid)


def _tagged(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return t.select("doc_id", "tok", F.transform("tok", lambda w: S.pos_tag(w)).alias("pos"))


_TAG_SQL = "CASE WHEN length(tok) <= 3 THEN 'S' WHEN length(tok) <= 6 THEN 'M' ELSE 'L' END"


def keep_on_q(spark, sf_dir):
    k = C.keep_on(_tagged(spark, sf_dir), "pos", ["M", "L"], ["tok", "pos"])
    return k.select("doc_id", F.array_join("tok", " ").alias("tok"), F.array_join("pos", " ").alias("pos"))


query("keep_on", f"""WITH {DOC_TOKENS_CTE}
SELECT d.doc_id, coalesce(string_agg(tok, ' ' ORDER BY pos) FILTER (WHERE {_TAG_SQL} IN ('M', 'L')), '') AS tok,
  coalesce(string_agg({_TAG_SQL}, ' ' ORDER BY pos) FILTER (WHERE {_TAG_SQL} IN ('M', 'L')), '') AS pos
FROM dt d GROUP BY d.doc_id""")(keep_on_q)


def drop_on_q(spark, sf_dir):
    k = C.drop_on(_tagged(spark, sf_dir), "pos", ["S"], ["tok", "pos"])
    return k.select("doc_id", F.array_join("tok", " ").alias("tok"), F.size("pos").cast("long").alias("n_kept"))


query("drop_on", f"""WITH {DOC_TOKENS_CTE}
SELECT d.doc_id, coalesce(string_agg(tok, ' ' ORDER BY pos) FILTER (WHERE {_TAG_SQL} <> 'S'), '') AS tok,
  (count(*) FILTER (WHERE {_TAG_SQL} <> 'S'))::BIGINT AS n_kept
FROM dt d GROUP BY d.doc_id""")(drop_on_q)


def tag_enrich(spark, sf_dir):
    from lexivec.operators.tagging import enrich_tags, length_tagger
    t = enrich_tags(_tokens(spark, sf_dir), length_tagger)
    outside = F.size(F.filter(F.arrays_zip("chunk", "ner"), lambda x: (x["chunk"] == "O") & (x["ner"] == "O")))
    return t.select("doc_id", F.array_join("pos", " ").alias("pos"), outside.cast("long").alias("n_outside"))


query("tag_enrich", f"""WITH {DOC_TOKENS_CTE}
SELECT doc_id, string_agg({_TAG_SQL}, ' ' ORDER BY pos) AS pos, count(*)::BIGINT AS n_outside
FROM dt GROUP BY doc_id""")(tag_enrich)


def dict_vectors(spark, sf_dir):
    """M8 over per-document feature maps ``tag -> count`` (tags present only)."""
    t = _tagged(spark, sf_dir).select("doc_id", F.explode("pos").alias("tag"))
    counts = t.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).cast("double").alias("n"))
    maps = counts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "n"))).alias("f"))
    vecs, _names = C.dict_vectorize(maps, "f")
    return vecs.select("doc_id", _ids_str(F.col("indices")).alias("indices"),
                       F.array_join(F.transform("values", lambda v: v.cast("long").cast("string")), ",").alias("values"))


query("dict_vectors", f"""WITH {DOC_TOKENS_CTE},
c AS (SELECT doc_id, {_TAG_SQL} AS tag, count(*) AS n FROM dt GROUP BY 1, 2),
nm AS (SELECT tag, (dense_rank() OVER (ORDER BY tag)) - 1 AS idx FROM (SELECT DISTINCT tag FROM c))
SELECT doc_id, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS indices, string_agg(n::VARCHAR, ',' ORDER BY idx) AS "values"
FROM c JOIN nm USING (tag) GROUP BY doc_id""")(dict_vectors)


def _two_lexicons(spark, sf_dir):
    lex1 = S.lexicon(spark, sf_dir).select("term", "cls")
    bl = S.bigram_lexicon(spark, sf_dir)
    lex2 = bl.select("term", F.when(F.col("score") > 0, "positive").otherwise("negative").alias("cls"))
    return lex1, lex2


TWO_LEX_SQL = f"""{LEXICON_CTE}, {BIGRAM_LEXICON_CTE},
lex2 AS (SELECT term, CASE WHEN score > 0 THEN 'positive' ELSE 'negative' END AS cls FROM blex)"""


def single_word_lexicon(spark, sf_dir):
    lex1, lex2 = _two_lexicons(spark, sf_dir)
    return L.single_words(lex1.unionByName(lex2))


query("single_word_lexicon", f"""WITH {TWO_LEX_SQL}
SELECT term, cls FROM (SELECT term, cls FROM lex UNION ALL SELECT term, cls FROM lex2)
WHERE len(string_split(term, ' ')) = 1""")(single_word_lexicon)


def lexicon_union(spark, sf_dir):
    lex1, lex2 = _two_lexicons(spark, sf_dir)
    parts = lex2.select(F.explode(F.split("term", " ")).alias("term"), "cls").groupBy("term").agg(F.max("cls").alias("cls"))
    return L.union_last_wins(lex1, parts)


query("lexicon_union", f"""WITH {TWO_LEX_SQL},
parts AS (SELECT term, max(cls) AS cls FROM (SELECT unnest(string_split(term, ' ')) AS term, cls FROM lex2) GROUP BY term)
SELECT term, arg_max(cls, prio) AS cls FROM (SELECT term, cls, 0 AS prio FROM lex UNION ALL SELECT term, cls, 1 FROM parts)
GROUP BY term""")(lexicon_union)


def lexicon_invert(spark, sf_dir):
    inv = L.invert(S.lexicon(spark, sf_dir).select("term", "cls"))
    return inv.select("cls", "piece", F.array_join("terms", " ").alias("terms"), "n_terms")


query("lexicon_invert", f"""WITH {LEXICON_CTE},
p AS (SELECT cls, term, (row_number() OVER (PARTITION BY cls ORDER BY term) - 1) // {L.PIECE} AS piece FROM lex)
SELECT cls, piece, string_agg(term, ' ' ORDER BY term) AS terms, count(*) AS n_terms FROM p GROUP BY ALL""")(lexicon_invert)


def lexicon_graph(spark, sf_dir):
    return L.class_graph(S.vector_lexicon(spark, sf_dir))


query("lexicon_graph", """SELECT vec_id::VARCHAR AS term, label::VARCHAR AS cls,
  count(*) OVER (PARTITION BY label) AS degree FROM embeddings""")(lexicon_graph)


def stratified_split(spark, sf_dir):
    return C.stratified_split(S.lexicon(spark, sf_dir).select("term", "cls"), "cls", [F.col("term")], 0.9)


query("stratified_split", f"""WITH {LEXICON_CTE}
SELECT term, cls, CASE WHEN row_number() OVER (PARTITION BY cls ORDER BY term) - 1
  < floor(count(*) OVER (PARTITION BY cls) * 0.9) THEN 'train' ELSE 'test' END AS split FROM lex""")(stratified_split)


def holdout_split(spark, sf_dir):
    return C.holdout_split(S.load(spark, sf_dir, "labels").select("doc_id"), "doc_id", 100)


query("holdout_split", """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '42'), doc_id) <= 100
  THEN 'valid' ELSE 'train' END AS split FROM labels""")(holdout_split)


def truncate_q(spark, sf_dir):
    return C.truncate(_corpus3(spark, sf_dir), 50, [F.col("doc_id")])


query("truncate", f"""WITH {CORPUS3_SQL} SELECT * FROM c3 ORDER BY doc_id LIMIT 50""")(truncate_q)


def systematic_sample(spark, sf_dir):
    v = C.vocabulary(_docs(spark, sf_dir), T.tokens("text"))
    return C.systematic_sample(v, [F.col("cnt").desc(), F.col("word")], 7)


query("systematic_sample", f"""WITH {DOC_TOKENS_CTE}
SELECT word, cnt FROM (SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, word) - 1 AS r
  FROM (SELECT tok AS word, count(*) AS cnt FROM dt GROUP BY tok)) WHERE r % 7 = 0""")(systematic_sample)


def lexicon_sample(spark, sf_dir):
    """T4: 100 lexicon terms in hash order, sampled before the vocabulary filter."""
    s = C.sample_lexicon(S.lexicon(spark, sf_dir).select("term", "cls"), 100)
    v = C.vocabulary(_docs(spark, sf_dir), T.tokens("text")).select(F.col("word").alias("term"))
    return s.join(v, "term", "left_semi")


query("lexicon_sample", f"""WITH {LEXICON_CTE}, {DOC_TOKENS_CTE},
s AS (SELECT term, cls FROM lex ORDER BY md5(term || '42'), term LIMIT 100)
SELECT term, cls FROM s WHERE term IN (SELECT tok FROM dt)""")(lexicon_sample)


def class_sample(spark, sf_dir):
    return C.class_sample(S.vector_lexicon(spark, sf_dir), "cls", "term", 5)


query("class_sample", """SELECT term, cls FROM (SELECT vec_id::VARCHAR AS term, label::VARCHAR AS cls,
  row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR || '42'), vec_id::VARCHAR) AS r FROM embeddings)
WHERE r <= 5""")(class_sample)


def cnn_inputs(spark, sf_dir):
    """Model inputs per labelled document: padded id sequence
    and one-hot class (P26)."""
    s = _sequences(spark, sf_dir)
    c = _corpus3(spark, sf_dir)
    tgt = C.encode_labels(F.col("label"), LABELS)
    j = s.join(c, "doc_id")
    return j.select("doc_id", _ids_str(C.pad_sequences(F.col("ids"), MAXLEN)).alias("ids"),
                    F.array_join(F.transform(C.one_hot(tgt, 3), lambda x: x.cast("string")), ",").alias("onehot"))


query("cnn_inputs", f"""WITH {SEQ_SQL}, {CORPUS3_SQL}
SELECT seq.doc_id, array_to_string(list_concat(list_resize([]::INTEGER[], greatest({MAXLEN} - len(ids), 0), 0),
  ids[greatest(len(ids) - {MAXLEN}, 0) + 1:]), ',') AS ids,
  CASE label WHEN 'positive' THEN '1,0,0' WHEN 'negative' THEN '0,1,0' ELSE '0,0,1' END AS onehot
FROM seq JOIN c3 USING (doc_id)""")(cnn_inputs)


def sequence_stats(spark, sf_dir):
    """Mean id-sequence length (and count) over the corpus."""
    s = _sequences(spark, sf_dir)
    return s.agg(F.round(F.avg(F.size("ids")), 6).alias("mean_len"), F.count(F.lit(1)).alias("n_docs"))


query("sequence_stats", f"""WITH {SEQ_SQL}
SELECT (round(avg(len(ids)), 6) + 0.0) AS mean_len, count(*) AS n_docs FROM seq""")(sequence_stats)
