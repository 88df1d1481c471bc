"""Text queries: normalisation, negation, syntactic features, lexicon blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivec.functions import text as T
from lexivec.operators import lexicon as L
from lexivec.plans.catalog import query
from lexivec.plans.sqlparts import (BIGRAM_LEXICON_CTE, CLASS_SCORE_SQL, CLOSER, DOC_TOKENS_CTE, LEXICON_CTE, OPENER, r6,
                                    NEG_MARK_CTE, score_block_sql, toks)
from lexivec.sources import tables as S


def marked_tokens(spark, sf_dir):
    """documents -> collapse whitespace -> lower -> split -> negation marks."""
    return S.documents(spark, sf_dir).select("doc_id", T.mark_negation(T.tokens("text")).alias("items"))


def lex_block_uni(spark, sf_dir):
    return L.lexicon_scores(marked_tokens(spark, sf_dir), F.col("items"), S.lexicon(spark, sf_dir).select("term", "cls"))


query("lex_block_uni", f"""WITH {LEXICON_CTE}, {DOC_TOKENS_CTE}, {NEG_MARK_CTE},
{score_block_sql('mk', CLASS_SCORE_SQL)}""")(lex_block_uni)


# ------------------------------------------------------------ normalisation

def normalize_text_q(spark, sf_dir):
    d = S.documents(spark, sf_dir)
    return d.select("doc_id", T.normalize_text("text", lower_case=True).alias("norm"))


query("normalize_text", r"""SELECT doc_id,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(text, '\s+', ' ', 'g')),
    '\bhttp[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+\b', '_url_', 'g'),
    '@[A-Za-z0-9_]+\b', '_user_', 'g'),
    '\b-?[0-9]*[.,]?[0-9]+\b', '_number_', 'g') AS norm
FROM documents""")(normalize_text_q)


def replace_numbers_q(spark, sf_dir):
    return S.documents(spark, sf_dir).select("doc_id", T.replace_numbers("text").alias("out"))


query("replace_numbers", r"""SELECT doc_id, regexp_replace(text, '\b-?[0-9]*[.,]?[0-9]+\b', '_number_', 'g') AS out
FROM documents""")(replace_numbers_q)


def replace_users_q(spark, sf_dir):
    c = S.load(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.replace_users("text").alias("out"))


query("replace_users", r"""SELECT conv_id, turn, regexp_replace(text, '@[A-Za-z0-9_]+\b', '_user_', 'g') AS out
FROM conversations""")(replace_users_q)


def replace_urls_q(spark, sf_dir):
    p = S.load(spark, sf_dir, "pages")
    return p.select("page_id", T.replace_urls(F.concat(F.lit("see "), "url", F.lit(". ok"))).alias("out"))


query("replace_urls", r"""SELECT page_id, regexp_replace('see ' || url || '. ok',
  '\bhttp[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+\b', '_url_', 'g') AS out
FROM pages""")(replace_urls_q)


def collapse_space_q(spark, sf_dir):
    d = S.documents(spark, sf_dir)
    return d.select("doc_id", T.collapse_space(T.remove_carriage("text")).alias("out"),
                    F.length(T.collapse_space("text")).cast("long").alias("n_collapsed"))


query("collapse_space", r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[\n\r]', '', 'g'), '\s+', ' ', 'g') AS out,
  length(regexp_replace(text, '\s+', ' ', 'g'))::BIGINT AS n_collapsed FROM documents""")(collapse_space_q)


# ------------------------------------------------------- syntactic features

def syntax_features(spark, sf_dir):
    d = S.documents(spark, sf_dir).select("doc_id", "text", T.split_tokens(T.collapse_space("text")).alias("tok"))
    p = T.punctuation_features("text")
    return d.select("doc_id", T.count_all_caps("tok").alias("n_caps"), T.count_hashtags("tok").alias("n_hashtags"),
                    T.count_elongated("tok").alias("n_elongated"),
                    p["excl_runs"].alias("excl_runs"), p["quest_runs"].alias("quest_runs"),
                    p["mixed_runs"].alias("mixed_runs"), p["last_excl_quest"].alias("last_excl_quest"))


query("syntax_features", r"""WITH d AS (SELECT doc_id, text, string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS tok FROM documents)
SELECT doc_id,
  len(list_filter(tok, lambda w: upper(w) = w AND lower(w) <> w))::BIGINT AS n_caps,
  len(list_filter(tok, lambda w: starts_with(w, '#')))::BIGINT AS n_hashtags,
  len(list_filter(tok, lambda w: len(list_filter(range(1, length(w) - 1),
        lambda i: substr(w, i, 1) = substr(w, i + 1, 1) AND substr(w, i, 1) = substr(w, i + 2, 1))) > 0))::BIGINT AS n_elongated,
  len(regexp_extract_all(text, '!{2,}'))::BIGINT AS excl_runs,
  len(regexp_extract_all(text, '\?{2,}'))::BIGINT AS quest_runs,
  len(regexp_extract_all(text, '[!?]{2,}'))::BIGINT AS mixed_runs,
  (CASE WHEN regexp_matches(string_split(text, ' ')[-1], '[!?]') THEN 1 ELSE 0 END)::BIGINT AS last_excl_quest
FROM d""")(syntax_features)


# ------------------------------------------------------------------ negation

def neg_mark(spark, sf_dir):
    m = marked_tokens(spark, sf_dir)
    return m.select("doc_id", F.array_join("items", " ").alias("marked"),
                    F.size(F.filter("items", lambda w: w.endswith(T.NEG_SUFFIX))).cast("long").alias("n_negated"))


query("neg_mark", f"""WITH {DOC_TOKENS_CTE}, {NEG_MARK_CTE}
SELECT doc_id, string_agg(item, ' ' ORDER BY pos) AS marked,
  (count(*) FILTER (WHERE ends_with(item, '_NEG')))::BIGINT AS n_negated
FROM mk GROUP BY doc_id""")(neg_mark)


def neg_count(spark, sf_dir):
    d = S.documents(spark, sf_dir).select("doc_id", T.tokens("text").alias("tok"))
    return d.select("doc_id", T.count_negated_contexts("tok").alias("n_contexts"))


# Oracle: explicit fold over tokens as a recursive walk would be slow; the
# state machine is restated over the per-document marker string instead.
query("neg_count", f"""WITH {DOC_TOKENS_CTE},
k AS (SELECT doc_id, pos,
        CASE WHEN regexp_matches(tok, '{CLOSER}') AND regexp_matches(tok, '{OPENER.replace("'", "''")}') THEN 'B'
             WHEN regexp_matches(tok, '{CLOSER}') THEN 'C'
             WHEN regexp_matches(tok, '{OPENER.replace("'", "''")}') THEN 'O' ELSE '' END AS kind FROM dt)
SELECT doc_id, len(regexp_extract_all(string_agg(kind, '' ORDER BY pos), 'C*[OB]O*[BC]?'))::BIGINT AS n_contexts
FROM k GROUP BY doc_id""")(neg_count)


# ----------------------------------------------------------- lexicon blocks

def lex_block_score(spark, sf_dir):
    return L.lexicon_scores(marked_tokens(spark, sf_dir), F.col("items"),
                            S.lexicon(spark, sf_dir).select("term", "score"))


query("lex_block_score", f"""WITH {LEXICON_CTE}, {DOC_TOKENS_CTE}, {NEG_MARK_CTE},
{score_block_sql('mk', 'SELECT term, score FROM lex')}""")(lex_block_score)


def lex_block_bi(spark, sf_dir):
    m = marked_tokens(spark, sf_dir).select("doc_id", T.ngrams(F.col("items"), 2).alias("bi"))
    return L.lexicon_scores(m, F.col("bi"), S.bigram_lexicon(spark, sf_dir))


query("lex_block_bi", f"""WITH {LEXICON_CTE}, {BIGRAM_LEXICON_CTE}, {DOC_TOKENS_CTE}, {NEG_MARK_CTE},
bi AS (SELECT a.doc_id, a.pos, a.item || ' ' || b.item AS item
       FROM mk a JOIN mk b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1
       UNION ALL
       SELECT doc_id, NULL AS pos, NULL AS item FROM mk GROUP BY doc_id HAVING count(*) < 2),
{score_block_sql('bi', 'SELECT term, score FROM blex')}""")(lex_block_bi)


def lex_block_pair(spark, sf_dir):
    return L.pair_scores(marked_tokens(spark, sf_dir), F.col("items"), S.pair_lexicon(spark, sf_dir))


# Enumerates every pair of chain positions whose grams are in the lexicon.
query("lex_block_pair", f"""WITH {BIGRAM_LEXICON_CTE},
plex AS (SELECT split_part(term, ' ', 1) AS l, split_part(term, ' ', 2) AS r, max(score) AS score FROM blex GROUP BY 1, 2),
{DOC_TOKENS_CTE}, {NEG_MARK_CTE},
n AS (SELECT doc_id, count(*) AS n FROM mk GROUP BY doc_id),
g0 AS (SELECT a.doc_id, a.item || ' ' || b.item AS g, a.pos AS c FROM mk a JOIN mk b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1
      UNION ALL SELECT mk.doc_id, mk.item AS g, mk.pos + n.n - 1 AS c FROM mk JOIN n USING (doc_id)),
g AS (SELECT doc_id, lower(replace(g, '_NEG', '')) AS g, c, contains(g, '_NEG') AS neg FROM g0),
m AS (SELECT a.doc_id, a.c AS c1, b.c AS c2, CASE WHEN a.neg OR b.neg THEN -p.score ELSE p.score END AS s
      FROM plex p JOIN g a ON a.g = p.l JOIN g b ON b.g = p.r AND b.doc_id = a.doc_id AND a.c < b.c),
agg AS (SELECT doc_id, count(*) FILTER (WHERE s > 0) AS n_pos, count(*) FILTER (WHERE s < 0) AS n_neg,
          sum(s) FILTER (WHERE s > 0) AS sp, sum(-s) FILTER (WHERE s < 0) AS sn, max(s) FILTER (WHERE s > 0) AS mp,
          max(-s) FILTER (WHERE s < 0) AS mn, arg_max(abs(s), (c1, c2)) FILTER (WHERE s <> 0) AS lz FROM m GROUP BY doc_id),
fin AS (SELECT m.doc_id, m.s FROM m JOIN n ON n.doc_id = m.doc_id AND m.c2 = 2 * n.n - 2 AND m.c1 = 2 * n.n - 3)
SELECT d.doc_id, coalesce(n_pos, 0)::BIGINT AS n_pos, coalesce(n_neg, 0)::BIGINT AS n_neg,
  {r6('coalesce(sp, 0)')} AS sum_pos, {r6('coalesce(sn, 0)')} AS sum_neg, {r6('coalesce(sp, 0) - coalesce(sn, 0)')} AS net,
  {r6('coalesce(mp, 0)')} AS max_pos, {r6('coalesce(mn, 0)')} AS max_neg, {r6('coalesce(lz, 0)')} AS last_nonzero,
  {r6('coalesce(fin.s, 0)')} AS last_score
FROM documents d LEFT JOIN agg USING (doc_id) LEFT JOIN fin ON fin.doc_id = d.doc_id""")(lex_block_pair)


# --------------------------------------------------------------- projection

def lex_project(spark, sf_dir):
    d = S.documents(spark, sf_dir).select("doc_id", T.tokens("text").alias("tok"))
    return L.project_lexicon(d, F.col("tok"), S.lexicon(spark, sf_dir), "cls", case_sensitive=True)


query("lex_project", f"""WITH {LEXICON_CTE}, {DOC_TOKENS_CTE}
SELECT dt.doc_id, string_agg(coalesce(lex.cls, dt.tok), ' ' ORDER BY dt.pos) AS projected
FROM dt LEFT JOIN lex ON lex.term = dt.tok GROUP BY dt.doc_id""")(lex_project)


def cluster_project(spark, sf_dir):
    d = S.documents(spark, sf_dir).select("doc_id", T.split_tokens(T.collapse_space("text")).alias("tok"))
    return L.project_lexicon(d, F.col("tok"), S.clusters(spark, sf_dir).withColumnRenamed("word", "term"),
                             "cluster", case_sensitive=False, not_found="NOT_FOUND")


query("cluster_project", f"""WITH {LEXICON_CTE},
dt AS (SELECT doc_id, unnest(t) AS tok, unnest(generate_series(0, len(t) - 1)) AS pos
       FROM (SELECT doc_id, string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS t FROM documents))
SELECT dt.doc_id, string_agg(coalesce(substr(lex.term, 1, 1), 'NOT_FOUND'), ' ' ORDER BY dt.pos) AS projected
FROM dt LEFT JOIN lex ON lex.term = lower(dt.tok) GROUP BY dt.doc_id""")(cluster_project)


def distant_label_q(spark, sf_dir):
    lex = S.lexicon(spark, sf_dir)
    d = S.documents(spark, sf_dir).select("doc_id", T.tokens(T.normalize_text("text")).alias("tok"))
    return L.distant_label(d, F.col("tok"), lex.where("cls = 'positive'"), lex.where("cls = 'negative'"))


query("distant_label", f"""WITH {LEXICON_CTE}, {DOC_TOKENS_CTE}
SELECT dt.doc_id, arg_min(CASE lex.cls WHEN 'positive' THEN 'positives' ELSE 'negatives' END, dt.pos) AS label,
  min(dt.pos) AS first_pos
FROM dt JOIN lex ON lex.term = dt.tok GROUP BY dt.doc_id""")(distant_label_q)


# ------------------------------------------------------------------ n-grams

def word_ngrams(spark, sf_dir):
    d = S.documents(spark, sf_dir).select("doc_id", T.sklearn_words("text").alias("w"))
    return d.select("doc_id", *[F.size(F.array_distinct(T.ngrams(F.col("w"), n))).cast("long").alias(f"n{n}")
                                for n in range(1, 5)])


query("word_ngrams", "WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents)\n"
      "SELECT doc_id, " + ", ".join(
          f"len(list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))))::BIGINT AS n{n}"
          for n in range(1, 5)) + " FROM d")(word_ngrams)


def char_ngrams_q(spark, sf_dir):
    d = S.documents(spark, sf_dir)
    return d.select("doc_id", *[F.size(F.array_distinct(T.char_ngrams("text", n))).cast("long").alias(f"c{n}")
                                for n in (3, 4, 5)])


query("char_ngrams", "WITH d AS (SELECT doc_id, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents)\n"
      "SELECT doc_id, " + ", ".join(
          f"len(list_distinct(list_transform(range(1, length(x) - {n - 2}), lambda i: substr(x, i, {n}))))::BIGINT AS c{n}"
          for n in (3, 4, 5)) + " FROM d")(char_ngrams_q)
